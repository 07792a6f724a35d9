"""Files that do not parse."""

from __future__ import annotations

import ast

import pytest

from oreline.llm import syntax

VALID = {
    "python": [
        "", "# only a comment", "x = 1", "def f(a, *, b=1, **k):\n    return a if b else [y for y in k if y]\n", "class A(B):\n    '''doc ( [ {'''\n    @property\n    def p(self) -> int:\n        try:\n            return self.x[1:2, ::3]\n        except (A, B) as e:\n            raise X from e\n        finally:\n            pass\n",
        "async def f():\n    async for x in y:\n        await z\n    else:\n        print(f'{x:>{5}}')\n", "if a: b = 1; c = 2\nelif d: pass\nelse:\n    e()\n", "with open(a) as f, g() as (h, i):\n    x: int = 3\n    y += lambda q, *r: q\n", "match x:\n    case [1, 2]:\n        pass\n", "from . import (a as b,\n    c)\nimport x.y as z\nglobal_ = {**a, 'b': 2}\nprint(*a, sep='')\n", "x = (yield)\r\nif x:\r\n\tpass\r\n",
        "for i, (a, b) in enumerate(z):\n    del a[0], b\n    assert a, b\nwhile not (x := f()):\n    continue\n",
    ],
    "javascript": [
        "", "const a = 1;", "'use strict';\nlet x = /[/]\\/(/g.test(s) ? a / b : `t ${a + `${b}`} }`;\nfor (const k of list) { if (k) continue; else break; }\n", "module.exports = async function (a, { b = 1 }, ...c) {\n  try { await a?.b(c) } catch { return } finally { x() }\n};", "class A extends B { static x = 1; #p = 2; get y() { return this.#p; } async *g() { yield* z; } }",
        "const f = (x) => ({ a: x, b() { return 1 }, [c]: 2, ...d });\nf\n  .then(x => x)\n", "import a, { b as c } from 'm';\nexport default class {}\nexport { a };\n", "switch (x) { case 'a': y(); break; default: z() }\ndo { i++ } while (i < 3)\n", "label: for (;;) { break label }", "x = a ? b : c ? d : e, f = function* () {}\n", "// lone }\n/* { */ var s = '{';", "@Injectable({ a: 1 })\nexport class A { @Input() x = 1; @b.c y() {} }",
    ],
    "typescript": [
        "export interface A { id: string; size?: number; tags: string[]; }", "export type Id = string | number;", "export async function f<T extends object>(items: T[]): Promise<T | null> {\n  const first = items.find((x) => x != null) as T | undefined;\n  return first ? { ...first } : null;\n}",
        "class A implements B {\n  private readonly seen = new Map<string, number>();\n  constructor(private root: string) {}\n  load(key: string): number | undefined { return this.seen.get(key) ?? 0; }\n}", "enum E { A = 1, B }\nconst x: Array<[string, number]> = [];\nlet y = x!.length;",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\n/** { */\npublic final class A<T extends B> implements C<T> {\n  private final Map<String, List<Integer>> m = new HashMap<>();\n  @Override public int f(int[] a, String... b) throws E { for (int i = 0; i < a.length; i++) { m.put(\"x{\", null); } return a == null ? 1 : -1; }\n}", "interface I { default int size() { return 1; } Optional<String> g(Map<String, List<Integer>> x); }",
        "class A { A() { super(); } static { x = 1; } void f() { try (R r = g()) { h(); } catch (A | B e) { throw new X(e); } finally { } list.forEach(x -> { y(x); }); int[] a = {1, 2}; do { i--; } while (i > 0); switch (c) { case 'a': break; default: } } }", "enum E { A(1), B { void f() {} }; private int x; E(int... x) {} }",
    ],
    "c": [
        "#include <stdio.h>\n#define X(a) ((a) + 1)\nstatic int f(const char *s, size_t n)\n{\n    char buf[3 + 1] = {0};\n    if (s == NULL || n > 3) {\n        return -1;\n    }\n    for (int i = 0; i < 3; i++) buf[i] = '{';\n    printf(\"%d {\\n\", (int)n);\n    return *s ? 1 : 0;\n}\n", "struct a { int x; struct a *next; };\ntypedef unsigned long u;\nenum e { A, B = 2 };\nextern int g(void);\n", "int main(int argc, char **argv) { switch (argv[1][0]) { case '(': return 1; default: break; } do { x--; } while (x); goto end; end: return 0; }",
    ],
    "go": [
        'package main\n\nimport (\n\t"fmt"\n\ts "strings"\n)\n\ntype A struct {\n\tID int\n\tName string `json:"n,omitempty"`\n}\n\nfunc (k *A) f(in []string, n int) ([]string, error) {\n\tif len(in) == 0 {\n\t\treturn nil, errors.New("x {")\n\t}\n\tout := make([]string, 0, n)\n\tfor i, v := range in {\n\t\tout = append(out, v)\n\t\t_ = i\n\t}\n\treturn out, nil\n}\n',
        "package p\n\nfunc g(ch <-chan int) (total int) {\n\tfor {\n\t\tselect {\n\t\tcase v, ok := <-ch:\n\t\t\tif !ok {\n\t\t\t\treturn total\n\t\t\t}\n\t\t\ttotal += v % 6\n\t\tdefault:\n\t\t}\n\t}\n}\n", "package p\n\nvar m = map[string]int{\"a\": 1}\n\nconst (\n\tA = iota\n\tB\n)\n\ntype I interface {\n\tF(x int) error\n}\n\nfunc h() { go func() { defer x.Close() }() }\n",
    ],
}
BROKEN = {
    "python": ["def f(", "for x in y", "if a:\n", "x = [1, 2", "<<<<<<< HEAD\na = 1\n=======\nb = 2\n>>>>>>> x\n", "print 'a'", "  x = 1", "else:\n    pass", "try:\n    a()\nb()\n", "class A:\n    '''doc", "@dec\n", "a b", "int main() {\n return 0;\n}", "404: Not Found\nThe page.\n", "def f():\n    return 1\n  x = 2\n", "x = 'a"],
    "javascript": ["function f(", "const x", "if (a) {", "foo(;", "<<<<<<< ours\na();\n=======\n", "import os\nimport re\n", "let s = 'a", "x = `a ${b", "package main\n\nfunc f() {}\n", "class A { f() { return 1 }", "try { a() }", "return }", "const m = /^[a", "a b c", "#include <stdio.h>\nint x;"],
    "typescript": ["interface A { id: string", "export type X = string |", "def f(x):\n    return x\n", "=======\nconst a = 1;", "class A { x: number = ; }"],
    "java": ["class A {", "class A { int x = ; }", "import java.util.List", "<html><body>x</body></html>", "let counter = 0;\n", "class A {\n<<<<<<< HEAD\n int x;\n}", "/** open", "package main\n\nfunc f() {}\n", "} class A {}"],
    "c": ["int f(void) {", "int f(int a", "struct a { int x; }", "#incl <x>", "import os\n", "int x = 'a", "def f(a):\n    return a\n", "const x = require('y');", ">>>>>>> b\nint x;"],
    "go": ["package p\n\nfunc f() {\n", "package p\n\nimport (\n\"a\"\n", "def f():\n    pass\n", "package p\n\nfunc f( {}\n", "#include <a.h>\nint x;\n", "package p\n\n=======\nfunc f() {}\n", "const x = require('y');\nfunction f() { return 1; }\n"],
}


def judge(spark, rows):
    df = spark.createDataFrame([(str(i), c, p, lang, 9, "clash") for i, (c, p, lang) in enumerate(rows)], "id string, code string, file_path string, language string, k int, tok string")
    return {int(r.id) for r in syntax.find_invalid(df).collect()}


def test_valid_and_broken_files(spark):
    for code in VALID["python"]:
        ast.parse(code)
    rows = [(c, "a/b.txt", lang) for lang, codes in VALID.items() for c in codes]
    cut = len(rows)
    rows += [(c, "a/b.txt", lang) for lang, codes in BROKEN.items() for c in codes]
    got = judge(spark, rows)
    assert [rows[i] for i in sorted(got) if i < cut] == []
    assert [rows[i] for i in range(cut, len(rows)) if i not in got] == []


def test_indented_directives(spark):
    rows = [("int f(void) {\n  #ifdef X\n\treturn 1;\n\t# endif\n  return 0;\n}\n", None, "c"), ("int f(void) {\n  #incl <x>\n  return 0;\n}\n", None, "c")]
    assert judge(spark, rows) == {1}


def test_languages_nulls_and_copies(spark):
    bad = "def f("
    rows = [(bad, "r/x.py", None), (bad, "r/x.PY ", " "), (bad, "r/x.js", "Py"), (None, "r/x.py", "python"), (bad, "r/x.rb", None), (bad, None, None), (bad, "r/x.py", "cobol"), ("", "r/x.py", None), (bad, "r/y.py", "python"), ("x = 1", "r/x.py", None)]
    assert judge(spark, rows) == {0, 1, 2, 8}
    assert judge(spark, []) == set()


def test_rates(spark):
    rows = [("1", "x = 1", "repo/a.py", "python"), ("2", "x = (", "repo/b.py", "py"), ("3", "x = (", "./other\\b.py", None), ("4", "let a = 1;", "repo/c.js", "js"), ("5", "x = (", None, "python")]
    df = spark.createDataFrame(rows, "id string, code string, file_path string, language string")
    got = {(r.repository, r.language): (r.n_files, r.n_invalid) for r in syntax.invalid_rates(df).collect()}
    assert got == {("repo", "python"): (2, 1), ("other", "python"): (1, 1), ("repo", "javascript"): (1, 0), (None, "python"): (1, 1)}


@pytest.mark.parametrize("lang", ["python", "javascript", "java", "c", "go", "typescript"])
def test_very_long_files(spark, lang):
    unit = {"python": "x = [1, 2]\n", "javascript": "f(a, [1]);\n", "java": "", "c": "int a[3];\n", "go": "", "typescript": "f(a, [1]);\n"}[lang]
    code = unit * 3_000 or {"java": "class A { int[] a = {" + "1, " * 9_000 + "2}; }", "go": "package p\n\nvar a = []int{" + "1, " * 9_000 + "2}\n"}[lang]
    assert judge(spark, [(code, None, lang), (code + "(", None, lang)]) == {1}
