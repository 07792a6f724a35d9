"""Lexers of six languages: source text to token classes (see ``grammar``) in document order.

A token class of ``!`` is a lexical error: an unterminated text or comment, a character or number no language rule
allows, an unknown directive, a merge marker. Comments are left out. Semicolons that the language itself inserts at
line ends (JavaScript, TypeScript, Go) are emitted; Python's lines and indentation are tokens.
"""

from __future__ import annotations

import re

ERROR = "!"
NAMES = {
    "py": "python", "python3": "python", "py3": "python", "js": "javascript", "node": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "golang": "go", "h": "c", "ecmascript": "javascript",
}
LANGUAGES = ("python", "javascript", "typescript", "java", "c", "go")

MERGE = r"^(?:<{7}|>{7}|\|{7})(?![<>|])[^\n]*|^={7}(?=\s*$)"
NUMBER = {
    "c": r"0[xX][0-9a-fA-F]*(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLfF]*|0[bB][01]+[uUlL]*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[uUlLfF]*",
    "java": r"0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?",
    "go": r"0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?",
    "javascript": r"0[xX][0-9a-fA-F_]+n?|0[bBoO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?",
    "python": r"0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?",
}
WORD = r"[^\W\d]\w*"

# The keywords of each language by their class.
KEYWORDS = {
    "javascript": {
        "var": "v", "let": "v", "const": "V", "function": "F", "class": "K", "extends": "X", "if": "I", "else": "E", "for": "L", "while": "W", "do": "O",
        "switch": "T", "case": "C", "default": "d", "return": "R", "throw": "t", "try": "Y", "catch": "c", "finally": "y", "break": "J", "continue": "J", "debugger": "J",
        "new": "w", "await": "a", "typeof": "a", "void": "a", "delete": "a", "in": "N", "instanceof": "N", "import": "M", "export": "e", "yield": "z", "async": "A",
        "true": "l", "false": "l", "null": "l", "enum": ERROR,
    },
    "java": {
        **dict.fromkeys("int long short byte char boolean float double void".split(), "p"),
        **dict.fromkeys("public private protected static final abstract native transient volatile strictfp sealed".split(), "m"),
        "synchronized": "n", "default": "d", "class": "K", "interface": "K", "enum": "K", "extends": "X", "implements": "X", "permits": "X", "throws": "h", "if": "I", "else": "E",
        "for": "L", "while": "W", "do": "O", "switch": "T", "case": "C", "return": "R", "throw": "t", "try": "Y", "catch": "c", "finally": "y", "break": "J", "continue": "J",
        "new": "w", "instanceof": "N", "import": "M", "package": "a", "assert": "Z", "true": "l", "false": "l", "null": "l", "goto": ERROR, "const": ERROR,
    },
    "c": {
        **dict.fromkeys("int long short char float double void signed unsigned _Bool _Complex __int128".split(), "p"),
        **dict.fromkeys("static const extern inline volatile register restrict auto _Noreturn _Thread_local __inline __restrict".split(), "m"),
        "struct": "K", "union": "K", "enum": "K", "typedef": "H", "sizeof": "a", "_Alignof": "a", "if": "I", "else": "E", "for": "L", "while": "W", "do": "O", "switch": "T",
        "case": "C", "default": "d", "return": "R", "break": "J", "continue": "J", "goto": "g",
    },
    "go": {
        "func": "F", "type": "Y", "var": "v", "const": "v", "import": "M", "package": "a", "if": "I", "else": "E", "for": "L", "switch": "T", "select": "T", "case": "C",
        "default": "d", "return": "R", "break": "J", "continue": "J", "fallthrough": "J", "goto": "J", "go": "g", "defer": "g", "struct": "K", "interface": "K", "map": "m",
        "chan": "h", "range": "n",
    },
    "python": {
        "async": "A", "def": "F", "class": "K", "if": "I", "elif": "e", "else": "E", "for": "L", "while": "W", "try": "T", "except": "c", "finally": "y", "with": "w",
        "return": "R", "raise": "t", "import": "M", "from": "f", "as": "s", "pass": "J", "break": "J", "continue": "J", "global": "g", "nonlocal": "g", "del": "d",
        "assert": "a", "yield": "z", "await": "j", "in": "N", "is": "N", "not": "n", "or": "o", "and": "o", "lambda": "Y", "True": "l", "False": "l", "None": "l",
    },
}
KEYWORDS["typescript"] = {**KEYWORDS["javascript"], "enum": "U", "implements": "X"}
MEMBER_WORDS = {"static", "get", "set"}
TS_MEMBER_WORDS = MEMBER_WORDS | {"public", "private", "protected", "readonly", "abstract", "declare", "override", "accessor"}

OPERATORS = {
    "javascript": [("=>", "G"), ("...", "q"), ("?.", "."), ("++", "k"), ("--", "k"), *((o, "=") for o in (">>>=", "**=", "<<=", ">>=", "&&=", "||=", "??=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")),
                   *((o, "b") for o in ("===", "!==", "==", "!=", "<=", ">=", "&&", "||", "??", "**", ">>>", "<<", ">>", "/", "%", "&", "|", "^")), ("!", "u"), ("~", "u"), ("+", "s"), ("-", "s"), ("*", "x"), ("=", "="), ("<", "<"), (">", ">"), ("?", "?"), (":", ":"), (".", "."), (",", ","), (";", ";"), ("@", "@"), ("#", "")],
    "java": [("->", "G"), ("...", "q"), ("::", "r"), ("++", "k"), ("--", "k"), *((o, "=") for o in (">>>=", "<<=", ">>=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")),
             *((o, "b") for o in ("==", "!=", "<=", ">=", "&&", "||", "<<", "/", "%", "|", "^")), ("&", "&"), ("!", "u"), ("~", "u"), ("+", "s"), ("-", "s"), ("*", "x"), ("=", "="), ("<", "<"), (">", ">"), ("?", "?"), (":", ":"), (".", "."), (",", ","), (";", ";"), ("@", "@")],
    "c": [("...", "q"), ("->", "."), ("++", "k"), ("--", "k"), *((o, "=") for o in ("<<=", ">>=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")), *((o, "b") for o in ("==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "/", "%", "|", "^", "<", ">")),
          ("&", "s"), ("!", "u"), ("~", "u"), ("+", "s"), ("-", "s"), ("*", "x"), ("=", "="), ("?", "?"), (":", ":"), (".", "."), (",", ","), (";", ";")],
    "go": [("...", "q"), ("<-", "A"), ("++", "k"), ("--", "k"), *((o, "=") for o in (":=", "&^=", "<<=", ">>=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")), *((o, "b") for o in ("==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "&^", "/", "%", "|", "<", ">")),
           ("&", "s"), ("^", "s"), ("!", "u"), ("~", "u"), ("+", "s"), ("-", "s"), ("*", "x"), ("=", "="), (":", ":"), (".", "."), (",", ","), (";", ";")],
    "python": [("->", "G"), (":=", "k"), ("...", "l"), *((o, "=") for o in ("**=", "//=", "<<=", ">>=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@=")), ("**", "X"), *((o, "b") for o in ("//", "==", "!=", "<=", ">=", "<<", ">>", "/", "%", "&", "|", "^", "<", ">")),
               ("~", "u"), ("+", "p"), ("-", "p"), ("*", "x"), ("=", "="), (":", ":"), (".", "."), (",", ","), (";", ";"), ("@", "@")],
}
OPERATORS["typescript"] = OPERATORS["javascript"]
DIRECTIVE = re.compile(
    r"#[ \t]*(?:include(?:_next)?[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*.*)|define[ \t]+[A-Za-z_]\w*(?:\([^)\n]*\))?(?:[ \t].*)?|undef[ \t]+\w+|if(?:n?def[ \t]+\w+|[ \t(!].+)|elif(?:n?def)?[ \t(].*|else|endif|pragma.*|error.*|warning.*|line.*)?[ \t]*(?://.*|/\*.*)?$"
)


def _master(language: str) -> re.Pattern:
    base = "javascript" if language == "typescript" else language
    ops = "|".join(re.escape(o) for o, _ in sorted(OPERATORS[language], key=lambda x: -len(x[0])))
    parts = [("space", r"[ \t\f\r\v ﻿]+"), ("merge", MERGE), ("line", r"\n")]
    if language == "python":
        triple = r"(?i:[rbuft]|rb|br|fr|rf|tr|rt)?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?''')"
        single = r"(?i:[rbuft]|rb|br|fr|rf|tr|rt)?(?:\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"\"(?!\")|''(?!'))"
        parts += [("comment", r"#[^\n]*"), ("join", r"\\\n"), ("text", f"{triple}|{single}")]
    else:
        parts += [("comment", r"//[^\n]*|/\*[\s\S]*?\*/")]
        char = r"'(?:[^'\\\n]|\\.)+'" if language in ("c", "java", "go") else r"'(?:[^'\\\n]|\\[\s\S])*'"
        double = r"\"(?:[^\"\\\n]|\\[\s\S])*\""
        if language == "c":
            parts.insert(0, ("directive", r"^[ \t]*#(?:[^\n\\]|\\[\s\S])*"))  # before the space that may lead it
            parts += [("text", rf"(?:L|u8|[uU])?{double}|[LuU]?{char}")]
        elif language == "java":
            parts += [("text", rf"\"\"\"[ \t]*\n(?:[^\\]|\\[\s\S])*?\"\"\"|{double}|{char}")]
        elif language == "go":
            parts += [("text", rf"`[^`]*`|\"(?:[^\"\\\n]|\\[^\n])*\"|{char}")]
        else:
            parts += [("text", rf"{double}|{char}"), ("template", "`")]
    parts += [("number", NUMBER[base]), ("word", r"[^\W\d][\w$]*|\$[\w$]*" if base in ("javascript", "java") else WORD), ("open", r"[(\[{]"), ("close", r"[)\]}]"), ("op", ops)]
    return re.compile("|".join(f"(?P<{n}>{r})" for n, r in parts), re.M)


_MASTER: dict[str, re.Pattern] = {}
_CLASS = {lang: dict(ops) for lang, ops in OPERATORS.items()}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPERAND_ENDS = set("il.)]}k")
#: After these a JavaScript line can end a statement, and before these it does.
_JS_ENDS, _JS_STARTS = set("ilkJRz)]}"), set("ilvVFKILWOTRtYJwaMeAmuq@QHU")
_GO_ENDS = set("ilJRk)]}")


def lex(code: str, language: str) -> list[str]:
    """Token classes of a text; blocks of Python open with ``\\x01`` and close with ``\\x02``."""
    code = code.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
    if language == "python":
        return _python(code)
    if language in ("javascript", "typescript"):
        out: list[str] = []
        if code.startswith("#!"):
            code = "//" + code
        end = _javascript(code, 0, language, out, False)
        if end < len(code):
            out.append(ERROR)
        return out
    return _plain(code, language)


def _scanner(language: str) -> re.Pattern:
    if language not in _MASTER:
        _MASTER[language] = _master(language)
    return _MASTER[language]


def _plain(code: str, language: str) -> list[str]:
    """Java, C and Go."""
    out: list[str] = []
    scan, words, ops = _scanner(language).match, KEYWORDS[language], _CLASS[language]
    at, n, line = 0, len(code), False
    go = language == "go"
    while at < n:
        m = scan(code, at)
        if m is None:
            out.append(ERROR)
            at += 1
            continue
        kind, text = m.lastgroup, m[0]
        at = m.end()
        if kind == "space":
            continue
        if kind == "line" or kind == "comment":
            if go and "\n" in text and out and out[-1] in _GO_ENDS:
                out.append(";")
            continue
        if kind == "word":
            c = words.get(text, "i")
            if out and out[-1] == "." and language == "java" and c not in "wK":
                c = "i"
            elif language == "java":
                if text == "class" and out and out[-1] == ".":
                    c = "i"
                elif text == "record" and re.match(r"\s+\w+\s*[(<]", code[at : at + 200]):
                    c = "K"
                elif text == "non" and code.startswith("-sealed", at):
                    c, at = "m", at + 7
                elif c == "n" and not re.match(r"\s*\(", code[at : at + 50]):
                    c = "m"
                elif c == "d" and re.match(r"\s+[\w@<]", code[at : at + 50]) and not re.match(r"\s+(?:->|\S+;?\s*\))", code[at : at + 50]) and out and out[-1] in "{};m)":
                    c = "m"
                elif text == "interface" and out and out[-1] == "@":
                    out.pop()
            out.append(c)
        elif kind in ("text", "number"):
            if kind == "number" and at < n and (code[at].isalnum() or code[at] == "_"):
                out.append(ERROR)
            out.append("l")
        elif kind == "op":
            out.append(ops[text] or ERROR)
        elif kind in ("open", "close"):
            out.append(text)
        elif kind == "directive":
            if not DIRECTIVE.match(text.strip().replace("\\\n", " ")):
                out.append(ERROR)
        else:
            out.append(ERROR)
    if go and out and out[-1] in _GO_ENDS:
        out.append(";")
    return out


def _javascript(code: str, at: int, language: str, out: list[str], inner: bool) -> int:
    """JavaScript from ``at``; within a template up to the brace that closes the expression."""
    scan, words, ops = _scanner(language).match, KEYWORDS[language], _CLASS[language]
    members = TS_MEMBER_WORDS if language == "typescript" else MEMBER_WORDS
    n, line = len(code), False
    stack: list[tuple[str, bool]] = []  # bracket and whether it is the head of a for
    importing = False
    while at < n:
        last = out[-1] if out else ""
        if code[at] == "/" and last not in _OPERAND_ENDS and (m := _REGEX.match(code, at)):
            out.append("l")
            at = m.end()
            line = False
            continue
        if code[at] == "/" and last in (")", "}") and line and (m := _REGEX.match(code, at)):
            out.append("l")
            at = m.end()
            line = False
            continue
        m = scan(code, at)
        if m is None:
            out.append(ERROR)
            at += 1
            continue
        kind, text = m.lastgroup, m[0]
        if kind in ("space", "comment", "line"):
            line |= "\n" in text
            at = m.end()
            continue
        if inner and text == "}" and not stack:
            return at
        at = m.end()
        c = ""
        if kind == "word":
            c = words.get(text, "i")
            ahead = code[at : at + 80]
            if last == "." or (c != "i" and re.match(r"\s*:(?!:)", ahead) and last in ("{", ",") and c not in "ld"):
                c = "i"
            elif text == "of" and stack and stack[-1][1] and last in ("i", "]", "}"):
                c = "N"
            elif text == "from" and importing and last in ("i", "}") and re.match(r"\s*[\"']", ahead):
                c = "f"
            elif text == "as" and (last in ("i", "l", ")", "]", "}", "x", "d") and not line) and (language == "typescript" or importing) and re.match(r"\s*[\w${\[(\"'<]", ahead):
                c = "N"
            elif language == "typescript" and text in ("is", "satisfies") and last in ("i", "l", ")", "]", "}", ">") and not line and re.match(r"\s+[\w${\[(\"'<]", ahead):
                c = "N"
            elif language == "typescript" and text in ("keyof", "infer", "unique", "asserts") and re.match(r"\s+\w", ahead):
                c = "a"
            elif c == "A" and not re.match(r"[ \t]*(?:[\w$(*\[]|function)", ahead):
                c = "i"
            elif c == "M" and re.match(r"\s*[(.]", ahead):
                c = "i"
            elif text in members and last in ("{", ";", "}", "m", "(", ",", "@", "e", "d", ")", "A") and re.match(r"\s*(?:[\w$\[\"'#]|\*|\{)", ahead) and not re.match(r"\s*(?:in|of|instanceof|as)\b", ahead) and (last not in (")", "(", ",") or language == "typescript"):
                c = "m"
            elif text in members and not last and re.match(r"\s+(?:class|const|function|let|var|enum|interface|module|namespace|type)\b", ahead):
                c = "m"
            elif language == "typescript" and text in ("interface", "namespace", "module") and last in ("", ";", "}", "e", "d", "m") and re.match(r"\s+[\w$\"']", ahead):
                c = "Q"
            elif language == "typescript" and text == "type" and last in ("", ";", "}", "e", "m", "M") and re.match(r"\s+[\w${*]", ahead) and not re.match(r"\s+from\b", ahead):
                c = "H"
            elif language == "typescript" and text in ("void", "null", "undefined") and last in (":", "b", "<", "G", ","):
                c = "i" if text == "void" else "l"
            elif c == "z" and not inner and re.match(r"\s*[:=,)]", ahead):
                c = "i"
            if c in ("M", "e"):
                importing = True
        elif kind in ("text", "number"):
            c = "l"
            if kind == "number" and at < n and (code[at].isalnum() or code[at] in "_$"):
                c = ERROR
        elif kind == "op":
            c = ops[text]
            if text == "@" and (name := re.compile(r"[\w$.]+").match(code, at)):
                at = name.end()  # a decorator is one token with its name
            if text == "#":
                private = re.compile(WORD).match(code, at)
                c = "i" if private and text != "" and not re.match(r"include\b|define\b", private[0]) else ERROR
                at = private.end() if private else at
        elif kind == "open":
            stack.append((text, text == "(" and last == "L" or text == "(" and out[-2:] == ["L", "a"]))
            c = text
        elif kind == "close":
            if stack:
                stack.pop()
            c = text
        elif kind == "template":
            if line and last in _JS_ENDS and last != "}" and False:
                out.append(";")
            out.append("l")
            while True:
                at = _TEMPLATE.match(code, at).end()
                if at >= n:
                    out.append(ERROR)
                    return at
                if code[at] == "`":
                    at += 1
                    break
                out += ["s", "("]
                at = _javascript(code, at + 2, language, out, True)
                if at >= n:
                    out.append(ERROR)
                    return at
                out += [")", "s", "l"]
                at += 1
            line = False
            continue
        else:
            c = ERROR
        if line and c in _JS_STARTS and last in _JS_ENDS and last != "}" and (not stack or stack[-1][0] == "{") and not (last == ")" and _headed(out)):
            out.append(";")
            importing = c in ("M", "e")
        if c == ";":
            importing = False
        out.append(c)
        line = False
    return at


def _headed(out: list[str]) -> bool:
    """Whether the round bracket that just closed belongs to if, for or while."""
    depth = 0
    for k in range(len(out) - 1, -1, -1):
        if out[k] == ")":
            depth += 1
        elif out[k] == "(":
            depth -= 1
            if not depth:
                return k > 0 and out[k - 1] in "ILWa"
    return False


def _python(code: str) -> list[str]:
    out: list[str] = []
    scan, words, ops = _scanner("python").match, KEYWORDS["python"], _CLASS["python"]
    at, n, depth = 0, len(code), 0
    indents, fresh = [0], True
    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(code, at)
            rest = code[m.end() : m.end() + 1]
            if rest in ("", "\n", "#") or (rest == "\\" and code[m.end() : m.end() + 2] == "\\\n"):
                pass  # lines without code do not indent
            else:
                width = len(m[0].expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    out.append("\x01")
                while width < indents[-1]:
                    indents.pop()
                    out.append("\x02")
                if width != indents[-1]:
                    out.append(ERROR)
                    indents.append(width)
                    out.append("\x01")
            at = m.end()
            fresh = False
            if at >= n:
                break
        m = scan(code, at)
        if m is None:
            out.append(ERROR)
            at += 1
            continue
        kind, text = m.lastgroup, m[0]
        at = m.end()
        if kind in ("space", "comment", "join"):
            continue
        if kind == "line":
            if not depth:
                if out and out[-1] not in ("Z", "\x01", "\x02"):
                    out.append("Z")
                fresh = True
            continue
        if kind == "word":
            c = words.get(text, "i")
            if text in ("match", "case", "type") and (not out or out[-1] in ("Z", "\x01", "\x02")):
                stop = code.find("\n", at)
                rest = code[at : stop if stop >= 0 else n].split("#")[0].rstrip()
                if text == "type" and re.match(r"\s+\w+\s*(?:\[[^\]]*\])?\s*=", rest):
                    c = "O"
                elif text != "type" and rest.endswith(":") and re.match(r"\s*[\w(\[{\"'-]", rest) and not re.match(r"\s*:", rest):
                    c = "H"
            out.append(c)
        elif kind == "text":
            out.append('"')
        elif kind == "number":
            if at < n and (code[at].isalnum() or code[at] == "_") and not re.match(r"(?:if|else|or|and|in|is|for)\b", code[at : at + 5]):
                out.append(ERROR)
            if re.fullmatch(r"0\d*[1-9]\d*", text.replace("_", "")):
                out.append(ERROR)
            out.append("l")
        elif kind == "op":
            out.append(ops[text])
        elif kind == "open":
            depth += 1
            out.append(text)
        elif kind == "close":
            depth = max(0, depth - 1)
            out.append(text)
        else:
            out.append(ERROR)
    if out and out[-1] not in ("Z", "\x01", "\x02"):
        out.append("Z")
    out += ["\x02"] * (len(indents) - 1)
    return out
