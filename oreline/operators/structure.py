"""Call graphs, program graphs, dominators and metrics of source texts, file by file.

Everything but dominators is joins and windows keyed by file. Dominators, loops and frontiers are found per file over its own
blocks (one group a file, whose size is the file's), in parallel over files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.operators import rules

#: What begins a function, and what reads like a call but is none.
FUNCTION = r"\b(?:def|function|func)\s+([A-Za-z_]\w*)"
CALL = r"\b([A-Za-z_]\w*)\s*\("
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "func", "def", "sizeof", "elif", "and", "or", "not", "in", "print")
ENTRY = r"(?i)^(?:handle|on[A-Z_]|main|get|post|put|delete|patch|run|process|execute|dispatch)"


def functions(src: DataFrame, key: str) -> DataFrame:
    """(key, name, line_no): the functions a file defines; of equal names the last one holds."""
    name = F.nullif(F.regexp_extract("line", FUNCTION, 1), F.lit(""))
    return src.select(key, "line_no", name.alias("name")).where("name is not null").groupBy(key, "name").agg(F.max("line_no").alias("line_no"))


def call_edges(src: DataFrame, key: str) -> DataFrame:
    """(key, caller, callee, n_calls): calls of a file's own functions, from the function that begins last before the line ('global' before the first)."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.nullif(F.regexp_extract("line", FUNCTION, 1), F.lit(""))
    scoped = src.select(key, "line", F.coalesce(F.last(begun, True).over(w), F.lit("global")).alias("caller"), begun.alias("begun"))
    names = scoped.select(key, "caller", "begun", F.explode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))).alias("callee"))
    names = names.where(~F.col("callee").isin(*NO_CALLS) & ~F.coalesce(F.col("begun") == F.col("callee"), F.lit(False)))
    return names.join(functions(src, key).select(key, F.col("name").alias("callee")), [key, "callee"], "left_semi").groupBy(key, "caller", "callee").agg(F.count(F.lit(1)).alias("n_calls"))


def entry_points(src: DataFrame, key: str) -> DataFrame:
    """(key, name, line_no): functions that nothing in their file calls, or that are named like handlers."""
    called = call_edges(src, key).where("caller <> callee").select(key, F.col("callee").alias("name")).distinct().withColumn("called", F.lit(True))
    return functions(src, key).join(called, [key, "name"], "left").where(F.col("called").isNull() | F.col("name").rlike(ENTRY)).select(key, "name", "line_no")


def program_edges(blocks: DataFrame, events: DataFrame, src: DataFrame, key: str, edges, chains) -> DataFrame:
    """(key, kind, n): edges of a program graph by kind: control flow between blocks, definitions to uses, calls."""
    kinds = edges.select(key, F.lit("CFG").alias("kind"), F.lit(1).alias("n"))
    kinds = kinds.unionByName(chains.where("def_line is not null").select(key, F.lit("DFG").alias("kind"), F.lit(1).alias("n")))
    kinds = kinds.unionByName(call_edges(src, key).select(key, F.lit("CALL").alias("kind"), F.col("n_calls").cast("int").alias("n")))
    return kinds.groupBy(key, "kind").agg(F.sum("n").alias("n"))


def reaching_definitions(events: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """(key, var, def_line, from_line, to_line): the lines a definition reaches in straight-line code: from the next one to that of the variable's next
    definition (which still sees it), or to the file's last line. ``last`` has (key, n_lines)."""
    w = Window.partitionBy(key, "var").orderBy("line_no")
    defs = events.where("is_def").select(key, "var", "line_no").distinct().withColumn("to_line", F.lead("line_no").over(w))
    out = defs.join(last, key).select(key, "var", F.col("line_no").alias("def_line"), (F.col("line_no") + 1).alias("from_line"), F.coalesce("to_line", "n_lines").cast("int").alias("to_line"))
    return out.where("from_line <= to_line")


def used_lines(chains: DataFrame, key: str) -> DataFrame:
    """(key, line_no, n_vars, n_defined, nearest): the variables a line uses, how many of them are defined before, and the nearest such line."""
    return chains.groupBy(key, F.col("use_line").alias("line_no")).agg(F.count(F.lit(1)).alias("n_vars"), F.count("def_line").alias("n_defined"), F.max("def_line").alias("nearest"))


def code_metrics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, loc, functions, depth, decisions, anomaly): lines, function heads, depth of braces, decisions + 1, and the anomaly score: four metrics cannot differ
    from their mean by the threshold of 2.5 deviations, so that it is always .2."""
    from oreline.operators.finding_text import count, deepest_floored

    c = F.col(text)
    decisions = count(c, r"\b(if|for|while|case|catch|elif|except)\b") + 1
    return texts.where(c.isNotNull()).select(key, F.size(F.split(c, "\n", -1)).alias("loc"), count(c, FUNCTION).alias("functions"), deepest_floored(c).alias("depth"), decisions.alias("decisions"), F.lit(0.2).alias("anomaly"))


def nodes_with_edges(nodes: DataFrame, edges: DataFrame, key: str, kind: str, value: str) -> DataFrame:
    """(key, node, n_in, n_out): the nodes of one kind with the number of edges in and out."""
    mine = nodes.where(F.col(kind) == value).select(key, F.col("start_line").alias("node"))
    ends = edges.select(key, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select(key, "e.*")
    n = ends.groupBy(key, "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return mine.join(n, [key, "node"], "left").select(key, "node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def dominators(nodes: list[int], edges: list[tuple[int, int]], entry: int) -> dict[int, int | None]:
    """The immediate dominator of each node that the entry reaches; the entry itself has none."""
    succ: dict[int, list[int]] = {}
    pred: dict[int, list[int]] = {}
    for a, b in edges:
        succ.setdefault(a, []).append(b)
        pred.setdefault(b, []).append(a)
    order, seen, stack = [], {entry}, [(entry, iter(succ.get(entry, ())))]
    while stack:
        node, rest = stack[-1]
        nxt = next((x for x in rest if x not in seen), None)
        if nxt is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(nxt)
            stack.append((nxt, iter(succ.get(nxt, ()))))
    place = {n: k for k, n in enumerate(order)}  # post order: the entry is last
    idom: dict[int, int] = {entry: entry}
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            new = None
            for p in pred.get(n, ()):
                if p not in idom:
                    continue
                if new is None:
                    new = p
                    continue
                a, b = p, new
                while a != b:  # up to the common dominator
                    while place[a] < place[b]:
                        a = idom[a]
                    while place[b] < place[a]:
                        b = idom[b]
                new = a
            if new is not None and idom.get(n) != new:
                idom[n], changed = new, True
    return {n: (None if n == entry else d) for n, d in idom.items()}


def _dominates(idom: dict[int, int | None], a: int, b: int | None) -> bool:
    while b is not None:
        if a == b:
            return True
        b = idom.get(b)
    return False


FLOW = "block int, idom int, loop_depth int, n_frontier int, reachable boolean"


def flow_structure(blocks: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, block, idom, loop_depth, n_frontier, reachable) of every block, named by its first line: its immediate dominator, the number of natural loops it is in
    (back edges lead to a dominator), the size of its dominance frontier, and whether the first block leads to it."""

    def run(b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(int(x) for x in b["start_line"])
        pairs = sorted({(int(s), int(t)) for s, t in zip(e["src"], e["dst"])})
        idom = dominators(nodes, pairs, nodes[0]) if nodes else {}
        pred: dict[int, list[int]] = {}
        for s, t in pairs:
            pred.setdefault(t, []).append(s)
        depth, frontier = dict.fromkeys(nodes, 0), {n: set() for n in nodes}
        loops: dict[int, set[int]] = {}
        for s, t in pairs:
            if s in idom and t in idom and _dominates(idom, t, s):  # a back edge: the loop is what reaches it without the head
                body, todo = loops.setdefault(t, {t}), [s]
                while todo:
                    x = todo.pop()
                    if x not in body and x in idom:
                        body.add(x)
                        todo += pred.get(x, [])
        for body in loops.values():
            for x in body:
                depth[x] += 1
        for n in idom:
            froms = [p for p in pred.get(n, ()) if p in idom]
            if len(froms) > 1:
                for p in froms:
                    while p is not None and p != idom[n]:
                        frontier[p].add(n)
                        p = idom[p]
        held = b[key].iloc[0] if len(b) else None
        rows = [(held, n, idom.get(n), depth[n], len(frontier[n]), n in idom) for n in nodes]
        out = pd.DataFrame(rows, columns=[key, "block", "idom", "loop_depth", "n_frontier", "reachable"])
        return out.astype({"idom": "Int64"})

    kind = dict(blocks.dtypes)[key]
    return blocks.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(run, f"{key} {kind}, {FLOW}").where("block is not null")


def text_matches(texts: DataFrame, key: str, text: str, table=rules.WEAK_RULES) -> DataFrame:
    """(key, type, line_no, name): all matches of patterns over whole texts, also those that span lines, with the line they begin on."""
    import re
    from bisect import bisect_right

    def run(batches):
        known = [(t, re.compile(p)) for t, p in table]
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key].tolist(), pdf[text].tolist()):
                ends = [m.start() for m in re.finditer("\n", x)]
                rows += [(k, t, bisect_right(ends, m.start() - 1) + 1, m[0]) for t, p in known for m in p.finditer(x)]
            yield pd.DataFrame(rows, columns=[key, "type", "line_no", "name"])

    kind = dict(texts.dtypes)[key]
    return texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, type string, line_no int, name string")
