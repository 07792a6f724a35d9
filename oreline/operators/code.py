"""Line-level analyses of source text: rules, taint, data flow and control flow.

Texts are exploded to lines once; rules are unrolled into one projection of built-in predicates, so matching runs inside generated code.
Only lines with hits go on. Straight-line data flow has closed forms (windows per file and variable) in place of
fixpoint loops, and pairs of sources and sinks are formed inside one file's short arrays of hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.operators import rules


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line); null texts have no lines."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def rule_hits(src: DataFrame, key: str, table=rules.LINE_RULES) -> DataFrame:
    """One row for every rule and line it matches, with the first match's offset."""
    hits = F.array(*(F.when(F.col("line").rlike("(?i)" + p), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"), (F.regexp_instr("line", F.lit("(?i)" + p)) - 1).alias("col"))) for i, s, c, p in table))
    return src.select(key, "line_no", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "line_no", "h.*")


def typed_hits(src: DataFrame, key: str, table) -> DataFrame:
    """(key, line_no, type) of every type whose patterns match a line, each type once a line."""
    by_type: dict[str, list[str]] = {}
    for t, p in table:
        by_type.setdefault(t, []).append(p)
    any_of = lambda ps: F.greatest(*(F.col("line").rlike(p) for p in ps)) if len(ps) > 1 else F.col("line").rlike(ps[0])
    hits = F.array(*(F.when(any_of(ps), F.lit(t)) for t, ps in by_type.items()))
    return src.select(key, "line_no", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("type"))


def redact(text: Column, table=rules.SECRETS, mask: str = "***REDACTED***") -> tuple[Column, Column]:
    """The text after all patterns in order, and the number of replacements."""
    n: Column = F.lit(0)
    for _, p in table:
        n = n + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, mask)
    return text, n


def injection_score(text: Column) -> Column:
    """Sum of the weights of the injection patterns found."""
    out: Column = F.lit(0)
    for _, w, p in rules.INJECTIONS:
        out = out + F.when(text.rlike("(?i)" + p), w).otherwise(0)
    return out


# What reads as a name, an assignment, a head of a declaration, a parameter list and a branch.
IDENT = r"\b([A-Za-z_$][\w$]*)\b"
ASSIGN = r"\b([A-Za-z_$][\w$]*)\s*=(?!=)"
HEADER = r"^\s*(function|class|interface|type|enum|namespace|module|export\s+function|export\s+class)"


def definitions(src: DataFrame, key: str) -> DataFrame:
    """(key, line_no, var): the variables a line assigns."""
    names = F.when(F.col("line").rlike(HEADER), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("line", F.lit(ASSIGN), F.lit(1)))
    return src.select(key, "line_no", F.explode(F.array_distinct(names)).alias("var")).where(~F.col("var").isin(*rules.NOT_VARIABLES))


def uses(src: DataFrame, key: str) -> DataFrame:
    """(key, line_no, var): the other names a line mentions."""
    defs = F.when(F.col("line").rlike(HEADER), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("line", F.lit(ASSIGN), F.lit(1)))
    names = F.array_except(F.regexp_extract_all("line", F.lit(IDENT), F.lit(1)), defs)
    return src.select(key, "line_no", F.explode(names).alias("var")).where(~F.col("var").isin(*rules.NOT_VARIABLES))


def flow_events(src: DataFrame, key: str) -> DataFrame:
    """Definitions and uses as (key, var, line_no, is_def)."""
    return definitions(src, key).withColumn("is_def", F.lit(True)).unionByName(uses(src, key).withColumn("is_def", F.lit(False)))


def def_use_chains(events: DataFrame, key: str) -> DataFrame:
    """For each use the line of the nearest earlier definition of its variable, null where there is none."""
    w = Window.partitionBy(key, "var").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    near = F.max(F.when(F.col("is_def"), F.col("line_no"))).over(w)
    return events.withColumn("def_line", near).where("not is_def").select(key, "var", F.col("line_no").alias("use_line"), "def_line")


def dead_stores(events: DataFrame, key: str) -> DataFrame:
    """Definitions whose variable is defined again, or never used, before any use."""
    w = Window.partitionBy(key, "var").orderBy("line_no").rangeBetween(1, Window.unboundedFollowing)
    use, new = F.min(F.when(~F.col("is_def"), F.col("line_no"))).over(w), F.min(F.when(F.col("is_def"), F.col("line_no"))).over(w)
    return events.withColumn("u", use).withColumn("d", new).where("is_def and (u is null or u > d)").select(key, "var", "line_no")


def live_variables(events: DataFrame, key: str) -> DataFrame:
    """(key, line_no, var): variables whose next event from a line on is a use, at the lines that mention any of the file's events
    of that variable."""
    w = Window.partitionBy(key, "var").orderBy("line_no").rangeBetween(0, Window.unboundedFollowing)
    use, new = F.min(F.when(~F.col("is_def"), F.col("line_no"))).over(w), F.min(F.when(F.col("is_def"), F.col("line_no"))).over(w)
    return events.withColumn("u", use).withColumn("d", new).where("u is not null and (d is null or u <= d)").select(key, "line_no", "var").distinct()


BRANCH = r"\b(if|else|for|while|do|switch|case|return|throw|break|continue)\b"


def basic_blocks(src: DataFrame, key: str) -> DataFrame:
    """(key, block, start_line, end_line, terminator): leaders by the lines before, blocks by a running sum."""
    w = Window.partitionBy(key).orderBy("line_no")
    prev = F.lag("line").over(w)
    closes = F.trim(prev).rlike(r"^\s*[\}\]]?\s*[\}\]]?\s*$") & F.col("line").rlike(r"^\s*[^\s\}\]]")
    jumps = prev.rlike(BRANCH) & ~prev.rlike(r"^\s*(\}|\)|;?\s*$)")
    heads = prev.rlike(BRANCH) & prev.rlike(r"\b(if|for|while|case|default)\b")
    leader = prev.isNull() | closes | jumps | heads
    t = F.trim("line")
    end = F.when(t.rlike(r"^return\b"), "return").when(t.rlike(r"^throw\b"), "throw").when(t.rlike(r"^continue\b"), "continue").when(t.rlike(r"^break\b"), "break").when(t.rlike(r"\b(if|else\s+if|for|while|switch)\b"), "branch").otherwise("fallthrough")
    kind = F.when(t.rlike(r"\bif\b"), "if").when(t.rlike(r"\b(for|while)\b"), "loop").otherwise("other")
    numbered = src.withColumn("leader", leader).withColumn("block", F.sum(F.col("leader").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("e", end).withColumn("k", kind)
    last = F.max(F.struct("line_no", "e", "k"))
    return numbered.groupBy(key, "block").agg(F.min("line_no").alias("start_line"), last.alias("last")).select(key, "block", "start_line", F.col("last.line_no").alias("end_line"), F.col("last.e").alias("terminator"), F.col("last.k").alias("kind"))


def block_edges(blocks: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, edge): edges between blocks, named by their first lines."""
    w = Window.partitionBy(key).orderBy("start_line")
    one, two = F.lead("start_line", 1).over(w), F.lead("start_line", 2).over(w)
    edge = lambda a, b, k: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("src"), b.alias("dst"), F.lit(k).alias("edge")))
    here = F.col("start_line")
    branch = F.when(F.col("kind") == "if", F.array(edge(here, F.col("one"), "branch_true"), edge(here, F.col("two"), "branch_false")))
    branch = branch.when(F.col("kind") == "loop", F.array(edge(here, F.col("one"), "branch_true"), edge(F.col("one"), here, "loop_back"), edge(here, F.col("two"), "branch_false"))).otherwise(F.array(edge(here, F.col("one"), "unconditional")))
    t = F.col("terminator")
    out = F.when(t.isin("return", "throw"), F.array(edge(F.lit(None).cast("int"), here, "none"))).when(t.isin("continue", "break"), F.array(edge(here, F.col("one"), "unconditional"))).when(t == "branch", branch).otherwise(F.array(edge(here, F.col("one"), "fallthrough")))
    return blocks.withColumn("one", one).withColumn("two", two).select(key, F.explode(F.filter(out, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


VARIABLE = r"\b([A-Za-z_$][\w$]*)\s*=(?!=)"
PARAMETER = r"function\s+\w+\s*\(([^)]*)\)"


def taint_marks(src: DataFrame, key: str) -> DataFrame:
    """Lines with sources, sinks or sanitizers: (key, line_no, var, sources, sinks, cleans) with arrays of (ordinal, confidence)."""
    found = lambda t: F.filter(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("o"), F.lit(kind).alias("type"), F.lit(c).alias("c"))) for k, (kind, p, c) in enumerate(t))), lambda x: x.isNotNull())
    param = F.element_at(F.split(F.trim(F.element_at(F.split(F.regexp_extract("line", PARAMETER, 1), ","), 1)), r"\s+"), 1)
    var = F.coalesce(F.nullif(F.regexp_extract("line", VARIABLE, 1), F.lit("")), F.when(F.col("line").rlike(PARAMETER), param))
    marked = src.select(key, "line_no", var.alias("var"), found(rules.SOURCES).alias("sources"), found(rules.SINKS).alias("sinks"), found(rules.SANITIZERS).alias("cleans"))
    return marked.where((F.size("sources") + F.size("sinks") + F.size("cleans")) > 0)


def taint_paths(marks: DataFrame, key: str, reach: int = 200, limit: int = 50) -> DataFrame:
    """(key, source_line, sink_line, source_type, sink_type, confidence, distance): sinks up to ``reach`` lines after a source, the first ``limit``
    of a file in the order of lines and rules; confidence falls with the sanitizers between that share the sink's variable."""
    m = marks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "var", "sources", "sinks", "cleans"))).alias("m"))
    each = lambda f: F.flatten(F.transform("m", lambda x: F.transform(x[f], lambda y: F.struct(x["line_no"].alias("line"), x["var"].alias("var"), y["o"].alias("o"), y["type"].alias("type"), y["c"].alias("c")))))
    m = m.select(key, each("sources").alias("so"), each("sinks").alias("si"), each("cleans").alias("sa")).where("size(so) > 0 and size(si) > 0")

    def path(s: Column, k: Column) -> Column:
        between = F.filter("sa", lambda x: (x["line"] > s["line"]) & (x["line"] < k["line"]) & x["var"].eqNullSafe(k["var"]))
        cut = F.least(F.lit(0.95), F.aggregate(between, F.lit(0.0), lambda a, x: a + x["c"]))
        conf = F.greatest(F.lit(0.1), s["c"] * k["c"] * (1 - cut))
        return F.struct(s["line"].alias("source_line"), k["line"].alias("sink_line"), s["type"].alias("source_type"), k["type"].alias("sink_type"), conf.alias("confidence"), (k["line"] - s["line"]).alias("distance"))

    after = lambda s: F.filter("si", lambda k: (k["line"] > s["line"]) & (k["line"] - s["line"] <= reach))
    paths = F.slice(F.flatten(F.transform("so", lambda s: F.transform(after(s), lambda k: path(s, k)))), 1, limit)
    return m.select(key, F.explode(paths).alias("p")).select(key, "p.*")


def sink_confidence(marks: DataFrame, key: str) -> DataFrame:
    """(key, line_no, confidence) of sink lines after a source: the nearest source's last rule, the line's first sink, decay by distance."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.size("sources") > 0, F.struct(F.col("line_no").alias("line"), F.element_at("sources", -1)["c"].alias("c"))), True).over(w)
    cut = F.least(F.lit(0.95), F.aggregate("cleans", F.lit(0.0), lambda a, x: a + x["c"]))
    rows = marks.withColumn("near", near).where("size(sinks) > 0 and near is not null")
    conf = F.col("near.c") * F.element_at("sinks", 1)["c"] * F.exp(-(F.col("line_no") - F.col("near.line")) / 50) * (1 - cut)
    return rows.select(key, "line_no", F.greatest(F.lit(0.1), conf).alias("confidence"))


def nesting(src: DataFrame, key: str) -> DataFrame:
    """(key, deepest, deepest_floored): greatest running sum of braces, as it is and never below 0."""
    step = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cum = src.withColumn("cum", F.sum(step).over(w))
    floored = cum.withColumn("low", F.least(F.lit(0), F.min("cum").over(w)))
    return floored.groupBy(key).agg(F.greatest(F.lit(0), F.max("cum")).alias("deepest"), F.max(F.col("cum") - F.col("low")).alias("deepest_floored"))


def context_overlap(src: DataFrame, key: str, reach: int = 3) -> DataFrame:
    """(key, line_no, overlap): Jaccard similarity of a line's names with those of the lines around it."""
    toks = F.transform(F.regexp_extract_all("line", F.lit(IDENT), F.lit(1)), F.lower)
    w = Window.partitionBy(key).orderBy("line_no")
    both = src.withColumn("toks", toks)
    near = F.concat(F.coalesce(F.flatten(F.collect_list("toks").over(w.rowsBetween(-reach, -1))), F.array()), F.coalesce(F.flatten(F.collect_list("toks").over(w.rowsBetween(1, reach))), F.array()))
    both = both.withColumn("near", near)
    union = F.size(F.array_union("toks", "near"))
    return both.select(key, "line_no", F.when((F.size("toks") > 0) & (F.size("near") > 0), F.size(F.array_intersect("toks", "near")) / union).otherwise(0.0).alias("overlap"))
