"""The line a detection of a whole function or text most likely speaks of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords of rules, keywords that parts of a detection's name stand for, and what reads like input.
RULE_KEYWORDS = {
    "INJ-001": ("query", "execute", "exec", "raw", "sql", "cursor", "prepare"), "INJ-002": ("exec", "system", "popen", "spawn", "execSync", "execFile", "shell"),
    "INJ-005": ("innerHTML", "outerHTML", "document.write", "eval", "Function"), "INJ-006": ("open", "readFile", "writeFile", "include", "require", "fopen", "createReadStream"),
    "AUTH-002": ("password", "secret", "api_key", "token", "credential", "private_key"), "AUTH-005": ("jwt", "verify", "decode", "sign", "JsonWebToken"),
    "CRYPTO-001": ("md5", "sha1", "des", "rc4", "createCipher", "createHash"), "CRYPTO-002": ("Math.random", "random"), "MEM-001": ("strcpy", "sprintf", "gets", "strcat", "scanf"),
    "MEM-002": ("free", "delete", "realloc"),
}
NAME_KEYWORDS = (
    (("sql",), ("query", "execute", "sql")), (("command", "cmd"), ("exec", "system", "spawn")), (("xss", "script"), ("innerHTML", "eval", "document.write")),
    (("path", "traversal"), ("open", "read", "write", "include")), (("password", "credential"), ("password", "secret", "token")), (("crypto", "hash"), ("md5", "sha1", "encrypt", "hash")),
    (("buffer", "overflow"), ("strcpy", "sprintf", "malloc")),
)
OTHER_KEYWORDS = ("unsafe", "dangerous", "vulnerable")
INPUT = r"(?i)request|input|user|params|query|body|formData|argv|args"
ASSIGNED = r"(\w+)\s*[=+]=\s*(.*)"
SINK_LINES = (("89", r"(?i)\b(query|execute|exec|sql)\b"), ("78", r"(?i)\b(exec|system|spawn|popen)\b"))


def _words(xs: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(x.lower()) for x in xs))


def keywords(rule: Column, name: Column) -> Column:
    """Keywords of a rule, else those its name stands for, else the general ones; in lower case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    inferred = F.concat(*(F.when(sum(((F.contains(low, F.lit(p))).cast("int") for p in parts), F.lit(0)) > 0, _words(ks)).otherwise(F.array().cast("array<string>")) for parts, ks in NAME_KEYWORDS))
    out = F.when(F.size(inferred) > 0, inferred).otherwise(_words(OTHER_KEYWORDS))
    for r, ks in RULE_KEYWORDS.items():
        out = F.when(rule == r, _words(ks)).otherwise(out)
    return out


def locate(detections: DataFrame, key: str, window: int = 3) -> DataFrame:
    """(key, start_line, end_line, confidence, how) of detections (key, rule, name, cwes, confidence, text): the best scored line (the first of equal ones) and up to
    ``window`` lines around it; else the first line that reads like the weakness's sink (confidence times .7); else the first three lines (times .5). Null texts have
    no line."""
    base = detections.where("text is not null").select(key, keywords(F.col("rule"), F.col("name")).alias("k"), F.coalesce("cwes", F.array().cast("array<string>")).alias("cwes"), F.col("confidence").alias("c"), F.split("text", "\n", -1).alias("l"))
    rows = base.select(key, "k", "cwes", "c", F.size("l").alias("n"), F.posexplode("l").alias("p", "line"))
    held = lambda text: F.size(F.filter("k", lambda k: F.contains(F.lower(text), k)))
    score = held(F.col("line")) * 0.2 + F.when(F.col("line").rlike(INPUT), 0.1).otherwise(0.0) + held(F.regexp_extract("line", ASSIGNED, 2)) * 0.15
    sink = F.lit(False)
    for part, pattern in SINK_LINES:
        sink = sink | (F.exists("cwes", lambda x: F.contains(F.coalesce(x, F.lit("")), F.lit(part))) & F.col("line").rlike(pattern))  # noqa: B023
    scored = rows.withColumn("s", F.round(score, 6)).withColumn("line_no", F.col("p") + 1)
    best = scored.groupBy(key).agg(
        F.max(F.when(F.col("s") > 0, F.struct("s", (-F.col("line_no")).alias("m")))).alias("b"), F.min(F.when(sink, F.col("line_no"))).alias("sink"), F.first("n").alias("n"), F.first("c").alias("c"),
    )
    at = -F.col("b.m")
    start = F.when(F.col("b").isNotNull(), F.greatest(F.lit(1), at - window)).otherwise(F.coalesce("sink", F.lit(1)))
    end = F.when(F.col("b").isNotNull(), F.least(F.col("n"), at + window)).otherwise(F.coalesce("sink", F.least(F.col("n"), F.lit(3))))
    conf = F.when(F.col("b").isNotNull(), F.least(F.lit(1.0), F.col("c") + F.col("b.s"))).when(F.col("sink").isNotNull(), F.col("c") * 0.7).otherwise(F.col("c") * 0.5)
    how = F.when(F.col("b").isNotNull(), "scored").when(F.col("sink").isNotNull(), "sink").otherwise("whole")
    return best.select(key, start.alias("start_line"), end.alias("end_line"), conf.alias("confidence"), how.alias("how"))
