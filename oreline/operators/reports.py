"""Logs, triage states, coverage and text reports. Texts are built per group of bounded size; nothing unbounded is gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.operators import rules
from oreline.operators.relational import severity_rank

#: Categories of rules by the prefix of their ids; others count as MEM.
CATEGORIES = ("INJ", "AUTH", "CRYPTO", "RACE", "MEM")


def audit_page(events: DataFrame, column: str, action: str, order: Sequence[str], size: int = 100) -> DataFrame:
    """The first ``size`` entries of an action in the log's order (not the last ones)."""
    return events.where(F.col(column) == action).orderBy(*order).limit(size)


def triage_state(rows: DataFrame, key: str, at: str, statuses: Sequence[str]) -> DataFrame:
    """(key, status, by, at): the newest well-formed entry of each key (then the greatest of all values). Entries without key, time or a known status are left
    out; a missing author is 'unknown'."""
    good = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col("status").isin(*statuses))
    held = F.max(F.struct(F.col(at).alias("at"), F.col("status").alias("status"), F.coalesce("by", F.lit("unknown")).alias("by"))).alias("h")
    return good.groupBy(key).agg(held).select(key, "h.status", "h.by", F.col("h.at").alias(at))


def merge_state(state: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """The state after an import: imported entries replace those of the same key."""
    return state.join(imported.select(key), key, "left_anti").unionByName(imported)


def clean_state(state: DataFrame, at: str, now: Column, days: int, statuses: Sequence[str]) -> DataFrame:
    """The state without entries of the given statuses that are ``days`` old or older (inclusive); ``at`` in microseconds."""
    limit = F.unix_micros(now) - days * 86_400_000_000
    return state.where(~(F.col("status").isin(*statuses) & (F.col(at) <= limit)))


def baseline_keys(rows: DataFrame, file: str, line: str, kind: str) -> DataFrame:
    """The different ``file:line:type`` keys of findings; missing parts are empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.concat_ws(":", part(file), part(line), part(kind)).alias("fp")).distinct()


def rule_category(rule: Column) -> Column:
    prefix = F.split_part(rule, F.lit("-"), F.lit(1))
    return F.when(prefix.isin(*CATEGORIES), prefix).otherwise("MEM")


def rule_errors(catalogue: DataFrame) -> DataFrame:
    """(rule_id, errors): what is wrong with the rules (rule_id, severity, confidence, pattern) of a catalogue; an empty array where nothing is."""
    checks = F.array(
        F.when(F.coalesce("rule_id", F.lit("")) == "", "id"), F.when(~F.coalesce("severity", F.lit("")).isin("critical", "high", "medium", "low", "info"), "severity"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"), F.when(F.coalesce("pattern", F.lit("")) == "", "pattern"),
    )
    return catalogue.select("rule_id", F.filter(checks, lambda x: x.isNotNull()).alias("errors"))


def redactions(text: Column, table=rules.SECRETS) -> Column:
    """(type, count) of the secrets that redaction in order would replace, those that occur."""
    out = []
    for name, p in table:
        out.append(F.struct(F.lit(name).alias("type"), F.regexp_count(text, F.lit(p)).alias("count")))
        text = F.regexp_replace(text, p, "***REDACTED***")
    return F.filter(F.array(*out), lambda x: x["count"] > 0)


def security_metrics(entries: DataFrame) -> DataFrame:
    """One row over audit entries (cost, accepted, rejected, injection, limited, redactions): sums, ratios (0 of nothing) and the risk: HIGH where more than
    a tenth of the scans met an injection."""
    n = F.aggregate("redactions", F.lit(0), lambda a, x: a + x["count"])
    s = entries.agg(
        F.count(F.lit(1)).alias("scans"), F.count_if("injection").alias("injections"), F.coalesce(F.sum(n), F.lit(0)).alias("redacted"), F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"), F.count_if("limited").alias("limited"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    risk = F.when(F.col("injections") > F.col("scans") * 0.1, "HIGH").when(F.col("injections") > 0, "MEDIUM").otherwise("LOW")
    return s.withColumn("per_injection", ratio(F.col("accepted"), F.col("injections"))).withColumn("rejection_rate", ratio(F.col("rejected"), F.col("accepted") + F.col("rejected"))).withColumn("risk", risk)


def redactions_by_type(entries: DataFrame) -> DataFrame:
    """(type, count) over all audit entries."""
    return entries.select(F.explode("redactions").alias("r")).groupBy("r.type").agg(F.sum("r.count").alias("count"))


def project_report(rows: DataFrame, key: str, severity: str, title: str, seen: str, ident: str, first: int = 20) -> DataFrame:
    """(key, document): a table of counts by severity and the ``first`` most urgent critical and high findings as a list."""
    r = severity_rank(severity)
    ranked = rows.select(key, r.alias("r"), F.col(title).alias("t"), F.col(seen).alias("seen"), F.col(ident).alias("i"))
    counts = ranked.groupBy(key).agg(F.count_if(F.expr("r = 4")).alias("c"), F.count_if(F.expr("r = 3")).alias("h"), F.count_if(F.expr("r = 2")).alias("m"), F.count_if(F.expr("r < 2")).alias("l"))
    w = Window.partitionBy(key).orderBy(F.desc("r"), F.desc_nulls_last("seen"), "i")
    top = ranked.where("r >= 3").withColumn("place", F.row_number().over(w)).where(F.col("place") <= first)
    line = F.concat(F.lit("\n- ["), F.when(F.col("r") == 4, "critical").otherwise("high"), F.lit("] "), F.coalesce("t", F.lit("")))
    listed = top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))  # at most ``first`` a key
    head = F.format_string("| critical | %d |\n| high | %d |\n| medium | %d |\n| low | %d |", "c", "h", "m", "l")
    same = F.col("a." + key).eqNullSafe(F.col("b." + key))
    return counts.alias("a").join(listed.alias("b"), same, "left").select(F.col("a." + key), F.concat(head, F.coalesce("lines", F.lit(""))).alias("document"))


def usage_line() -> Column:
    """A table line of a usage report from key, events, prompt_tokens, completion_tokens and cost_usd (decimal): separators in thousands, four decimals of cost."""
    n = lambda c: F.format_number(c, 0)
    return F.concat(F.lit("| "), F.col("key"), F.lit(" | "), n("events"), F.lit(" | "), n("prompt_tokens"), F.lit(" | "), n("completion_tokens"), F.lit(" | $"), F.round("cost_usd", 4).cast("decimal(20,4)").cast("string"), F.lit(" |"))


def scan_summary(rows: DataFrame, key: str) -> DataFrame:
    """(key, line): findings, severe ones with their share to one decimal (half up), and sure ones of each key, from (key, r severity rank, c confidence)."""
    s = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("r >= 3")).alias("severe"), F.count_if(F.expr("c = 'high'")).alias("sure"))
    share = (F.floor(F.col("severe") * 1000 / F.col("n") + 0.5) / 10).cast("decimal(9,1)").cast("string")
    return s.select(key, F.concat(F.lit("findings: "), F.col("n"), F.lit(", severe: "), F.col("severe"), F.lit(" ("), share, F.lit("%), sure: "), F.col("sure")).alias("line"))


def skipped_adapters(rows: DataFrame, key: str, engine: str, requested: Sequence[str], supported: Sequence[str]) -> DataFrame:
    """(key, adapter, reason): requested adapters that gave a key nothing, because they are unknown or had no result."""
    held = rows.groupBy(key).agg(F.collect_set(F.when(F.col(engine).isin(*requested), F.col(engine))).alias("held"))  # at most the requested names
    adapter = F.explode(F.array_except(F.array(*map(F.lit, requested)), "held")).alias("adapter")
    return held.select(key, adapter).select(key, "adapter", F.when(F.col("adapter").isin(*supported), "no-result").otherwise("unsupported-adapter").alias("reason"))


def technique_coverage(rows: DataFrame, key: str, technique: str, known: Sequence[str]) -> DataFrame:
    """(key, covered, percent, uncovered): how many of the known techniques a key's rows speak of, and which are left."""
    held = rows.groupBy(key).agg(F.collect_set(F.when(F.col(technique).isin(*known), F.col(technique))).alias("held"))  # at most the known names
    left = F.array_join(F.array_except(F.array(*map(F.lit, sorted(known))), "held"), ",")
    return held.select(key, F.size("held").cast("bigint").alias("covered"), F.round(F.size("held") * 100 / len(known), 2).alias("percent"), left.alias("uncovered"))


def fall_through(nodes: DataFrame, key: str, line: str) -> DataFrame:
    """(key, src, dst): edges from each node to the next one where it stands on the line right after."""
    w = Window.partitionBy(key).orderBy(line)
    return nodes.distinct().withColumn("dst", F.lead(line).over(w)).where(F.col("dst") == F.col(line) + 1).select(key, F.col(line).alias("src"), "dst")
