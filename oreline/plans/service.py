"""The service's filters, look-ups and reports built from the operators of the relational layer. Their SQL, in ``plans.relational``, is written apart from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import relational as R
from oreline.plans.relational import NOW, _usage
from oreline.session import table


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _latest(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The newest row of each id, reduced to the columns that are read."""
    rest = [c for c in ("updated_at", "status", "created_at") if c not in columns]
    df = table(spark, d, name).select("id", *columns, *rest)
    return R.latest_rows(df, order="updated_at").select("id", *columns)


def _findings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _latest(spark, d, "findings", *columns)


def _rank(c: str = "severity") -> Column:
    return R.severity_rank(c)


def sel_p01_filter(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d, "tenant_id", "severity", "status", "project_id")
    tenant = f.agg(F.max("tenant_id")).first()[0]
    return R.where_all(f, {"tenant_id": tenant, "severity": ["critical", "high"], "status": "open", "project_id": None}).select("id", "severity", "status")


def sel_p02_ilike(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d, "title", "file_path")
    return R.contains_text(f, ["title"], "redirect").unionByName(R.contains_text(f, ["file_path"], "session")).select("id").distinct()


def sel_p03_membership(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d, "rule_id", "status", "engines")
    return f.where(~F.col("status").isin("fixed", "false_positive") & F.array_contains("engines", "semgrep")).select("id", "rule_id")


def sel_p05_not_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d, "projects", "name", "deleted_at").where("deleted_at is null").select("id", "name")


def sel_p06_default(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d, "projects", "default_branch").select("id", F.coalesce("default_branch", F.lit("main")).alias("branch"))


def sel_p07_rank(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "severity").select("id", _rank().alias("sev_rank"))


def sel_p09_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "severity").where(_rank() >= _rank_of("high")).select("id")


def _rank_of(name: str) -> Column:
    return R.severity_rank(F.lit(name))


def sel_p10_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.lower("confidence")
    score = F.when(c == "high", 0.9).when(c == "medium", 0.6).when(c == "low", 0.3).otherwise(0.0)
    return table(spark, d, "raw_findings").where(score >= 0.6).select("raw_id")


def join_j01_dimensions(spark: SparkSession, d: str) -> DataFrame:
    p = _latest(spark, d, "projects", "name").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return _findings(spark, d, "project_id", "severity").join(p, "project_id").select("id", "project_name", "severity", _rank().alias("sev_rank"))


def join_j02_detail(spark: SparkSession, d: str) -> DataFrame:
    p = _latest(spark, d, "projects", "slug").select(F.col("id").alias("project_id"), "slug")
    s = _latest(spark, d, "scan_runs", "project_id", "trigger_type").select(F.col("id").alias("scan_run_id"), "project_id", "trigger_type")
    return _findings(spark, d, "project_id", "scan_run_id", "rule_id").join(p, "project_id").join(s, ["scan_run_id", "project_id"]).select("id", "slug", "trigger_type", "rule_id")


def join_j03_left_default(spark: SparkSession, d: str) -> DataFrame:
    s = _latest(spark, d, "scan_runs", "customer_id").select(F.col("id").alias("scan_id"), "customer_id")
    per = _usage(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))  # a scan with a third of all events is one row before the join
    return per.join(s, "scan_id", "left").groupBy(F.coalesce("customer_id", F.lit("Provider-direct")).alias("customer")).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


def join_j04_lateral_counts(spark: SparkSession, d: str) -> DataFrame:
    n = R.counts_by(_latest(spark, d, "poc_runs", "project_id", "exploit_proven"), ["project_id"], {"proven": F.col("exploit_proven")})
    p = _latest(spark, d, "projects").select(F.col("id").alias("project_id"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return p.join(n, "project_id", "left").select(F.col("project_id").alias("id"), zero("total").alias("poc_total"), zero("proven").alias("poc_proven"))


def join_j05_latest(spark: SparkSession, d: str) -> DataFrame:
    s = _latest(spark, d, "scan_runs", "project_id", "status", "created_at")
    first = R.first_per(s.where("project_id is not null"), ["project_id"], [F.col("created_at").desc(), F.col("id")])
    p = _latest(spark, d, "projects").select(F.col("id").alias("project_id"))
    return p.join(first.select("project_id", F.col("id").alias("run_id"), F.col("status").alias("run_status")), "project_id", "left").withColumnRenamed("project_id", "id")


def join_j06_scalars(spark: SparkSession, d: str) -> DataFrame:
    n = _latest(spark, d, "scan_runs", "project_id", "created_at").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_runs"), F.max("created_at").alias("last"))
    p = _latest(spark, d, "projects").select(F.col("id").alias("project_id"))
    return p.join(n, "project_id", "left").select(F.col("project_id").alias("id"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.unix_micros("last").alias("last_us"))


def join_j07_exists(spark: SparkSession, d: str) -> DataFrame:
    proven = _latest(spark, d, "poc_runs", "finding_id", "exploit_proven").where("exploit_proven").select(F.col("finding_id").alias("id")).distinct().withColumn("there", F.lit(True))
    return _findings(spark, d).join(proven, "id", "left").select("id", F.col("there").isNotNull().alias("proven"))


def _places(spark: SparkSession, d: str, engine: str) -> DataFrame:
    return table(spark, d, "raw_findings").where(F.col("engine") == engine).select("file_path", "start_line", F.lower("rule_id").alias("rule")).distinct()


def join_j10_baseline(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d, "semgrep").join(_places(spark, d, "dfg"), ["file_path", "start_line", "rule"], "left_anti")


def join_j11_visible(spark: SparkSession, d: str) -> DataFrame:
    key = ["scan_run_id", "rule", "file_path", "start_line"]
    raw = table(spark, d, "raw_findings").select("scan_run_id", F.lower("rule_id").alias("rule"), "file_path", "start_line").distinct()
    f = _findings(spark, d, "scan_run_id", "rule_id", "file_path", "start_line", "status").withColumnRenamed("rule_id", "rule").drop("id")
    return raw.join(f, key, "left").select(*key, F.coalesce("status", F.lit("open")).alias("status")).where(F.col("status").isin("open", "confirmed"))


def join_j12_verification(spark: SparkSession, d: str) -> DataFrame:
    v = R.first_per(_latest(spark, d, "poc_runs", "finding_id", "exploit_proven", "created_at").where("finding_id is not null"), ["finding_id"], [F.col("created_at").desc(), F.col("id").desc()])
    rows = _findings(spark, d).join(v.select(F.col("finding_id").alias("id"), F.col("exploit_proven").alias("p"), F.lit(1).alias("tried")), "id", "left")
    return rows.select("id", F.when(F.col("tried").isNull(), "unverified").when(F.col("p"), "proven").otherwise("refuted").alias("mark"))


def join_j28_two_lefts(spark: SparkSession, d: str) -> DataFrame:
    p = _latest(spark, d, "projects", "name").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    s = _latest(spark, d, "scan_runs", "status").select(F.col("id").alias("scan_run_id"), F.col("status").alias("run_status"))
    return _findings(spark, d, "project_id", "scan_run_id").join(p, "project_id", "left").join(s, "scan_run_id", "left").select("id", "project_name", "run_status")


def join_j31_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = _latest(spark, d, "projects", "slug").select(F.col("id").alias("project_id"), "slug")
    return _latest(spark, d, "targets", "target_type", "project_id").join(p, "project_id", "left").select("id", "target_type", "slug")


def join_j30_newest(spark: SparkSession, d: str) -> DataFrame:
    s = _latest(spark, d, "scan_runs", "project_id", "started_at", "status").where("status = 'done'")
    return R.first_per(s, ["project_id"], [F.col("started_at").desc_nulls_last(), F.col("id")]).select("project_id", "id")


def agg_a01_summary(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d, "customer_id", "project_id", "severity", "status", "created_at")
    cases = {"open_count": F.col("status") == "open", "closed_count": F.col("status").isin("closed", "fixed", "false_positive"), **{s: F.col("severity") == s for s in ("critical", "high", "medium", "low")}}
    key = ["customer_id", "project_id"]
    last = f.groupBy(*key).agg(F.unix_micros(F.max("created_at")).alias("last_us"))
    p = _latest(spark, d, "projects", "name").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    same = F.col("a.customer_id").eqNullSafe(F.col("b.customer_id")) & F.col("a.project_id").eqNullSafe(F.col("b.project_id"))
    return R.counts_by(f, key, cases).alias("a").join(last.alias("b"), same).select("a.*", "last_us").join(p, "project_id")


def agg_a02_pairs(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda status, *sev: (F.col("status") == status) & F.col("severity").isin(*sev)
    cases = {"open_critical": is_("open", "critical"), "open_high": is_("open", "high"), "fixed_severe": is_("fixed", "critical", "high")}
    return R.counts_by(_findings(spark, d, "project_id", "severity", "status"), ["project_id"], cases).drop("total")


def agg_a04_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "severity", "status").groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))


def agg_a06_provider(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def agg_a08_day(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("moment", "yyyy-MM-dd")
    return _usage(spark, d).groupBy(day.alias("day"), F.substring(day, 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def agg_a12_severity(spark: SparkSession, d: str) -> DataFrame:
    s = F.coalesce(F.upper("severity"), F.lit(""))
    return R.counts_by(table(spark, d, "raw_findings"), [], {"critical": s == "CRITICAL", "high": s == "HIGH", "medium": s == "MEDIUM", "low": ~s.isin("CRITICAL", "HIGH", "MEDIUM")}).drop("total")


def agg_a13_statuses(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(s,) for s in ("open", "confirmed", "fixed", "false_positive", "accepted_risk")], "status string")
    n = _findings(spark, d, "status").groupBy("status").agg(F.count(F.lit(1)).alias("k"))
    return names.join(n, "status", "left").select("status", F.coalesce("k", F.lit(0)).alias("n"))


def agg_a24_tenants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").select("tenant_id").distinct()


def agg_a30_grand_total(spark: SparkSession, d: str) -> DataFrame:
    u = _usage(spark, d).where((F.col("moment") >= _now() - F.expr("interval 90 days")) & (F.col("moment") < _now()))
    return u.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def ord_o2_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(_findings(spark, d, "severity", "created_at"), [F.col("created_at").desc(), F.col("id")], 40, 20).select("id", "severity")


def ord_o3_top(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per(table(spark, d, "raw_findings").select("engine", "raw_id", "start_line"), ["engine"], [F.col("start_line").desc_nulls_last(), F.col("raw_id")], 5).select("engine", "raw_id")


def set_u1_keep_first(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select("raw_id", "engine", "scan_run_id", F.lower("rule_id").alias("rule"), "file_path", "start_line")
    known = F.coalesce(F.col("engine").isin("dfg", "semgrep"), F.lit(False))
    sources = [raw.where("engine = 'dfg'"), raw.where("engine = 'semgrep'"), raw.where(~known)]
    return R.union_keep_first(sources, ["scan_run_id", "rule", "file_path", "start_line"], "raw_id").select("raw_id")


def set_u2_last_wins(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select("raw_id", "engine", F.lower("rule_id").alias("rule"))
    return R.first_per(raw, ["rule", "engine"], [F.col("raw_id").desc()]).select("raw_id", "engine")


def set_u4_minus(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select("raw_id", F.lower("rule_id").alias("rule"), "start_line", "file_path", "engine")
    a, b = raw.where("engine = 'dfg'").drop("engine"), raw.where("engine <> 'dfg'").drop("engine")
    return a.unionByName(b.join(a.drop("raw_id"), ["rule", "start_line", "file_path"], "left_anti").select(*a.columns)).select("raw_id")


def win_w2_best(spark: SparkSession, d: str) -> DataFrame:
    c = F.lower("confidence")
    rank = F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)
    raw = table(spark, d, "raw_findings").select("scan_run_id", F.lower("rule_id").alias("rule"), "raw_id", rank.alias("r"))
    return R.first_per(raw, ["scan_run_id", "rule"], [F.col("r").desc(), F.col("raw_id")]).drop("r")


def win_w3_best_two_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.lower("confidence")
    rank = F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    f = _findings(spark, d, "project_id", "file_path", "confidence", "severity").withColumn("r", rank).withColumn("s", _rank())
    return R.first_per(f, ["project_id", "file_path"], [F.col("r").desc(), F.col("s").desc(), F.col("id")]).select("project_id", "file_path", "id")


def win_w4_keep_first(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select("scan_run_id", "file_path", "start_line", "raw_id")
    return raw.groupBy("scan_run_id", "file_path", "start_line").agg(F.min("raw_id").alias("raw_id")).select("raw_id")


QUERIES = {f.__name__: f for f in (
    sel_p01_filter, sel_p02_ilike, sel_p03_membership, sel_p05_not_deleted, sel_p06_default, sel_p07_rank, sel_p09_threshold, sel_p10_confidence, join_j01_dimensions, join_j02_detail, join_j03_left_default,
    join_j04_lateral_counts, join_j05_latest, join_j06_scalars, join_j07_exists, join_j10_baseline, join_j11_visible, join_j12_verification, join_j28_two_lefts, join_j30_newest, join_j31_lookup, agg_a01_summary, agg_a02_pairs,
    agg_a04_breakdown, agg_a06_provider, agg_a08_day, agg_a12_severity, agg_a13_statuses, agg_a24_tenants, agg_a30_grand_total, ord_o2_page, ord_o3_top, set_u1_keep_first, set_u2_last_wins, set_u4_minus,
    win_w2_best, win_w3_best_two_keys, win_w4_keep_first,
)}
SQL: dict[str, str] = {}
