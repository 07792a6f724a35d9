"""Further queries: definitions, embeddings, as-of joins, graphs and distances, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import code, graph, vectors
from oreline.plans import analytics
from oreline.plans import code as code_plans
from oreline.session import table

def txt_t17_definitions(spark: SparkSession, d: str) -> DataFrame:
    return code.definitions(code_plans._code_lines(spark, d), "id").groupBy("id", "var").agg(F.count(F.lit(1)).alias("n_lines"))


def set_u3_jaccard(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda t: t != ""))
    a, b = words("title"), words("description")
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return table(spark, d, "raw_findings").select("raw_id", F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(both / every, 6)).otherwise(0.0).alias("similarity"))


def txt_t22_embedding(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hash_embedding(table(spark, d, "eval_items"), "item_id", "text").select("item_id", "bucket", F.round("weight", 5).alias("weight"))


def join_j15_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return vectors.as_of(clicks, e.where("event_type = 'error'").select("user_id", "ts", "value"), ["user_id"], "ts", ["value"]).select("event_id", F.col("value_as_of").alias("last_error"))


def graph_g7_strong(spark: SparkSession, d: str) -> DataFrame:
    return graph.strongly_connected(analytics._steps(spark, d))


def graph_g10_shortest(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(analytics._steps(spark, d), spark.createDataFrame([("click",)], "id string")).select("dst", "hops")


def graph_g27_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return analytics._steps(spark, d).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("targets"))


def stat_m4_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    m = o.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c")).first()
    det = m.vx * m.vy - m.c * m.c
    dx, dy = F.col("x") - m.mx, F.col("y") - m.my
    return o.select("p_partkey", F.round(F.sqrt((dx * dx * m.vy - 2 * dx * dy * m.c + dy * dy * m.vx) / det), 5).alias("distance")).where("distance > 2")


QUERIES = {f.__name__: f for f in (txt_t17_definitions, set_u3_jaccard, txt_t22_embedding, join_j15_as_of, graph_g7_strong, graph_g10_shortest, graph_g27_adjacency, stat_m4_mahalanobis)}

_WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '\W+'), lambda t: t <> ''))"
_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(t, ''), lambda c: ord(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"

SQL = {
    "txt_t17_definitions": f"WITH {code_plans._EVENTS} SELECT id, var, count(*) AS n_lines FROM ev WHERE is_def GROUP BY 1, 2",
    "set_u3_jaccard": f"WITH w AS (SELECT raw_id, {_WORDS.format('title')} AS a, {_WORDS.format('description')} AS b FROM raw_findings) SELECT raw_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 6) ELSE 0 END AS similarity FROM w",
    "txt_t22_embedding": rf"WITH t AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\W+'), lambda x: x <> '')) AS t FROM eval_items WHERE text IS NOT NULL), n AS (SELECT item_id, t, count(*) AS n FROM t GROUP BY 1, 2), h AS (SELECT item_id, n, {_FNV} AS h FROM n), p AS (SELECT item_id, h % 128 AS bucket, n::double AS w FROM h UNION ALL SELECT item_id, xor(h >> 16, h & 65535) % 128, n * 0.5 FROM h), s AS (SELECT item_id, bucket, sum(w) AS w FROM p GROUP BY 1, 2) SELECT item_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 5) AS weight FROM s",
    "join_j15_as_of": "SELECT c.event_id, e.value AS last_error FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'error') e ON c.user_id = e.user_id AND c.ts > e.ts",
    "graph_g7_strong": f"WITH RECURSIVE {analytics._STEPS}, s AS (SELECT DISTINCT src, dst FROM e), c AS (SELECT src, dst FROM s UNION SELECT c.src, s.dst FROM c JOIN s ON s.src = c.dst), n AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)), r AS (SELECT src, count(*) AS k FROM c WHERE src <> dst GROUP BY 1) SELECT count(*) FILTER (WHERE k = n - 1) = any_value(n) AS strongly_connected FROM r, n",
    "graph_g10_shortest": f"WITH RECURSIVE {analytics._DISTINCT}, c AS (SELECT dst, 1 AS hops FROM s WHERE src = 'click' UNION SELECT s.dst, hops + 1 FROM c JOIN s ON s.src = c.dst WHERE hops < 6) SELECT dst, min(hops) AS hops FROM c GROUP BY 1",
    "graph_g27_adjacency": f"WITH {analytics._STEPS} SELECT src, string_agg(dst, ',' ORDER BY dst) AS targets FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1",
    "stat_m4_mahalanobis": "WITH m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS vx, var_samp(p_retailprice) AS vy, covar_samp(p_size, p_retailprice) AS c FROM part), q AS (SELECT p_partkey, round(sqrt(((p_size - mx) * (p_size - mx) * vy - 2 * (p_size - mx) * (p_retailprice - my) * c + (p_retailprice - my) * (p_retailprice - my) * vx) / (vx * vy - c * c)), 5) AS distance FROM part, m) SELECT * FROM q WHERE distance > 2",
}
