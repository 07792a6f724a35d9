"""Graph analytics over edge tables (src, dst); repeated edges are kept unless an operator says otherwise.

Iterative operators run a driver loop over declarative steps; every round is written to the shared checkpoint folder, so plans stay
short and a lost executor costs one round. Frontiers, not whole closures, are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.session import cut_lineage


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): least node of each weakly connected component, by label propagation with pointer jumping."""
    both = edges.where("src is not null and dst is not null").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes_of(edges).withColumn("component", F.col("id")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(new.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, n_in, n_out): edges that touch a node (a loop counts once), that enter and that leave it."""
    touch = F.array_distinct(F.array("src", "dst"))
    return edges.select("src", "dst", F.explode(touch).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("dst") == F.col("id")).alias("n_in"), F.count_if(F.col("src") == F.col("id")).alias("n_out"))


def junctions(edges: DataFrame) -> DataFrame:
    """(id, kind, ratio): stable junctions have two or more edges in and out, unstable ones two or more in and one out."""
    kind = F.when((F.col("n_in") >= 2) & (F.col("n_out") >= 2), "stable").when((F.col("n_in") >= 2) & (F.col("n_out") == 1), "unstable")
    return degrees(edges).select("id", kind.alias("kind"), (F.col("n_in") / F.greatest("n_out", F.lit(1))).alias("ratio")).where("kind is not null")


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, every: int = 10) -> DataFrame:
    """(id, rank) after a fixed number of rounds; parallel edges weigh, dangling rank is not handed on."""
    weights = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut_lineage(weights.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    nodes = cut_lineage(nodes_of(edges))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(1, iterations + 1):
        got = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % every == 0:
            ranks = cut_lineage(ranks)
    return ranks


def closure(edges: DataFrame, starts: DataFrame | None = None, max_rounds: int = 1_000) -> DataFrame:
    """(src, dst, hops): pairs joined by a path of one or more edges and its least length; from ``starts`` (id) only where given. A node
    reaches itself only over a cycle."""
    step = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    first = step if starts is None else step.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    frontier = seen = cut_lineage(first.withColumn("hops", F.lit(1)))
    for hops in range(2, max_rounds):
        nxt = frontier.select("src", F.col("dst").alias("mid")).join(step.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        frontier = cut_lineage(nxt.join(seen, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if hops % 10 == 0:
            seen = cut_lineage(seen)
    raise RuntimeError("the closure did not end")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(strongly_connected): whether every node reaches every other: one node reaches all, and all reach it. Two searches, no closure of all pairs. True without
    nodes."""
    spark, nodes = edges.sparkSession, cut_lineage(nodes_of(edges))
    n, first = nodes.count(), nodes.agg(F.min("id")).first()[0]
    if not n:
        return spark.createDataFrame([(True,)], "strongly_connected boolean")
    start = nodes.where(F.col("id") == first)
    whole = all(levels(e, start).count() == n for e in (edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return spark.createDataFrame([(whole,)], "strongly_connected boolean")


def levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, level): breadth-first levels from several starts, which have level 0."""
    start = starts.select("id").distinct()
    found = closure(edges, start).groupBy(F.col("dst").alias("id")).agg(F.min("hops").alias("level"))
    return found.join(start, "id", "left_anti").unionByName(start.withColumn("level", F.lit(0)))


def simple_paths(edges: DataFrame, starts: DataFrame, max_nodes: int = 10) -> DataFrame:
    """(path): simple paths of two up to ``max_nodes`` nodes from the starts. Their number can grow exponentially: for small graphs."""
    step = edges.select("src", "dst").distinct()
    now = starts.select(F.array("id").alias("path"), F.col("id").alias("last"))
    out = None
    for _ in range(max_nodes - 1):
        now = cut_lineage(now.join(step, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")))
        if now.isEmpty():
            break
        out = now.select("path") if out is None else out.unionByName(now.select("path"))
    return out if out is not None else now.select("path")


def crossing(edges: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """Edges between two sets of nodes (id), in either direction."""
    a, b = one.select(F.col("id").alias("a")), other.select(F.col("id").alias("b"))
    there = edges.join(a, F.col("src") == F.col("a"), "left_semi").join(b, F.col("dst") == F.col("b"), "left_semi")
    back = edges.join(b, F.col("src") == F.col("b"), "left_semi").join(a, F.col("dst") == F.col("a"), "left_semi")
    return there.unionByName(back)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    a = nodes.select(F.col("id").alias("a"))
    return edges.join(a, F.col("src") == F.col("a"), "left_semi").join(a.withColumnRenamed("a", "b"), F.col("dst") == F.col("b"), "left_semi")
