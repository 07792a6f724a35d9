"""What changed between consecutive full snapshots.

Every snapshot is summarised by invertible Bloom lookup tables, one per hash bucket of its keys. A cell
holds a signed count and XORs of key hash, state digest and check hash; the later snapshot is inserted with
sign +1 and the earlier with -1 in the same aggregation, so that what both hold cancels. Each difference table is peeled; buckets
whose peeling fails are built again with four times the cells, and what still fails after ``MAX_ROUNDS`` is compared in full, so no
difference is ever lost. Recovered hashes are looked up in the snapshots and their digests verified before the keys are classified; a bucket
with a hash that is not found there is compared in full too.

Scale: the findings are moved once, to (project, stretch of runs, bucket); records, cells and tables are all aggregated there, where the
records of consecutive runs meet. A place holds about ``BUCKET_RECORDS`` records of at most ``STRETCH`` runs whatever the size and number of
a project's snapshots, so one with a third of all rows is spread over many places; a peeling task sees cells, never records.

Defined results
---------------
* Snapshots are the runs with status ``done`` and mode ``full`` after the latest row per id (by updated_at;
  equal rows are one), ordered by (started_at, id) within their project; runs without started_at or project have no
  place in that order. The first snapshot of a project has no changes; snapshots without findings count.
* A record is (rule_id in lower case, cleaned file_path); null parts are kept and equal each other. Its state is
  the least and greatest start_line and the highest service severity of its rows.
* Repeated rows change nothing. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.functions.text import clean_path, service_severity_rank
from oreline.session import cut_lineage

BUCKET_RECORDS = 256
STRETCH = 64
HASHES = 3
FIRST_CELLS = 36
GROWTH = 4
MAX_ROUNDS = 4
#: Rows of a few numbers (runs, recovered elements) up to which a table is sent to all tasks.
MAX_BROADCAST = 500_000


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per run id: the one updated last (then the greatest of all values)."""
    rest = [c for c in ("project_id", "status", "incremental_mode", "started_at", "findings_new", "findings_fixed") if c in runs.columns]
    held = F.struct("updated_at", *rest)
    return runs.where("id is not null").groupBy("id").agg(F.max(held).alias("h")).select("id", *(F.col(f"h.{c}").alias(c) for c in rest))


def snapshot_pairs(runs: DataFrame) -> DataFrame:
    """(run_id, project_id, prev_id, next_id) of the finished full runs in their project's order."""
    full = latest_runs(runs).where("status = 'done' and incremental_mode = 'full' and started_at is not null and project_id is not null")
    w = Window.partitionBy("project_id").orderBy("started_at", "id")
    return full.select(F.col("id").alias("run_id"), "project_id", "started_at", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"), *[c for c in ("findings_new", "findings_fixed") if c in full.columns])


def placed_runs(raw: DataFrame, snapshots: DataFrame, first_cells: int = FIRST_CELLS) -> DataFrame:
    """The snapshots, numbered, with the number of buckets of their project, the places (project and stretch of runs) of the pairs they belong to, and the
    size of each pair's tables.

    Findings are counted per run, which bounds the records; only sizes depend on it, never results."""
    sizes = raw.groupBy(F.col("scan_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    w, whole = Window.partitionBy("project_id").orderBy("started_at", "run_id"), Window.partitionBy("project_id")
    counted = snapshots.join(sizes, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    buckets = F.greatest(F.lit(1), F.ceil(F.max("n").over(whole) / BUCKET_RECORDS)).cast("bigint")
    stretch = ((F.row_number().over(w) - 1) / STRETCH).cast("int")
    ordered = counted.withColumn("b", buckets).withColumn("own", F.xxhash64("project_id", stretch)).withColumn("surely", F.abs(F.col("n") - F.lag("n", 1, 0).over(w)) / F.col("b"))
    # the least by which a bucket's tables are likely to differ
    cells = F.when(F.col("surely") > first_cells / 3, F.ceil(F.col("surely") / first_cells * 2) * GROWTH * first_cells).otherwise(first_cells).cast("bigint")
    # short numbers for the runs; the table is written first, so that they hold
    numbered = cut_lineage(ordered.withColumn("own_m", cells)).withColumn("no", F.monotonically_increasing_id())
    lead = lambda c: F.lead(c).over(w)
    return cut_lineage(numbered.select("run_id", "no", F.col("prev_id").isNotNull().alias("follows"), lead("no").alias("next_no"), "b", "own", "own_m", lead("own").alias("next"), lead("own_m").alias("next_m")))


RECORD = ("place", "bucket", "no", "follows", "next_no", "own", "own_m", "next", "next_m", "h", "rule_id", "file_path")


def snapshot_records(raw: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per snapshot, record and stretch of runs, at its place, with key hash ``h`` and state digest ``d``."""
    rows = raw.select(F.col("scan_run_id").alias("run_id"), F.lower("rule_id").alias("rule_id"), clean_path("file_path").alias("file_path"), "start_line", service_severity_rank("severity").alias("sev"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  null differs from ''
    hashed = rows.withColumn("h", F.xxhash64(part("rule_id"), part("file_path")))
    sides = F.filter(F.array_distinct(F.array(F.when(F.col("follows"), F.col("own")), F.col("next"))), lambda x: x.isNotNull())
    there = hashed.join(placed, "run_id").withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(11)), F.col("b"))).withColumn("place", F.explode(sides)).drop("b", "run_id")
    per = there.repartition("place", "bucket").groupBy(*RECORD).agg(F.min("start_line").alias("lo"), F.max("start_line").alias("hi"), F.max("sev").alias("sev"))
    # the digest speaks of the key as well: with h it has 128 bits
    return per.withColumn("d", F.xxhash64(F.coalesce("lo", F.lit(-1)), F.coalesce("hi", F.lit(-1)), "sev", part("file_path"), part("rule_id"))).drop("lo", "hi", "sev")


PLACE = ("place", "bucket", "pair")


def signed_elements(records: DataFrame) -> DataFrame:
    """Each record under its own run with sign +1 and under the next run with sign -1, with the size ``m`` of the pair's tables."""
    sides = F.array(
        F.when(F.col("follows") & (F.col("own") == F.col("place")), F.struct(F.col("no").alias("pair"), F.lit(1).alias("sign"), F.col("own_m").alias("m"))),
        F.when(F.col("next") == F.col("place"), F.struct(F.col("next_no").alias("pair"), F.lit(-1).alias("sign"), F.col("next_m").alias("m"))),
    )
    return records.withColumn("s", F.explode(F.filter(sides, lambda x: x.isNotNull()))).select("place", "bucket", "s.pair", "s.sign", "s.m", "rule_id", "file_path", "h", "d")


def difference_cells(elements: DataFrame) -> DataFrame:
    """Subtracted lookup tables: one row per pair and bucket with its cells that are not zero. ``m`` is the table's number of cells."""
    check = F.xxhash64("h", "d", F.lit(7))
    third = F.expr(f"m div {HASHES}").cast("long")
    places = F.array(*(F.pmod(F.xxhash64("h", "d", F.lit(100 + j)), third) + third * j for j in range(HASHES)))
    cells = elements.select(*PLACE, "m", "sign", "h", "d", check.alias("c"), F.explode(places).alias("cell")).groupBy(*PLACE, "m", "cell").agg(
        F.sum("sign").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c")
    ).where("n != 0 or h != 0 or d != 0 or c != 0")
    return cells.groupBy(*PLACE, "m").agg(F.collect_list(F.struct("cell", "n", "h", "d", "c")).alias("cells"))


def peel(cells: list, places) -> tuple[list[tuple[int, int, int]], bool]:
    """The (key hash, digest, sign) elements of one difference table, and whether it was emptied."""
    table = {x["cell"]: [x["n"], x["h"], x["d"], x["c"]] for x in cells}
    out, todo = [], list(table)
    while todo:
        cell = table.get(todo.pop())
        if cell is None or cell[0] not in (1, -1):
            continue
        n, h, d, c = cell
        at = places(h, d, c)
        if at is None:
            continue
        for k in at:
            other = table.setdefault(k, [0, 0, 0, 0])
            other[0] -= n
            other[1] ^= h
            other[2] ^= d
            other[3] ^= c
            if other == [0, 0, 0, 0]:
                del table[k]
            else:
                todo.append(k)
        out.append((h, d, n))
    return out, not table


MASK = 2**64 - 1
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & MASK


def _avalanche(h: int) -> int:
    h = ((h ^ (h >> 33)) * P2) & MASK
    h = ((h ^ (h >> 29)) * P3) & MASK
    return h ^ (h >> 32)


def _hash_long(v: int, seed: int) -> int:
    h = (seed + P5 + 8) & MASK
    k = (_rotl((v * P2) & MASK, 31) * P1) & MASK
    return _avalanche((_rotl(h ^ k, 27) * P1 + P4) & MASK)


def _hash_int(v: int, seed: int) -> int:
    h = (seed + P5 + 4) & MASK
    h ^= ((v & 0xFFFFFFFF) * P1) & MASK
    return _avalanche((_rotl(h, 23) * P2 + P3) & MASK)


def spark_xxhash64(h: int, d: int, last: int) -> int:
    """``xxhash64(h, d, last)`` of Spark for two longs and an int, as a signed long."""
    x = _hash_int(last, _hash_long(d & MASK, _hash_long(h & MASK, 42)))
    return x - 2**64 if x >= 2**63 else x


PEELED = "place bigint, bucket bigint, pair bigint, h bigint, d bigint, sign int"


def _peel_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for *place, m, cells in pdf.itertuples(index=False):
            third = m // HASHES

            def places(h: int, d: int, c: int, third: int = third):
                if spark_xxhash64(h, d, 7) != c:
                    return None
                return [spark_xxhash64(h, d, 100 + j) % third + third * j for j in range(HASHES)]

            found, emptied = peel(cells, places)
            if emptied:
                rows += [(*place, h, d, n) for h, d, n in found]
            else:
                rows.append((*place, None, None, 0))
        kinds = {"place": "int64", "bucket": "int64", "pair": "int64", "h": "Int64", "d": "Int64", "sign": "int32"}
        yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=t) for k, (c, t) in enumerate(kinds.items())})


def changed_elements(elements: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[int]]:
    """The elements that only one snapshot of a pair holds (place, h, d, sign), and how many tables each round could not empty."""
    found, todo, failures = None, elements, []
    for turn in range(max_rounds):
        peeled = cut_lineage(difference_cells(todo).mapInPandas(_peel_batches, PEELED))
        good = peeled.where("sign != 0")
        found = good if found is None else found.unionByName(good)
        failed = peeled.where("sign = 0").select(*PLACE)
        failures.append(failed.count())
        if not failures[-1]:
            return found, failures
        todo = elements.join(failed, list(PLACE), "left_semi").withColumn("m", F.col("m") * GROWTH ** (turn + 1))
    exact = full_comparison(todo)
    return (exact if found is None else found.unionByName(exact)), failures


def full_comparison(elements: DataFrame) -> DataFrame:
    """The same by plain counting, for the buckets that are left over."""
    return elements.groupBy(*PLACE, "h", "d").agg(F.sum("sign").cast("int").alias("sign")).where("sign != 0")


def _few(rows: DataFrame) -> DataFrame:
    """The rows, to be sent to all tasks where they have been counted and are few; else joins move both sides."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def snapshot_changes(raw: DataFrame, runs: DataFrame, first_cells: int = FIRST_CELLS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(scan_run_id, rule_id, file_path, change_kind) for every pair of consecutive snapshots."""
    placed = _few(placed_runs(raw, snapshot_pairs(runs), first_cells))
    # kept while the tables are built and looked up; what an executor loses is computed again
    records = snapshot_records(raw, placed).persist(StorageLevel.MEMORY_AND_DISK)
    elements = signed_elements(records)
    found, _ = changed_elements(elements, max_rounds)
    held = elements.select(*PLACE, "h", "d", "sign", F.struct("rule_id", "file_path").alias("key"))
    same = [*PLACE, "h", "d", "sign"]
    looked_up = cut_lineage(held.join(_few(found), same))
    if looked_up.count() != found.count():  # a digest that no snapshot holds
        lost = found.join(looked_up, same, "left_anti").select(*PLACE).distinct()
        again = full_comparison(elements.join(lost, list(PLACE), "left_semi")).join(held, same)
        looked_up = cut_lineage(looked_up.join(lost, list(PLACE), "left_anti").unionByName(again))
    records.unpersist()
    plus, minus = F.max(F.col("sign") > 0), F.max(F.col("sign") < 0)
    kind = F.when(plus & minus, "changed").when(plus, "added").otherwise("removed")
    changes = looked_up.groupBy("pair", "key").agg(kind.alias("change_kind"))
    return changes.join(placed.select(F.col("no").alias("pair"), "run_id"), "pair").select(F.col("run_id").alias("scan_run_id"), "key.rule_id", "key.file_path", "change_kind")


def change_counts(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per later snapshot the derived numbers beside the run's own counters."""
    per = changes.groupBy("scan_run_id").agg(*(F.count(F.when(F.col("change_kind") == k, 1)).alias(f"n_{k}") for k in ("added", "removed", "changed")))
    pairs = snapshot_pairs(runs).where("prev_id is not null").select(F.col("run_id").alias("scan_run_id"), "project_id", "findings_new", "findings_fixed")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("added", "removed", "changed")]
    return pairs.join(per, "scan_run_id", "left").select("scan_run_id", "project_id", *zero, "findings_new", "findings_fixed")
