"""References to records that do not exist.

Parents are range-partitioned by (table, key); each range is stored as one row of sorted arrays. The first keys of the ranges, one in
``RANGE_ROWS`` parents, tell each reference its range; batches of references to a range are then looked up in its arrays by vectorised
binary search. A range that many references fall into (one parent named by a third of all rows) is probed in several
batches, each beside a copy of that range's arrays; the copies are bounded by ``range_rows``.

Defined results
---------------
* A reference is made by a key that is not null and not blank after trimming; keys compare without case,
  surrounding blanks and braces.
* It holds when a parent row with that key exists whose ``valid_from`` is not after the reference's time
  and whose ``valid_to`` is null or after it. Parents without key or ``valid_from`` hold nothing; a reference
  without a time cannot be shown to hold and is an orphan.
* Repeated rows on either side change nothing; a reference is (id, field).
* Empty tables: no references give no orphans; no parents make every reference an orphan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions.text import plain_key
from oreline.session import cut_lineage

RANGE_ROWS = 20_000
BATCH_ROWS = 50_000
FAR_FUTURE = 2**62


def references(rows: DataFrame, fields: dict[str, str], id_col: str = "id", at_col: str = "created_at") -> DataFrame:
    """(ref_id, ref_field, ref_table, key, at) for each key field of ``rows`` that names something."""
    named = F.array(*(F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("ref_table"), plain_key(f).alias("key")) for f, t in fields.items()))
    return (
        rows.select(F.col(id_col).alias("ref_id"), F.unix_micros(F.col(at_col).cast("timestamp")).alias("at"), F.explode(named).alias("r"))
        .select("ref_id", "r.ref_field", "r.ref_table", "r.key", "at").where(F.col("key").isNotNull())
    )


def parents(rows: DataFrame, name: str, id_col: str = "id", from_col: str = "created_at", to_col: str | None = None) -> DataFrame:
    """(ref_table, key, valid_from, valid_to): for each key and end the earliest beginning."""
    end = F.unix_micros(F.col(to_col).cast("timestamp")) if to_col else F.lit(None).cast("long")
    return (
        rows.select(F.lit(name).alias("ref_table"), plain_key(id_col).alias("key"), F.unix_micros(F.col(from_col).cast("timestamp")).alias("valid_from"), F.coalesce(end, F.lit(FAR_FUTURE)).alias("valid_to"))
        .where(F.col("key").isNotNull() & F.col("valid_from").isNotNull())
        .groupBy("ref_table", "key", "valid_to").agg(F.min("valid_from").alias("valid_from"))
    )


STORED = "rng int, low string, names array<string>, begins array<bigint>, ends array<bigint>"


def _name() -> Column:
    """Table and key as one text, in whose order ranges are cut."""
    return F.concat("ref_table", F.lit("\0"), "key")


def stored_ranges(held: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(rng, low, names, begins, ends): one row per range of about ``range_rows`` parents, sorted by name; all rows of a key are in one range."""
    ranges = max(1, -(-held.count() // range_rows))
    rows = held.select(_name().alias("name"), "valid_from", "valid_to").repartitionByRange(ranges, "name").sortWithinPartitions("name").withColumn("rng", F.spark_partition_id())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if parts:
            p = pd.concat(parts)
            yield pd.DataFrame({"rng": p["rng"].iloc[:1], "low": p["name"].iloc[:1], "names": [p["name"].to_numpy(object)], "begins": [p["valid_from"].to_numpy(np.int64)], "ends": [p["valid_to"].to_numpy(np.int64)]})

    return cut_lineage(rows.mapInPandas(pack, STORED))


def probe(refs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The references of one batch that hold against no parent of the range."""
    if not len(held):
        return refs[["ref_id", "ref_field", "ref_table", "at"]]
    names, begin, end = (np.asarray(held[c].iloc[0], t) for c, t in (("names", object), ("begins", np.int64), ("ends", np.int64)))
    wanted = refs["name"].to_numpy(object)
    known = refs["at"].notna().to_numpy()
    at = refs["at"].fillna(0).to_numpy(np.int64)
    low, high = np.searchsorted(names, wanted, "left"), np.searchsorted(names, wanted, "right")
    holds = np.zeros(len(refs), bool)
    step = 0
    while True:  # as many turns as one key has parent rows
        left = np.flatnonzero((low + step < high) & ~holds & known)
        if not len(left):
            break
        k = low[left] + step
        holds[left] = (begin[k] <= at[left]) & (end[k] > at[left])
        step += 1
    return refs.loc[~holds, ["ref_id", "ref_field", "ref_table", "at"]]


def orphans(refs: DataFrame, held: DataFrame, range_rows: int = RANGE_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(ref_id, ref_field, ref_table, at) of the references without a live parent, each once."""
    stored = stored_ranges(cut_lineage(held), range_rows)
    first = sorted((r.low, r.rng) for r in stored.select("low", "rng").collect())  # one key a range
    shared = refs.sparkSession.sparkContext.broadcast((np.array([x[0] for x in first], object), np.array([x[1] for x in first], np.int32)))

    @F.pandas_udf("int")
    def range_of(name: pd.Series) -> pd.Series:
        lows, number = shared.value
        k = np.searchsorted(lows, name.to_numpy(object), "right") - 1  # names before the first range have no parent
        return pd.Series(number[np.maximum(k, 0)] if len(lows) else np.zeros(len(name), np.int32))

    refs = refs.withColumn("name", _name()).withColumn("rng", range_of("name"))
    hot = refs.groupBy("rng").count().where(F.col("count") > batch_rows).select("rng", F.ceil(F.col("count") / batch_rows).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    batches = refs.join(hot, "rng", "left").withColumn("part", F.pmod(F.xxhash64("ref_id", "ref_field"), parts.cast("long")).cast("int"))
    arrays = stored.join(hot, "rng", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    left = batches.select("rng", "part", "ref_id", "ref_field", "ref_table", "name", "at")
    right = arrays.select("rng", "part", "names", "begins", "ends")
    schema = f"ref_id {dict(refs.dtypes)['ref_id']}, ref_field string, ref_table string, at bigint"
    missed = left.groupBy("rng", "part").cogroup(right.groupBy("rng", "part")).applyInPandas(probe, schema)
    return missed.distinct()


def orphan_report(refs: DataFrame, missed: DataFrame) -> DataFrame:
    """Per referenced table and month of the reference: references, orphans and their rate."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month")
    every = refs.select("ref_table", month, F.xxhash64("ref_id", "ref_field").alias("r")).distinct().groupBy("ref_table", "month").agg(F.count(F.lit(1)).alias("n_refs"))
    bad = missed.select("ref_table", month).groupBy("ref_table", "month").agg(F.count(F.lit(1)).alias("n_orphans"))
    same = [F.col("e.ref_table") == F.col("b.ref_table"), F.col("e.month").eqNullSafe(F.col("b.month"))]
    return every.alias("e").join(bad.alias("b"), same, "left").select(
        "e.ref_table", "e.month", "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"),
        F.round(F.coalesce("n_orphans", F.lit(0)) / F.col("n_refs"), 6).alias("rate"),
    )
