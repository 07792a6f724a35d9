"""Audit hash chains and sequential limits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0"


def payload(prev: Column, fields: list[str]) -> Column:
    """The text that a chain entry's hash is taken of; nulls are empty."""
    return F.concat_ws("|", prev, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields))


def append_chain(entries: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The entries with prev_hash and hash, chained per key in the given order. Inherently sequential within a key: keys run in parallel."""
    kinds = dict(entries.dtypes)
    names = list(dict.fromkeys([key, order, *fields]))
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", prev_hash string, hash string"

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        prev, prevs, hashes = GENESIS, [], []
        for row in pdf[fields].astype(object).where(pdf[fields].notna(), None).itertuples(index=False):
            prevs.append(prev)
            prev = hashlib.sha256("|".join([prev, *("" if v is None else str(v) for v in row)]).encode()).hexdigest()
            hashes.append(prev)
        return pdf.assign(prev_hash=prevs, hash=hashes)[[*names, "prev_hash", "hash"]]

    return entries.select(*names).groupBy(key).applyInPandas(chain, schema)


def broken_links(chain: DataFrame, key: str, order: str, fields: list[str] | None = None, genesis: str = GENESIS) -> DataFrame:
    """(key, order, place) of the entries whose link or, where ``fields`` are given, whose content does not hold; a missing hash is a break. Verification is
    parallel: each entry is checked against its predecessor's stored hash."""
    w = Window.partitionBy(key).orderBy(order)
    expected = F.lag("hash", 1, genesis).over(w)
    rows = chain.withColumn("place", F.row_number().over(w) - 1).withColumn("expected", expected)
    ok = F.col("prev_hash").eqNullSafe(F.col("expected")) & F.col("hash").isNotNull()
    if fields:
        ok = ok & (F.col("hash") == F.sha2(payload(F.col("prev_hash"), fields), 256))
    return rows.where(~F.coalesce(ok, F.lit(False))).select(key, order, "place")


def limited(calls: DataFrame, key: str, order: str, amount: str, limit: float) -> DataFrame:
    """The calls with ``accepted``: a call that would take the key's total of accepted amounts over the limit is refused and does not count. Order dependent,
    so sequential within a key."""
    kinds = dict(calls.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        total, ok = 0.0, []
        for x in pdf[amount].fillna(0).tolist():
            ok.append(total + x <= limit)
            total += x if ok[-1] else 0
        return pdf.assign(accepted=ok)

    names = [key, order, amount]
    return calls.select(*names).groupBy(key).applyInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", accepted boolean")
