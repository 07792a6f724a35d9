"""The relational layer: filters, look-ups and reports over the service's tables.

Every function takes and returns DataFrames and stays declarative. Dimensions are joined without hints: Catalyst
and AQE broadcast them when their measured size allows it. Correlated look-ups of the service (lateral joins, scalar
subqueries, per-row queries) are aggregated first and then joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITIES = ("critical", "high", "medium", "low", "info")


def severity_rank(c: Column | str) -> Column:
    """4 critical, 3 high, 2 medium, 1 low, else 0 (declaration order of the service's enumeration)."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(c == "critical", 4).when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def latest_rows(df: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """One row per key: the one with the greatest ``order``, then the greatest of all values. Rows with a null key stay out.
    Reduced on the map side; a key with very many rows is no hot spot."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = F.max(F.struct(order, *rest)).alias("r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "r.*").select(*df.columns)


def where_all(df: DataFrame, conditions: Mapping[str, object | None]) -> DataFrame:
    """Conjunctive filter: a value is an equality, a list a membership, None no condition."""
    for name, value in conditions.items():
        if value is None:
            continue
        df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def contains_text(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows in which any of the columns holds the text, in any case; ``%`` and ``_`` are ordinary characters."""
    plain = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{plain}%"), F.lit(False))
    return df.where(hit)


PROVIDER_ROLES = ("ProviderOwner", "ProviderAdmin", "ProviderEngineer", "ProviderViewer", "SystemBot")


def secured(df: DataFrame, tenant: str | None, customer: str | None = None, role: str | None = None) -> DataFrame:
    """Row security: rows of the tenant, and of the customer unless the role is one of the provider's. Without a well-formed tenant
    no row is seen; the system role sees all rows. Apply it before any other filter: both are pushed to the scan together."""
    if role == "SystemBot":
        return df
    if tenant is None or len(tenant) != 36:
        return df.where(F.lit(False))
    df = df.where(F.col("tenant_id") == tenant)
    if role in PROVIDER_ROLES:
        return df
    if customer is None or len(customer) != 36:
        return df.where(F.lit(False))
    return df.where(F.col("customer_id") == customer)


def counts_by(df: DataFrame, keys: Sequence[str], cases: Mapping[str, Column]) -> DataFrame:
    """Per key group the number of rows and of the rows of each case, 0 where none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in cases.items()))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key group in the order given, which must end in a unique column. Rows beyond the first of a window
    group are dropped while the group is sorted (a window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key group, in an order that ends in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def union_keep_first(frames: Iterable[DataFrame], keys: Sequence[str], ordinal: str) -> DataFrame:
    """Union of sources in their order of trust; the first row of a key is kept."""
    out = None
    for rank, df in enumerate(frames):
        df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_per(out, keys, [F.col("source_rank"), F.col(ordinal)])


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], update: bool = True) -> DataFrame:
    """``ON CONFLICT``: the target with the changes' new keys and, where ``update``, their values for old keys."""
    if update:
        return target.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)
    return target.unionByName(changes.join(target.select(*keys), list(keys), "left_anti"))


def rolling_sum(df: DataFrame, keys: Sequence[str], micros: str, value: str, hours: int, name: str) -> DataFrame:
    """Sum of ``value`` over the hours up to and including each row. Rows are cut into stretches of that length, each seen with the one before it: a key with a third
    of all rows is spread over its time."""
    span = hours * 3_600_000_000
    stretch = F.floor(F.col(micros) / span)
    rows = df.withColumn("_own", stretch).withColumn("_at", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(*keys, "_at").orderBy(micros).rangeBetween(-span, 0)
    return rows.withColumn(name, F.sum(value).over(w)).where("_own = _at").drop("_own", "_at")


def with_totals(df: DataFrame, totals: Mapping[str, str]) -> DataFrame:
    """The rows with the sums over all rows (name: column): one row of partial sums, joined to all, in place of a window over everything."""
    one = df.agg(*(F.sum(c).alias(n) for n, c in totals.items()))
    return df.crossJoin(F.broadcast(one))  # one row
