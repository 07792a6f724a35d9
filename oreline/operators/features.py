"""Per-entity feature table from events.

Events are first reduced to a compact long table, one row per entity and event type, and only that
table is pivoted, with an explicit type list. The first shuffle is keyed by (entity, type, request), so
an entity that holds a third of all events is spread over all tasks; the second moves partial sums only.

Defined results
---------------
* An event is usable when its time is a real date and time and neither entity nor type is null or blank.
* A request id is one event, however often it was delivered: the delivery received last gives the cost
  (null costs count only where no delivery has one; a full tie goes to the larger cost), the latest
  readable time gives ``ts``.
* Rows without a request id cannot be told apart: they count no event, add no cost, but their time counts.
* An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions.text import parse_instant, strip
from oreline.session import cut_lineage

#: Event types that get columns of their own where no list is given; rarer ones are summed in ``*_other``. A width needs a bound.
MAX_TYPES = 2_000
#: Names of the totals in the pivot; no event type starts so.
ALL, OTHER = "\0all", "\0other"


def usable_events(events: DataFrame) -> DataFrame:
    """(entity, event_type, request_id, at, received_at, cost, tokens) of the usable rows."""
    kind = F.lower(strip("capability"))
    return events.select(
        F.col("scan_id").alias("entity"),
        kind.alias("event_type"),
        "request_id",
        parse_instant("ts").alias("at"),
        "received_at",
        F.col("cost_usd").alias("cost"),
        (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("tokens"),
    ).where(F.col("at").isNotNull() & (strip("entity") != "") & (F.col("event_type") != ""))


def features_long(events: DataFrame) -> DataFrame:
    """One row per entity and event type: n_events, last_at, cost, tokens."""
    latest = F.struct(F.col("cost").isNotNull().alias("known"), "received_at", "cost", "tokens")
    once = usable_events(events).groupBy("entity", "event_type", "request_id").agg(
        F.max("at").alias("at"), F.max(latest).alias("d")
    )
    counted = F.col("request_id").isNotNull()
    return once.groupBy("entity", "event_type").agg(
        F.count("request_id").alias("n_events"),
        F.max("at").alias("last_at"),
        F.coalesce(F.sum(F.when(counted, F.col("d.cost"))), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum(F.when(counted, F.col("d.tokens"))), F.lit(0)).alias("tokens"),
    )


def column_name(event_type: str) -> str:
    """A column name for an event type: letters, digits and ``_`` only."""
    return "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else "_" for ch in event_type)


def features_wide(long: DataFrame, types: Sequence[str] | None = None, as_of: str | None = None) -> DataFrame:
    """One row per entity; for each type ``n_<type>``, ``cost_<type>`` and ``age_<type>`` (seconds from the
    type's latest event to ``as_of``), then the same over all types and over those outside ``types``.

    ``types`` is the explicit list to pivot; where it is not given it is read from the compact table: the types that most entities
    have, up to ``MAX_TYPES`` (ties in the order of names). ``as_of`` is an ISO time, else the latest event. Counts of absent types
    are 0, their ages null. Nothing is dropped: types outside the list are summed in ``*_other``.
    """
    if types is None or as_of is None:
        long = cut_lineage(long)
    if types is None:
        usual = long.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(MAX_TYPES)
        types = sorted(r[0] for r in usual.collect())
    names = {}
    for t in types:
        name = column_name(t)
        while name in names.values():
            name += "_"
        names[t] = name
    now = F.lit(as_of).cast("timestamp") if as_of else F.lit(long.agg(F.max("last_at")).first()[0]).cast("timestamp")
    age: Column = (F.unix_micros(now) - F.unix_micros("last_at")) / 1e6
    listed = F.col("event_type").isin(*types) if types else F.lit(False)
    kinds = F.array(F.when(listed, F.col("event_type")).otherwise(OTHER), F.lit(ALL))
    compact = long.select("entity", "n_events", "cost", age.alias("age"), F.explode(kinds).alias("kind"))
    wide = compact.groupBy("entity").pivot("kind", [ALL, *types, OTHER]).agg(
        F.sum("n_events").alias("n"), F.sum("cost").alias("cost"), F.min("age").alias("age")
    )
    out = [F.col("entity").alias("scan_id")]
    for t, name in ((ALL, "all"), *names.items(), (OTHER, "other")):
        out += [
            F.coalesce(F.col(f"`{t}_n`"), F.lit(0)).alias(f"n_{name}"),
            F.coalesce(F.col(f"`{t}_cost`"), F.lit(0.0)).alias(f"cost_{name}"),
            F.col(f"`{t}_age`").alias(f"age_{name}"),
        ]
    return wide.select(*out)
