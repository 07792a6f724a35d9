"""One surviving record for each group of duplicate records.

The representative row of a group (``representatives``) is chosen by completeness, time, confidence and id. The surviving
*values* (``survivors``) are chosen field by field with currency reasoning: from all groups with timestamps the engine learns
which value usually follows which; within each group the latest dated value and the undated ones are then ordered by what was learned.
That order is partial: values whose order nobody has seen are not compared. Its topologically latest value survives; where several are
latest, a dated one is preferred, then the one of the most complete row, the one of the more trusted row, and the smaller raw_id.

Scale: rows are first reduced to the distinct value combinations of a group, under a key that spreads a group with a third of all rows over
all tasks. Combinations stay rows; a group gathers only the different undated values of a field. What reaches the driver, and from there every
task, is the table of learned steps between values, without the pairs that follow from them. The fields are learned at every size and for any number of values.

Defined results
---------------
* A group is two or more rows with equal scan_run_id, rule_id (lower case), cleaned file_path and start_line;
  rows where one of these is null belong to no group.
* Not filled: null, an empty array, or a placeholder text (``functions.text.PLACEHOLDERS``).
* Ties end at the smaller raw_id, so the result does not depend on the order of rows. Rows without a raw_id cannot
  be named and stay out. Repeated rows count in ``n_rows`` and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.text import clean_path, filled, filled_array, strip
from oreline.session import cut_lineage

#: Fields with a small vocabulary, whose values follow each other in a learnable order.
CURRENCY_FIELDS = ("engine", "confidence", "severity")
#: No limit: every field is learned, however many values it has. Where a limit is set, a field of more values is no vocabulary: the latest of
#: its values survives (then that of the most complete row, then the longer) and nothing is learned.
MAX_VALUES: int | None = None
KEY = ("scan_run_id", "rule", "path", "start_line")
NEVER = -(2**62)


def keyed(raw: DataFrame) -> DataFrame:
    """The rows that can belong to a group, with the group key and the filled fields counted."""
    fields = [filled(c).cast("int") for c in ("description", "severity", "confidence", "code_snippet")]
    fields += [F.col("end_line").isNotNull().cast("int"), filled_array("cwe_ids").cast("int")]
    total = fields[0]
    for f in fields[1:]:
        total = total + f
    conf = F.lower(strip("confidence"))
    rank = F.when(conf == "high", 3).when(conf == "medium", 2).when(conf == "low", 1).otherwise(0)
    return raw.select(
        "scan_run_id", F.lower("rule_id").alias("rule"), clean_path("file_path").alias("path"), "start_line", "raw_id",
        total.alias("n_filled"), F.unix_micros(F.col("reported_at").cast("timestamp")).alias("at"), rank.alias("conf_rank"),
        F.when(filled("description"), F.col("description")).alias("description"),
        *(F.when(filled(c), F.lower(strip(c))).alias(c) for c in CURRENCY_FIELDS),
    ).where(" and ".join(f"{k} is not null" for k in (*KEY, "raw_id")))


def _preference() -> Column:
    """Rows in the order of preference: complete, recent (missing times last), trusted, smaller raw_id."""
    return F.struct("n_filled", F.coalesce("at", F.lit(NEVER)).alias("t"), "conf_rank", (-F.col("raw_id")).alias("neg"))


def representatives(raw: DataFrame) -> DataFrame:
    """(group_id, best_id, n_rows) of the duplicate groups: one shuffle of numbers and the group's key."""
    grouped = keyed(raw).groupBy(*KEY).agg(F.min("raw_id").alias("group_id"), F.max(_preference()).alias("best"), F.count(F.lit(1)).alias("n_rows"))
    return grouped.where("n_rows > 1").select("group_id", (-F.col("best.neg")).alias("best_id"), "n_rows")


def vocabularies(rows: DataFrame) -> tuple[str, ...]:
    """The currency fields whose order is learned: all, unless a limit is set."""
    if MAX_VALUES is None:
        return CURRENCY_FIELDS
    n = rows.agg(*(F.count_distinct(c).alias(c) for c in CURRENCY_FIELDS)).first()
    return tuple(c for c in CURRENCY_FIELDS if n[c] <= MAX_VALUES)


def combinations(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The combinations of the fields' values in each duplicate group, one row each, with the times they were first and last seen and the best
    row that holds them undated. One of them has the group's ``head``: its key, its representative, its number of rows, and what survives by time."""
    plain = tuple(c for c in (*CURRENCY_FIELDS, "description") if c not in fields)
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("at").isNotNull().alias("dated"), F.col("at").alias("t"), "n_filled", F.length(c).alias("len"), F.col(c).alias("value"))))
    some = rows.groupBy(*KEY, *fields).agg(
        F.min("raw_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max(F.struct(_preference().alias("p"), F.col("engine").alias("engine"))).alias("best"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max(F.when(F.col("at").isNull(), F.struct("n_filled", "conf_rank", (-F.col("raw_id")).alias("neg")))).alias("undated"),
        *(latest(c).alias(f"{c}_latest") for c in plain),
    )
    group = Window.partitionBy(*KEY)
    placed = some.select(
        *KEY, *fields, "best", "first_at", "last_at", "undated", F.row_number().over(group.orderBy(F.desc("best"))).alias("place"),
        F.min("first_id").over(group).alias("group_id"), F.sum("n").over(group).alias("n_rows"), *(F.max(f"{c}_latest").over(group).alias(f"{c}_latest") for c in plain),
    )
    head = F.struct(*KEY, "best", "n_rows", *(F.col(f"{c}_latest")["value"].alias(c) for c in plain))
    return placed.where("n_rows > 1").select("group_id", F.when(F.col("place") == 1, head).alias("head"), "first_at", "last_at", "undated", *fields)


def seen_values(combos: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(group_id, field, value, first_at, last_at, undated): each value of a group once."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields))).alias("e")
    rows = combos.repartition("group_id").select("group_id", each, "first_at", "last_at", "undated").where("e.value is not null")
    return rows.groupBy("group_id", F.col("e.field").alias("field"), F.col("e.value").alias("value")).agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("undated").alias("undated")
    )


def steps(values: DataFrame) -> DataFrame:
    """(field, before, after): ``after`` is the next value first seen after ``before``, at a later time, in more groups than the other way round."""
    group = Window.partitionBy("group_id", "field").orderBy("first_at", "value")
    pairs = values.where("first_at is not null").select("field", F.lag("value").over(group).alias("before"), F.col("value").alias("after"), F.lag("first_at").over(group).alias("since"), "first_at")
    one, other = F.least("before", "after").alias("one"), F.greatest("before", "after").alias("other")
    n = pairs.where("first_at > since").groupBy("field", one, other).agg(F.sum(F.when(F.col("before") < F.col("after"), 1).otherwise(-1)).alias("n"))
    up = F.col("n") > 0
    return n.where("n <> 0").select("field", F.when(up, F.col("one")).otherwise(F.col("other")).alias("before"), F.when(up, F.col("other")).otherwise(F.col("one")).alias("after"))


def precedence(found: Iterable[tuple[str, str, str, int]]) -> dict[tuple[str, str], set[str]]:
    """For each (field, value) the values learned to come after it.

    ``a`` precedes ``b`` when ``b`` was seen next after ``a`` more often than the other way round, and so on over any number of steps. Values
    that precede each other in a circle are not compared: what remains is a strict partial order. This is the definition, written out for all
    pairs; ``Order`` answers for the values of one group."""
    counts = {(f, a, b): n for f, a, b, n in found}
    after: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for (f, a, b), n in counts.items():
        if n > counts.get((f, b, a), 0):
            after.setdefault((f, a), set()).add((f, b))
    reach: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for v in after:
        seen, todo = set(), [v]
        while todo:
            for x in after.get(todo.pop(), set()) - seen:
                seen.add(x)
                todo.append(x)
        reach[v] = seen
    return {v: {x[1] for x in seen if v not in reach.get(x, set())} for v, seen in reach.items()}


def _circles(after: list[list[int]]) -> list[int]:
    """The circle of each node (Tarjan's search): a step leads into the same circle or into one of a smaller number."""
    number, low, circle = [-1] * len(after), [0] * len(after), [-1] * len(after)
    open_nodes: list[int] = []
    count = found = 0
    for root in range(len(after)):
        path = []
        enter = root if number[root] < 0 else -1
        while enter >= 0 or path:
            if enter >= 0:
                number[enter] = low[enter] = count
                count += 1
                open_nodes.append(enter)
                path.append((enter, iter(after[enter])))
            v, rest = path[-1]
            enter = -1
            for w in rest:
                if number[w] < 0:
                    enter = w
                    break
                if circle[w] < 0:
                    low[v] = min(low[v], number[w])
            if enter >= 0:
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[v])
            if low[v] == number[v]:
                while circle[v] < 0:
                    circle[open_nodes.pop()] = found
                found += 1
    return circle


class Order:
    """The learned partial order (``precedence``), kept as its steps: as large as they are, not as the pairs they lead to."""

    def __init__(self, found: Iterable[tuple[str, str, str]]):
        nodes: dict[str, dict[str, int]] = {}
        after: list[list[int]] = []
        for field, before, later in found:
            known = nodes.setdefault(field, {})
            for v in (before, later):
                if v not in known:
                    known[v] = len(after)
                    after.append([])
            after[known[before]].append(known[later])
        circle = _circles(after)
        self.circle = {field: {v: circle[n] for v, n in known.items()} for field, known in nodes.items()}
        steps_out: list[list[int]] = [[] for _ in range(max(circle, default=-1) + 1)]
        for n, following in enumerate(after):
            steps_out[circle[n]].extend(circle[m] for m in following if circle[m] != circle[n])
        self.after = [tuple(set(x)) for x in steps_out]

    def latest(self, field: str, values: Iterable[str]) -> int:
        """The place of the first of the values that precedes none of them."""
        known = self.circle.get(field, {})
        circles = [known.get(v) for v in values]
        ends = {c for c in circles if c is not None}
        lowest, leads = min(ends, default=0), {}
        return next(i for i, c in enumerate(circles) if c is None or not self._leads(c, ends, lowest, leads))

    def _leads(self, start: int, ends: set[int], lowest: int, leads: dict[int, bool]) -> bool:
        """Whether steps lead from a circle to one of the ends; ``leads`` keeps what is known of these ends, so that a step is taken once."""
        if start in leads:
            return leads[start]
        path = [(start, iter(self.after[start]))]
        while path:
            c, rest = path[-1]
            for d in rest:
                if d in ends or leads.get(d):
                    leads.update((x, True) for x, _ in path)
                    return True
                if d > lowest and d not in leads:  # smaller numbers lead to smaller ones only
                    path.append((d, iter(self.after[d])))
                    break
            else:
                leads[c] = False
                path.pop()
        return False


def learned(values: DataFrame) -> Order:
    found = steps(values).toArrow()
    return Order(zip(*(found[c].to_pylist() for c in ("field", "before", "after"))))


def _candidates(c: str) -> Column:
    """A group's values that can survive, in the order of preference: the last dated one, then those of undated rows."""
    mine = F.col("field") == c
    # of the dated values the last one (then the greater) stands; undated rows add theirs
    dated = F.max(F.when(mine & F.col("last_at").isNotNull(), F.struct("last_at", "value")))["value"]
    undated = F.sort_array(F.collect_list(F.when(mine & F.col("undated").isNotNull(), F.struct("undated", "value"))), asc=False)
    return F.concat(F.when(dated.isNotNull(), F.array(dated)).otherwise(F.array().cast("array<string>")), F.transform(undated, lambda x: x["value"]))


def _survivor(c: str, shared: Broadcast[Order]) -> Column:
    """The topologically latest value of a group's partial order; Python sees groups of several candidates only."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        order = shared.value
        return pd.Series([None if v is None else order.latest(c, v) for v in values], dtype="Int32")

    values = F.col(f"{c}_values")
    return F.get(values, F.coalesce(place(F.when(F.size(values) > 1, values)), F.lit(0)))


def survivors(raw: DataFrame) -> DataFrame:
    """One row per duplicate group: group_id, best_id, n_rows, the group key, the best row's engine, and the surviving engine, confidence,
    severity and description."""
    rows = keyed(raw)
    fields = vocabularies(rows)
    combos = cut_lineage(combinations(rows, fields))
    groups = combos.where("head is not null").select("group_id", "head")
    if fields:
        values = seen_values(combos, fields)
        shared = raw.sparkSession.sparkContext.broadcast(learned(values))
        groups = groups.join(values.groupBy("group_id").agg(*(_candidates(c).alias(f"{c}_values") for c in fields)), "group_id", "left")
    value = lambda c: (_survivor(c, shared) if c in fields else F.col(f"head.{c}")).alias(c)
    return groups.select(
        "group_id", (-F.col("head.best.p.neg")).alias("best_id"), "head.n_rows", "head.scan_run_id", F.col("head.rule").alias("rule_id"), F.col("head.path").alias("file_path"), "head.start_line",
        F.col("head.best.engine").alias("best_engine"), *(value(c) for c in CURRENCY_FIELDS), "head.description",
    )
