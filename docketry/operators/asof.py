"""Attributes as known at event time: periodic snapshots plus change logs.

The history of an entity key is cut into periods of whole years. For each period :func:`build` materialises the version
in force at its start (the snapshot) and the dated changes inside it (the log: at most one per day, so a period of *y*
years holds at most 366 *y* entries whatever the number of versions). :func:`attach` joins an event to the one row of its
key and period and replays the entries up to the event's date. Nothing that starts after the event can be reached.

A key that holds a third of the events meets one state row per period, so the join may be split over any number of
tasks; no task collects the events of a key.

Defined cases: a NULL start is the earliest date, a NULL end is open; windows are inclusive; a window that ends before it
starts is never in force; of several versions in force the latest start wins, then the smaller version id; a day without
a version in force is a change to NULL. Events with a NULL key or date, or before any version, get NULL attributes.
Repeated versions change nothing. Names of the event's columns are free: the state is renamed before the join, and the
result column is the only one added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialise


class AsKnown:
    """The materialised state: ``_key, _period, snapshot, changes`` and the first and last period that differ."""

    def __init__(self, state: DataFrame, years: int, first: int, last: int):
        self.state, self.years, self.first, self.last = state, years, first, last

    def period(self, date: Column) -> Column:
        """Periods before the first change and after the last one have the state of those."""
        p = F.floor(F.year(date) / F.lit(self.years)).cast("int")
        return F.greatest(F.lit(self.first), F.least(F.lit(self.last), p))


def build(versions: DataFrame, key: str, version_id: str, valid_from: str, valid_to: str, attributes: list[str], years: int = 10, keep: bool = True) -> AsKnown:
    """Snapshots and change logs of ``versions`` (one row per version), ``years`` years to a period.

    ``keep``: write the state to the shared folder, for several joins; otherwise it stays part of the plan.
    """
    v = versions.select(
        F.col(key).alias("_key"), F.col(valid_from).cast("date").alias("_from"), F.col(valid_to).cast("date").alias("_to"),
        F.struct(F.col(version_id).alias("version"), *[F.col(a) for a in attributes if a != version_id]).alias("_version"),
        F.col(version_id).alias("_id"),
    ).filter("_key is not null and (_from is null or _to is null or _from <= _to)")
    at = lambda d: F.floor(F.year(d) / F.lit(years)).cast("int")
    after = F.date_add("_to", 1)
    ends = v.agg(F.min(F.least(at(F.col("_from")), at(after))).alias("a"), F.max(F.greatest(at(F.col("_from")), at(after))).alias("b")).first()
    first, last = (0, 0) if ends.a is None else (ends.a - 1, ends.b)
    start = lambda p: F.make_date(p * F.lit(years), F.lit(1), F.lit(1))
    spread = v.withColumn("_period", F.explode(F.sequence(F.coalesce(at(F.col("_from")), F.lit(first)), F.coalesce(at(F.col("_to")), F.lit(last)))))
    # a version also has to be seen where its end is logged, which may be the next period
    starts = spread.select("_key", "_period", start(F.col("_period")).alias("_on"))
    opens = v.filter("_from is not null").select("_key", at(F.col("_from")).alias("_period"), F.col("_from").alias("_on"))
    closes = v.filter("_to is not null").select("_key", at(after).alias("_period"), after.alias("_on"))
    marks = starts.unionByName(opens).unionByName(closes).unionByName(closes.select("_key", "_period", start(F.col("_period")).alias("_on"))).distinct()
    inside = (F.col("_from").isNull() | (F.col("_from") <= F.col("_on"))) & (F.col("_to").isNull() | (F.col("_to") >= F.col("_on")))
    rank = F.struct(F.when(F.col("_from").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("open"), (-F.datediff("_from", F.lit("1970-01-01"))).alias("late"), F.col("_id").alias("id"))
    winners = marks.join(spread, ["_key", "_period"], "left").groupBy("_key", "_period", "_on").agg(F.min_by("_version", F.when(inside, rank)).alias("version"))
    entry = F.struct(F.col("_on").alias("on"), F.col("version"))
    at_start = F.col("_on") == start(F.col("_period"))
    state = winners.groupBy("_key", "_period").agg(
        F.first(F.when(at_start, F.col("version")), ignorenulls=True).alias("snapshot"),  # there is one
        F.array_sort(F.collect_list(F.when(~at_start, entry)), lambda a, b: F.datediff(a["on"], b["on"])).alias("changes"),
    )
    return AsKnown(materialise(state) if keep else state, years, first, last)


def attach(events: DataFrame, known: AsKnown, key: Column, date: Column, into: str = "as_known") -> DataFrame:
    """``events`` with a struct column ``into``: the version of ``key`` in force on ``date``, NULL where there is none."""
    left = events.withColumns({"_event_key": key, "_event_period": known.period(date), "_event_date": date})
    right = known.state.withColumnsRenamed({"_key": "_state_key", "_period": "_state_period", "snapshot": "_snapshot", "changes": "_changes"})
    joined = left.join(right, (F.col("_event_key") == F.col("_state_key")) & (F.col("_event_period") == F.col("_state_period")), "left")
    replayed = F.filter("_changes", lambda c: c["on"] <= F.col("_event_date"))
    value = F.when(F.size(replayed) > 0, F.element_at(replayed, -1)["version"]).otherwise(F.col("_snapshot"))
    return joined.withColumn(into, F.when(F.col("_event_date").isNotNull(), value)).drop("_event_key", "_event_period", "_event_date", "_state_key", "_state_period", "_snapshot", "_changes")


def latest_delivery(rows: DataFrame, key: str, delivered: str) -> DataFrame:
    """One row per ``key``: the one delivered last (rows of the same moment: the greatest by a hash of the row, so always the same one).

    A ranked window: each task drops all but one row of a key before the shuffle. Maps have no order, so they enter the hash as
    sorted entries. A NULL key is one key; NULL moments come first.
    """
    plain = [F.to_json(F.array_sort(F.map_entries(c))) if t.startswith("map<") else F.col(c) for c, t in rows.dtypes]
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(delivered), F.desc("_tie"))
    ranked = rows.withColumn("_tie", F.xxhash64(*plain)).withColumn("_rank", F.row_number().over(w))
    return ranked.filter("_rank = 1").drop("_tie", "_rank")
