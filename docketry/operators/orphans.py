"""References to records that do not exist: keyed pending-orphan state, kept up batch by batch.

The ledger holds three tables, each as a few parts that batches append to: per parent key how many of its records are live
and when the first one arrived (the parent index); per table and key how many references were made, resolved ones too, so
that a deletion reopens them; and the references waiting for a key nobody has seen. :func:`advance` takes one batch
(everything of a time span) and

* turns the batch's arrivals and deletions into the few moments at which a key becomes live or dead,
* probes them with the batch's new references: live at its time is no case; dead but seen before is ``deleted``;
  first seen later in the batch is ``late``; never seen waits,
* resolves waiting references whose key arrives (``late``); the others go on waiting,
* writes the snapshot of the batch's months: by how much the open references of each table changed. Arrivals close the
  references of their key, deletions reopen them.

:func:`close` reports what still waits as ``missing``, :func:`open_by_month` adds the snapshots up. A batch writes what it
touches; the state is read, by the batch's keys, and rewritten only every ``PARTS`` batches. Everything is in the shared
folder, so a lost executor costs its tasks. However the batches are cut, the cases and the snapshots are the same.

Hot keys: parents are summed per key and day before any window, so a key with a third of the parents is cut into days;
references meet one row per key, a join that splits over any number of tasks, and are counted per key and month.

Defined cases: NULL keys and NULL times are no reference; an arrival counts from its own moment on, a deletion from its
own moment on; a record deleted before it arrives counts as arrived and deleted at its arrival; repeated rows count once
if they are repeated in ``parents`` or ``references`` by the caller's grouping (see :func:`earliest`).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialise, release

#: Parts of a table of the state before they are made one.
PARTS = 8


@dataclass
class Ledger:
    #: key, batch, live, first_arrival of the keys that a batch changed; the last batch counts
    keys: list[DataFrame] = field(default_factory=list)
    #: ref_table, key, made: references made in a batch
    made: list[DataFrame] = field(default_factory=list)
    #: ref_table, ref_id, key, at of references whose key was not seen by the end of their batch
    waiting: list[DataFrame] = field(default_factory=list)
    #: ref_table, month, change of every batch: a row for each table and month
    snapshots: list[DataFrame] = field(default_factory=list)
    batches: int = 0


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def earliest(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``(key, value, at)``: the values delivered for a key, dated by the key's earliest delivery."""
    grouped = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias(at), F.collect_set(value).alias("_values"))
    return grouped.select(key, F.explode("_values").alias(value), at)


def parent_events(parents: DataFrame) -> DataFrame:
    """``(key, at, delta)`` of ``(key, arrived, withdrawn)``, one row per record."""
    known = parents.filter("key is not null and arrived is not null")
    gone = known.filter("withdrawn is not null").select("key", F.greatest("withdrawn", "arrived").alias("at"), F.lit(-1).cast("long").alias("delta"))
    return known.select("key", F.col("arrived").alias("at"), F.lit(1).cast("long").alias("delta")).unionByName(gone)


def _latest(parts: list[DataFrame]) -> DataFrame | None:
    rows = _union(parts)
    return None if rows is None else rows.groupBy("key").agg(F.max_by(F.struct("live", "first_arrival"), "batch").alias("of"), F.max("batch").alias("batch")).select("key", "batch", "of.*")


def _moments(events: DataFrame, old: DataFrame) -> DataFrame:
    """``key, added, arrival, flips`` of the batch's keys: ``flips`` are the moments at which it becomes live or dead."""
    per_moment = events.groupBy("key", "at").agg(F.sum("delta").alias("delta"), F.max("delta").alias("most")).withColumn("day", F.to_date("at"))
    daily = per_moment.groupBy("key", "day").agg(F.sum("delta").alias("delta"))
    before = F.coalesce(F.sum("delta").over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    daily = daily.join(old.select("key", F.col("live").alias("live0")), "key", "left").select("key", "day", (before + F.coalesce("live0", F.lit(0))).alias("base"))
    running = F.col("base") + F.sum("delta").over(Window.partitionBy("key", "day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    stepped = per_moment.join(daily, ["key", "day"]).withColumn("level", running)
    flip = (F.col("level") > 0) != (F.col("level") - F.col("delta") > 0)
    return stepped.groupBy("key").agg(
        F.sum("delta").alias("added"), F.min(F.when(F.col("most") > 0, F.col("at"))).alias("arrival"),
        F.array_sort(F.collect_list(F.when(flip, F.struct("at", (F.col("level") > 0).alias("up"))))).alias("flips"),
    )


def _live_at(at: Column) -> Column:
    """Whether the key is live at ``at``, over the columns of the batch's keys; NULL keys are not."""
    past = F.filter("flips", lambda f: f["at"] <= at)
    return F.coalesce(F.when(F.size(past) > 0, F.element_at(past, -1)["up"]).otherwise(F.col("live_before") > 0), F.lit(False))


def _snapshot(ledger: Ledger, counts: DataFrame, events: DataFrame, keys: DataFrame) -> DataFrame:
    """``ref_table, month, change`` of the batch: references open at the end of each of its months, less those before.

    Only keys that the batch changes or refers to are looked at, with what the ledger has of them.
    """
    moved = events.groupBy("key", F.date_format("at", "yyyy-MM").alias("month")).agg(F.sum("delta").alias("moved"))
    touched = keys.select("key", "live_before")
    held = _union([counts.select("ref_table", "key", F.lit(0).cast("long").alias("made")), *[p.join(touched, "key", "left_semi") for p in ledger.made]])
    held = held.groupBy("ref_table", "key").agg(F.sum("made").alias("made"))
    start = held.join(touched, "key", "left").select("ref_table", "key", F.lit("").alias("month"), "made", F.coalesce("live_before", F.lit(0)).alias("moved"))
    rows = start.unionByName(counts.select("ref_table", "key", "month", "made", F.lit(0).cast("long").alias("moved"))).unionByName(moved.join(held.select("ref_table", "key"), "key").select("ref_table", "key", "month", F.lit(0).cast("long").alias("made"), "moved"))
    rows = rows.groupBy("ref_table", "key", "month").agg(F.sum("made").alias("made"), F.sum("moved").alias("moved"))
    w = Window.partitionBy("ref_table", "key").orderBy("month")  # a row per month
    total = rows.select("ref_table", "key", "month", F.sum("made").over(w).alias("made"), F.sum("moved").over(w).alias("live"))
    stepped = total.withColumn("open", F.when(F.col("live") > 0, 0).otherwise(F.col("made")))
    stepped = stepped.withColumn("change", F.col("open") - F.lag("open").over(w)).filter("month <> ''")
    return stepped.groupBy("ref_table", "month").agg(F.sum("change").alias("change"))


def _compacted(ledger: Ledger) -> Ledger:
    """The same ledger with each table as one part; references whose key has arrived wait no longer."""
    keys = materialise(_latest(ledger.keys))
    made = materialise(_union(ledger.made).groupBy("ref_table", "key").agg(F.sum("made").alias("made")))
    waiting = materialise(_union(ledger.waiting).join(keys.filter("first_arrival is not null").select("key"), "key", "left_anti"))
    snapshots = materialise(_union(ledger.snapshots).groupBy("ref_table", "month").agg(F.sum("change").alias("change")))
    for old in (*ledger.keys, *ledger.made, *ledger.waiting, *ledger.snapshots):
        release(old)
    return Ledger([keys], [made], [waiting], [snapshots], ledger.batches)


def advance(ledger: Ledger, references: DataFrame, events: DataFrame) -> tuple[Ledger, DataFrame]:
    """One batch: the new ledger, and the cases it decides (``ref_table, ref_id, key, at, reason``).

    ``references``: ref_table, ref_id, key, at; ``events``: key, at, delta. All of a batch lies after all of those before.
    """
    references = references.filter("key is not null and at is not null")
    asked = events.select("key").unionByName(references.select("key")).distinct()
    old = _latest([p.join(asked, "key", "left_semi") for p in ledger.keys])
    if old is None:
        old = events.select("key", F.lit(0).alias("batch"), F.lit(0).cast("long").alias("live"), F.col("at").alias("first_arrival")).filter("false")
    none = F.array().cast("array<struct<at:timestamp,up:boolean>>")
    keys = materialise(old.join(_moments(events, old), "key", "full").select(
        "key", F.coalesce("live", F.lit(0)).alias("live_before"), (F.coalesce("live", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("live"),
        F.col("first_arrival").alias("seen_before"), F.coalesce("first_arrival", "arrival").alias("first_arrival"), F.coalesce("flips", none).alias("flips"), F.col("added").isNotNull().alias("changed"),
    ))
    arrival = F.col("first_arrival")
    probed = references.join(keys, "key", "left").filter(~_live_at(F.col("at")))
    reason = F.when(arrival <= F.col("at"), "deleted").when(arrival.isNotNull(), "late")
    orphans = probed.select("ref_table", "ref_id", "key", "at", reason.alias("reason"))
    arrived = keys.filter("seen_before is null and first_arrival is not null").select("key")
    for part in ledger.waiting:
        orphans = orphans.unionByName(part.join(arrived, "key", "left_semi").withColumn("reason", F.lit("late")))
    orphans = materialise(orphans.withColumn("decided", F.col("reason").isNotNull()), partition_by="decided")
    counts = materialise(references.groupBy("ref_table", "key", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("made")))
    after = Ledger(
        [*ledger.keys, keys.filter("changed").select("key", F.lit(ledger.batches).alias("batch"), "live", "first_arrival")],
        [*ledger.made, counts.select("ref_table", "key", "made")],
        [*ledger.waiting, orphans.filter("not decided").drop("reason", "decided")],
        [*ledger.snapshots, materialise(_snapshot(ledger, counts, events, keys))],
        ledger.batches + 1,
    )
    return (_compacted(after) if len(after.keys) > PARTS else after), orphans.filter("decided").drop("decided")


def close(ledger: Ledger) -> DataFrame:
    """What still waits at the end: its key never arrived."""
    seen = _union([p.filter("first_arrival is not null").select("key") for p in ledger.keys])
    return _union(ledger.waiting).join(seen.distinct(), "key", "left_anti").select("ref_table", "ref_id", "key", "at", F.lit("missing").alias("reason"))


def open_by_month(ledger: Ledger, months: DataFrame) -> DataFrame:
    """``ref_table, month, open`` at the end of each of ``months`` (a column ``month``), from the ledger's snapshots.

    A reference is open at a month's end if it was made by then and its key is not live then.
    """
    changes = _union(ledger.snapshots).groupBy("ref_table", "month").agg(F.sum("change").alias("change"))
    grid = months.select("month").unionByName(changes.select("month")).distinct().join(changes.select("ref_table").distinct())  # one row per month and table
    w = Window.partitionBy("ref_table").orderBy("month")
    return grid.join(changes, ["ref_table", "month"], "left").select("ref_table", "month", F.sum(F.coalesce("change", F.lit(0))).over(w).alias("open"))
