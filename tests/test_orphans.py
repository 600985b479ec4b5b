import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docketry.operators import orphans

REFS = "ref_table string, ref_id string, key string, at timestamp"
PARENTS = "key string, arrived timestamp, withdrawn timestamp"
START = datetime(2024, 1, 1)


def brute(refs, parents):
    out = set()
    for table, ref, key, at in refs:
        if key is None or at is None:
            continue
        own = [(a, w) for k, a, w in parents if k == key and a is not None]
        if any(a <= at and (w is None or max(w, a) > at) for a, w in own):
            continue
        first = min((a for a, _ in own), default=None)
        out.add((table, ref, "missing" if first is None else "late" if first > at else "deleted"))
    return out


def run(spark, refs, parents, cuts):
    """All batches through the ledger; ``cuts`` are the times between them."""
    r = spark.createDataFrame(refs, REFS)
    e = orphans.parent_events(spark.createDataFrame(parents, PARENTS))
    ledger, found = orphans.Ledger(), set()
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = (F.lit(True) if low is None else F.col("at") >= low) & (F.lit(True) if high is None else F.col("at") < high)
        ledger, cases = orphans.advance(ledger, r.filter(inside), e.filter(inside))
        found |= {(c.ref_table, c.ref_id, c.reason) for c in cases.collect()}
    return found | {(c.ref_table, c.ref_id, c.reason) for c in orphans.close(ledger).collect()}


def sample(seed, n_refs, n_parents):
    rng = random.Random(seed)
    time = lambda: None if rng.random() < 0.1 else START + timedelta(days=rng.randrange(300))
    refs = [("t", f"r{i}", rng.choice(["hot", "hot", "a", "b", "c", "d", None]), time()) for i in range(n_refs)]
    return refs, [(rng.choice(["hot", "a", "b", None]), time(), time()) for _ in range(n_parents)]


def test_batches_against_brute_force(spark):
    for seed in (1, 2):
        refs, parents = sample(seed, 200, 15)
        cuts = [START + timedelta(days=d) for d in (90, 200)]
        assert run(spark, refs, parents, cuts) == brute(refs, parents)


def test_cuts_do_not_matter(spark):
    refs, parents = sample(3, 80, 10)
    assert run(spark, refs, parents, []) == run(spark, refs, parents, [START + timedelta(days=d) for d in (30, 60, 150)]) == brute(refs, parents)


def test_empty(spark):
    at = START
    assert run(spark, [], [], []) == set()
    assert run(spark, [("t", "r", "a", at)], [], []) == {("t", "r", "missing")}
    assert run(spark, [], [("a", at, None)], []) == set()


def test_ties_in_time(spark):
    """Present from its arrival on, gone from its deletion on; deleted before it came counts as deleted."""
    at, later = START, START + timedelta(days=1)
    refs = [("t", "r1", "a", at), ("t", "r2", "a", later), ("t", "r3", "b", later), ("t", "r3", "b", later)]
    assert run(spark, refs, [("a", at, later), ("b", at + timedelta(hours=1), START - timedelta(days=1))], []) == {("t", "r2", "deleted"), ("t", "r3", "deleted")}


def open_orphans(spark, refs, parents, cuts):
    r, e = spark.createDataFrame(refs, REFS), orphans.parent_events(spark.createDataFrame(parents, PARENTS))
    ledger = orphans.Ledger()
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = (F.lit(True) if low is None else F.col("at") >= low) & (F.lit(True) if high is None else F.col("at") < high)
        ledger, _ = orphans.advance(ledger, r.filter(inside), e.filter(inside))
    months = spark.createDataFrame([(f"2024-{m:02}",) for m in range(1, 11)], "month string")
    return {r.month: r.open for r in orphans.open_by_month(ledger, months).collect()}


def test_open_at_month_ends(spark):
    """An arrival closes resolved references, a deletion reopens them, however the batches are cut."""
    refs = [("t", "r1", "a", START), ("t", "r2", "a", START), ("t", "r3", "b", START + timedelta(days=40)), ("t", "r4", "a", START + timedelta(days=50))]
    parents = [("a", START + timedelta(days=33), START + timedelta(days=70)), ("a", START + timedelta(days=130), None)]
    want = {"2024-01": 2, "2024-02": 1, "2024-03": 4, "2024-04": 4} | {f"2024-{m:02}": 1 for m in range(5, 11)}
    for cuts in ([], [START + timedelta(days=d) for d in (20, 60, 90)]):
        assert open_orphans(spark, refs, parents, cuts) == want


def test_month_ends_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PARTS", 2)
    refs, parents = sample(5, 120, 14)
    ends = [datetime(2024, m + 1, 1) for m in range(1, 11)]
    want = {}
    for m, end in enumerate(ends, 1):
        live = {k for k, a, w in parents if a is not None and a < end and (w is None or max(a, w) >= end)}
        want[f"2024-{m:02}"] = sum(k is not None and at is not None and at < end and k not in live for _, _, k, at in refs)
    cuts = [START + timedelta(days=d) for d in (35, 100, 170, 240)]
    assert open_orphans(spark, refs, parents, cuts) == want
    assert run(spark, refs, parents, cuts) == brute(refs, parents)


def test_earliest(spark):
    rows = spark.createDataFrame([("e", "x", START + timedelta(days=1)), ("e", "x", START), ("e", "y", None), (None, "z", START)], "id string, v string, at timestamp")
    got = {(r.id, r.v, r.at) for r in orphans.earliest(rows, "id", "at", "v").collect()}
    assert got == {("e", "x", START), ("e", "y", START)}
