import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import q_splits, splits


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def contracted(spark, edges):
    groups = {}
    for r in splits.contract(spark.createDataFrame(edges, "u string, v string")).collect():
        groups.setdefault(r.root, {r.root}).add(r.vertex)
    return {frozenset(g) for g in groups.values()}


def test_contract_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [("hub", f"leaf{i}") for i in range(40)] + [(f"path{i}", f"path{i + 1}") for i in range(30)]
    assert contracted(spark, edges) == {g for g in union_find(edges) if len(g) > 1}


def test_contract_small(spark):
    assert contracted(spark, []) == set()
    assert contracted(spark, [("a", "a"), ("a", None)]) == set()
    assert contracted(spark, [("a", "b"), ("b", "a"), ("a", "b")]) == {frozenset("ab")}


def test_components(spark):
    rows = [("r1", "x", None), ("r2", "x", "p"), ("r3", None, "p"), ("r4", None, None), ("r5", "", "q"), ("r5", "", "q"), ("r6", "y", "q"), (None, "x", "p")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, a string, b string, record string")
    keys = [F.concat(F.lit("a"), F.nullif("a", F.lit(""))), F.concat(F.lit("b"), F.col("b"))]
    assert {tuple(r) for r in splits.components(df, "id", keys).collect()} == {("r1", "r1"), ("r2", "r1"), ("r3", "r1"), ("r4", "r4"), ("r5", "r5"), ("r6", "r5")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60))
def test_assign_keeps_shares(spark, weights):
    members = [(f"r{c}-{i}", f"c{c}") for c, w in enumerate(weights) for i in range(w)]
    shares = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    rows = splits.assign(spark.createDataFrame(members, "record string, component string"), shares, digits=1).collect()
    assert {r.component: r.weight for r in rows} == {f"c{c}": w for c, w in enumerate(weights)}
    got = {name: sum(r.weight for r in rows if r.split == name) / len(members) for name, _ in shares}
    # components are cut where a share ends: it is off by less than the component that stands there
    assert all(abs(got[n] - s) <= 2 * max(weights) / len(members) + 1e-9 for n, s in shares)


def test_splits_are_alike_in_sizes(spark):
    """Components of every size stand in every split; only heavy ones go to the largest split first."""
    rng = random.Random(2)
    weights = [600, 300] + [rng.choice([1, 1, 1, 2, 2, 3, 5, 8]) for _ in range(4000)]
    members = [(f"r{c}-{i}", f"c{c}") for c, w in enumerate(weights) for i in range(w)]
    rows = splits.assign(spark.createDataFrame(members, "record string, component string"), [("train", 0.8), ("validation", 0.1), ("test", 0.1)], heavy=0.01).collect()
    light = [r for r in rows if r.weight < 300]
    mean = {s: sum(r.weight for r in light if r.split == s) / sum(r.split == s for r in light) for s in ("train", "validation", "test")}
    assert max(mean.values()) < 1.1 * min(mean.values())
    assert {r.split for r in rows if r.weight >= 300} == {"train"}


def test_assign_without_components_or_shares(spark):
    schema = "record string, component string"
    assert splits.assign(spark.createDataFrame([], schema), [("train", 1.0)]).count() == 0
    assert [r.split for r in splits.assign(spark.createDataFrame([("r", "c")], schema), []).collect()] == [None]


def test_names_that_agree(spark):
    authors = [["D. K. Rimorote, J.", "HON'BLE JUSTICE D. K. RIMOROTE", "d k rimorote j", " D. K.  Rimorote, J.", "D.K. Rimorote", "Justice DK Rimorote"], ["J. Rimorote, J."], ["D. Rimorote, J."]]
    parties = [["M/s. Sojabeka Pharma Private Ltd", "SOJABEKA PHARMA (P) LIMITED", "Sojabeka Pharma Pvt. Ltd."], ["Sojabeka Foods Ltd"]]
    matters = [["C.A. No. 85943/2006", "CIVIL APPEAL NO.85943 OF 2006", "Civil Appeal No. 85943 of 2006", "C.A. 85943 of 2006"], ["Crl.A. 85943 of 2006", "Criminal Appeal No. 85943 of 2006"], ["W.P. No. 85943/2006", "WRIT PETITION NO.85943 OF 2006"]]
    for key, groups in ((q_splits.author_key, authors), (q_splits.party_key, parties), (q_splits.matter_key, matters)):
        got = [{r[0] for r in spark.createDataFrame([(x,) for x in g], "c string").select(key(F.col("c"))).collect()} for g in groups]
        assert all(len(g) == 1 and None not in g for g in got), got
        assert len(set.union(*got)) == len(groups)
    nothing = spark.createDataFrame([(x,) for x in ("PER CURIAM", "not recorded", "-", "", " ", "State of X", "UNION OF KARVALI", None)], "c string")
    assert {r[0] for r in nothing.select(q_splits.party_key(F.col("c"))).collect()} == {None}
    assert {r[0] for r in nothing.filter("c not like '%of%' and c not like '%OF%'").select(q_splits.author_key(F.col("c"))).collect()} == {None}
