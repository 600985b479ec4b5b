import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from docketry.operators import graph

D = date
NODES = "node_id string, node_type string, label string, source_document_ids array<string>, available_from date, available_to date, decision_date date"
EDGES = "edge_id string, relation_type string, source_id string, target_id string, evidence_extraction_ids array<string>, origin_split string, confidence double, available_from date, available_to date, source_decision_date date"


def node(i, kind, a=None, b=None, d=None):
    return (i, kind, i, ["doc"], a, b, d)


def edge(i, relation, s, t, split="train", a=None, d=None):
    return (i, relation, s, t, ["x"], split, 1.0, a, None, d)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [node("alpha", "case", d=D(2020, 5, 10)), node("beta", "case", d=D(2022, 7, 12)), node("query", "case", d=D(2025, 2, 1)), node("act", "act", D(1860, 1, 1)), node("ipc302", "provision", D(1860, 1, 1), D(2023, 6, 30)), node("bns103", "provision", D(2024, 7, 1)), node("court", "court")]
    edges = [
        edge("cites", "cites", "beta", "alpha", d=D(2022, 7, 12)), edge("overrules", "overrules", "beta", "alpha", d=D(2022, 7, 12)), edge("refers", "refers_to_provision", "beta", "ipc302", d=D(2022, 7, 12)), edge("contains", "contains", "act", "ipc302"),
        edge("amends", "amends", "bns103", "ipc302", a=D(2024, 7, 1)), edge("decided", "decided_by", "beta", "court"), edge("before", "temporally_precedes", "alpha", "beta"), edge("test", "cites", "query", "beta", "test", d=D(2025, 2, 1)),
    ]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_valid(small):
    assert graph.violations(*small).count() == 0


def test_violations(spark, small):
    nodes, edges = small
    bad = spark.createDataFrame([edge("wrong", "cites", "ipc302", "alpha"), ("bare", "cites", "beta", "nowhere", [], "train", 1.5, None, None, None)], EDGES)
    got = {(r.id, r.rule) for r in graph.violations(nodes, edges.unionByName(bad)).collect()}
    assert got == {("wrong", "cannot start there"), ("bare", "no evidence"), ("bare", "confidence out of range"), ("bare", "target does not resolve")}


def test_eligible(small):
    nodes, edges = small
    at = lambda d: {r.edge_id for r in graph.eligible_edges(edges, nodes, F.lit(d).cast("date")).collect()}
    assert at("2023-01-01") == {"cites", "overrules", "refers", "contains", "decided", "before"}
    assert "refers" not in at("2023-07-01") and "refers" in at("2023-06-30")
    assert at("1850-01-01") == set()


def test_without(spark, small):
    nodes, edges = small
    n, e = graph.without(nodes, edges, spark.createDataFrame([("beta",)], "node_id string"))
    assert n.count() == 6 and {r.edge_id for r in e.collect()} == {"contains", "amends"}


def test_expand(spark):
    links = [("s", "b"), ("s", "a"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "e")]
    adj = spark.createDataFrame([("q", a, b, 1.0 if b == "d" else 0.0) for x, y in links for a, b in ((x, y), (y, x))], "query_id string, node_id string, neighbour string, prize double")

    def run(budget, hops):
        rows = graph.expand(spark.createDataFrame([("q", "s", budget)], "query_id string, seed string, budget int"), adj, hops).collect()
        return [r.node_id for r in sorted(rows, key=lambda r: r.position)]

    assert run(10, 1) == ["s", "a", "b"]
    assert run(10, 2) == ["s", "a", "b", "c", "d"]
    assert run(10, 3) == ["s", "a", "b", "c", "d", "e"]
    assert run(2, 3) == ["s", "a"]


CITED = {"c1": (D(2015, 1, 1), ["482", "438", "439"]), "c2": (D(2015, 2, 1), ["482", "438"]), "c3": (D(2015, 3, 1), ["439", "156"]), "later": (D(2017, 1, 1), ["482", "156"]), "query": (D(2016, 6, 1), ["482", "156"])}


def test_cocitation(spark):
    cited = spark.createDataFrame([(c, t, d) for c, (d, ts) in CITED.items() for t in ts], "case_id string, target string, seen_from date")

    def run(budget, exclude="query"):
        seeds = spark.createDataFrame([("q", exclude, D(2016, 6, 1), "482", 1)], "query_id string, exclude string, as_of date, seed string, ord int")
        return [r.node_id for r in sorted(graph.cocitation(seeds, cited, budget).collect(), key=lambda r: r.position)]

    assert run(10) == ["482", "438", "439"] or run(10) == ["482", "438", "439", "156"]
    assert run(2) == ["482", "438"]


def test_tree():
    links = {("c1", "s1"), ("c1", "s2"), ("hub", "s1"), ("c2", "s1"), ("c3", "far")}
    tree = graph.steiner_tree(["s1", "s2"], links, 10, 2)
    assert tree[0] == "s1" and {"s1", "s2", "c1"} <= set(tree) and not {"far", "c3"} & set(tree)
    assert len(graph.steiner_tree(["s1", "s2"], links, 2, 2)) <= 2
    assert graph.steiner_tree(["alone"], links, 5, 2) == ["alone"]
    assert graph.steiner_tree(["s1"], links, 10, 2, neighbour_prize=0.05) == ["s1"]


def test_near_links_leave_the_tree_as_it_is(spark):
    """Trees over what near_links leaves are those over the whole neighbourhood."""
    rng = random.Random(4)
    cited = {(f"c{rng.randrange(60):02}", f"p{rng.randrange(14):02}") for _ in range(170)}
    asked = {f"q{i}": sorted(rng.sample([f"p{k:02}" for k in range(14)], rng.randrange(1, 5))) for i in range(12)}
    citations = spark.createDataFrame([(c, t, None) for c, t in cited], "case_id string, target string, seen_from date")
    seeds = spark.createDataFrame([(q, q, D(2016, 1, 1), s, k + 1) for q, ss in asked.items() for k, s in enumerate(ss)], "query_id string, exclude string, as_of date, seed string, ord int")
    for budget in (4, 9):
        got = {}
        for r in graph.steiner_trees(seeds, graph.near_links(seeds, citations, budget), budget, 2).collect():
            got.setdefault(r.query_id, []).append((r.position, r.node_id))
        for q, ss in asked.items():
            around = {c for c, t in cited if t in ss}
            whole = graph.steiner_tree(ss, {(c, t) for c, t in cited if c in around}, budget, 2)
            assert [n for _, n in sorted(got[q])] == whole, (q, budget)


def test_resolve(spark):
    ids = spark.createDataFrame([("provision:india:ipc:302:v1",), ("provision:india:ipc:302:v2",), ("provision:india:bns:103:v1",), (" CASE:india:x ",)], "node_id string")
    asked = spark.createDataFrame([("a", "provision", "provision:india:ipc:302:"), ("b", "provision", "provision:india:bns:103:"), ("c", "case", "case:india:X"), ("d", "case", "nothing"), ("e", "case", None)], "extraction_id string, kind string, canonical_hint string")
    got = {r.extraction_id: (r.resolved_target_id, r.unresolved_reason) for r in graph.resolve(asked, ids).collect()}
    assert got["a"] == (None, "ambiguous_canonical_target") and got["b"] == ("provision:india:bns:103:v1", None) and got["c"] == ("case:india:x", None)
    assert got["d"] == got["e"] == (None, "no_canonical_target")


def test_assembly_does_not_depend_on_order(spark):
    rows = [("c", "refers_to_provision", "p", f"x{i}") for i in range(5)] + [("c", "cites", "d", "y")]
    one = graph.assemble_edges(spark.createDataFrame(rows, "source_id string, relation_type string, target_id string, extraction_id string"))
    two = graph.assemble_edges(spark.createDataFrame(rows[::-1] * 2, "source_id string, relation_type string, target_id string, extraction_id string").repartition(3))
    assert sorted(map(tuple, one.select("edge_id").collect())) == sorted(map(tuple, two.select("edge_id").collect())) and one.count() == 2


def test_seeds_share_a_budget(spark):
    """Each seed has its part, in the order of seeds; a node counts once; the excluded node and links of other days do not exist."""
    links = [("s1", "a", None, None), ("s1", "b", None, None), ("s2", "b", None, None), ("s2", "c", None, D(2010, 1, 1)), ("s2", "me", None, None), ("b", "z", D(2030, 1, 1), None)]
    links = spark.createDataFrame(links + [(b, a, x, y) for a, b, x, y in links], "node_id string, neighbour string, seen_from date, seen_to date")
    asked = spark.createDataFrame([("q", "me", D(2020, 1, 1), "s1", 1), ("q", "me", D(2020, 1, 1), "s2", 2), ("one", None, None, "s2", 1), ("alone", None, None, "x", 1)], "query_id string, exclude string, as_of date, seed string, ord int")

    def run(budget):
        out = {}
        for r in sorted(graph.expand_shared(asked, links, budget, 2).collect(), key=lambda r: r.position):
            out.setdefault(r.query_id, []).append(r.node_id)
        return out

    assert run(8) == {"q": ["s1", "a", "b", "s2"], "one": ["s2", "b", "c", "me", "s1", "z"], "alone": ["x"]}
    assert run(2) == {"q": ["s1", "s2"], "one": ["s2", "b"], "alone": ["x"]}
    status = graph.with_status(spark.createDataFrame([("q", 2), ("none", 0), ("old", 3)], "query_id string, named int"), graph.expand_shared(asked, links, 4, 1))
    assert {r.query_id: (r.status, r.nodes) for r in status.collect()} == {"q": ("ok", 4), "none": ("no_seed", 0), "old": ("no_eligible_seed", 0)}


def asked_and_cited(spark, seed, queries=40, cases=60, targets=14):
    """Random requests and citations; some days, and one case to leave out, are NULL."""
    rng = random.Random(seed)
    some = lambda: rng.choice([None, *[D(2010 + y, 1, 1) for y in range(8)]])
    cited = [(f"c{rng.randrange(cases):02}", f"p{rng.randrange(targets):02}", some()) for _ in range(cases * 4)]
    asked = {f"q{i}": (None if i == 3 else f"c{rng.randrange(cases):02}", some(), rng.sample([f"p{k:02}" for k in range(targets + 1)], rng.randrange(1, 5))) for i in range(queries)}
    seeds = spark.createDataFrame([(q, x, d, s, k + 1) for q, (x, d, ss) in asked.items() for k, s in enumerate(ss)], "query_id string, exclude string, as_of date, seed string, ord int")
    return seeds, spark.createDataFrame(cited, "case_id string, target string, seen_from date"), asked, cited


def seen_by(cited, x, day):
    """What every case cites that may be seen on a day."""
    out = {}
    for c, t, d in cited:
        if x is not None and c != x and (d is None or day is None or d <= day):
            out.setdefault(c, set()).add(t)
    return out


def brute_cocitation(asked, cited, budget):
    out = {}
    for q, (x, day, ss) in asked.items():
        shared, support = {}, {}
        for c, ts in seen_by(cited, x, day).items():
            for t in ts - set(ss):
                if mine := ts & set(ss):
                    shared.setdefault(t, set()).update(mine)
                    support.setdefault(t, set()).add(c)
        rest = sorted(shared, key=lambda t: (-len(shared[t]), -len(support[t]), t))
        out[q] = ([(s, None, None) for s in ss] + [(t, len(shared[t]), len(support[t])) for t in rest])[:budget]
    return out


@pytest.mark.parametrize("budget", [3, 6, 30])
def test_cocitation_goes_once_to_a_block(spark, budget):
    """As by brute force, and what is cited together meets blocks of queries, not a row per query and citing case."""
    seeds, citations, asked, cited = asked_and_cited(spark, budget)
    df = graph.cocitation(seeds, citations, budget)
    assert "CoGroups" in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.position):
        got.setdefault(r.query_id, []).append((r.node_id, r.shared_seeds, r.support))
    assert got == brute_cocitation(asked, cited, budget)


def test_cocitation_links(spark):
    seeds, citations, asked, cited = asked_and_cited(spark, 5)
    got = {tuple(r) for r in graph.cocitation_links(seeds, citations, 8).collect()}
    want = set()
    for q, nodes in brute_cocitation(asked, cited, 8).items():
        x, day, _ = asked[q]
        for ts in seen_by(cited, x, day).values():
            at = [i for i, (n, *_) in enumerate(nodes) if n in ts]
            want |= {(q, i, j) for i in at for j in at if i != j}
    assert got == want and want


@pytest.mark.parametrize("budget", [1, 3, 30])
def test_links_of_cocitation_are_made_in_blocks(spark, budget, monkeypatch):
    """As by brute force, with NULL days and nobody left out; no row per query and two of its nodes goes to a join, where it could be broadcast."""
    from docketry.operators import beside

    monkeypatch.setattr(beside, "AT_ONCE", 20)
    seeds, citations, asked, cited = asked_and_cited(spark, budget + 20)
    df = graph.cocitation_links(seeds, citations, budget)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "Join" not in plan[: plan.index("CoGroups")]
    want = set()
    for q, nodes in brute_cocitation(asked, cited, budget).items():
        x, day, _ = asked[q]
        for ts in seen_by(cited, x, day).values():
            at = [i for i, (n, *_) in enumerate(nodes) if n in ts]
            want |= {(q, i, j) for i in at for j in at if i != j}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want) and bool(want) == (budget > 1)


def test_coverage_of_cocitation(spark):
    """Its counts come from blocks of queries too."""
    from docketry.plans import graph_queries
    from tests import oracle

    df = graph_queries.cocitation_coverage(spark, oracle.FOLDER)
    assert "CoGroups" in df._jdf.queryExecution().executedPlan().toString()
    oracle.assert_same(df, oracle.connection().execute(graph_queries.CORE.oracle["cocitation_coverage"]))


def test_shared_expansion_goes_once_to_a_block(spark):
    """As by brute force, with NULL days and nobody left out, and a node's links meet blocks of queries, not each seed of each query."""
    rng = random.Random(9)
    some = lambda: rng.choice([None, *[D(2010 + y, 1, 1) for y in range(8)]])
    links = {(f"n{rng.randrange(50):02}", f"n{rng.randrange(50):02}", some(), some()) for _ in range(220)} | {("n00", f"n{k:02}", None, None) for k in range(1, 50)}
    links |= {(b, a, x, y) for a, b, x, y in links}
    asked = {f"q{i}": (rng.choice([None, f"n{rng.randrange(50):02}"]), some(), rng.sample([f"n{k:02}" for k in range(51)], rng.randrange(1, 5))) for i in range(30)}
    requests = spark.createDataFrame([(q, x, d, s, k + 1) for q, (x, d, ss) in asked.items() for k, s in enumerate(ss)], "query_id string, exclude string, as_of date, seed string, ord int")
    budget, hops = 13, 3
    df = graph.expand_shared(requests, spark.createDataFrame(sorted(links, key=str), "node_id string, neighbour string, seen_from date, seen_to date"), budget, hops)
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.position):
        got.setdefault(r.query_id, []).append((r.node_id, r.depth))
    for q, (x, day, ss) in asked.items():
        near, walk = {}, {}
        for a, b, lo, hi in links:
            if b != x and (day is None or ((lo is None or lo <= day) and (hi is None or hi >= day))):
                near.setdefault(a, set()).add(b)
        for s in ss:
            reached = [(s, 0)]
            for depth in range(1, hops + 1):
                for parent in [n for n, far in reached if far == depth - 1]:
                    known = {n for n, _ in reached}
                    reached += [(n, depth) for n in sorted(near.get(parent, set()) - known, key=lambda n: (n not in ss, n))]
                reached = reached[: max(1, budget // len(ss))]
            for n, depth in reached:
                walk.setdefault(n, depth)
        assert got[q] == list(walk.items())[:budget], q


def test_a_hop_stops_where_there_is_no_room():
    """Seeds of the query first, then names in order, no more than the part; a block without links adds nothing."""
    import pyarrow as pa

    from docketry.operators import beside

    row = {"block": 0, "query_id": "q", "x": 5, "since": 9, "until": 9, "ord": 1, "part": 4, "s": 1, "node": 1, "at": 1, "depth": 0, "open": True}
    rows = pa.Table.from_pylist([row, row | {"s": 8, "node": 8, "ord": 2}])
    links = pa.Table.from_pylist([{"of": 1, "nb": n, "lo": 10 if n == 3 else 0, "hi": 20} for n in range(2, 10_000)])
    got = pa.table(beside._hop_block(1, rows, links)).to_pylist()
    assert [(r["s"], r["node"], r["at"], r["open"]) for r in got] == [(1, 8, 2, False), (1, 2, 3, False), (1, 4, 4, False)]
    assert pa.table(beside._hop_block(1, rows, links.slice(0, 0))).num_rows == 0


def test_trees_of_blocks(spark):
    """Trees whose links stay in the block of the query are those over near_links, with NULL days and nobody left out too."""
    seeds, citations, asked, _ = asked_and_cited(spark, 7)
    of = lambda df: {(r.query_id, r.position, r.node_id) for r in df.collect()}
    got = of(graph.near_trees(seeds, citations, 6, 2))
    assert got == of(graph.steiner_trees(seeds, graph.near_links(seeds, citations, 6), 6, 2)) and {q for q, *_ in got} == set(asked)


@pytest.mark.parametrize("budget", [1, 3, 9, 32])
def test_trees_grow_in_arrays(budget):
    """As by the plain tree over all that is near, ways through targets that are no seeds, and seeds on the way of others, included; only mixed nodes need it."""
    import pyarrow as pa

    from docketry.operators import beside

    def plain(seeds, links):
        assert mixed
        return graph.steiner_tree(seeds, links, budget, 2)

    long = 0
    for seed in range(60):
        rng, mixed = random.Random(seed), seed % 6 == 0
        ids = rng.sample(range(260), 260)
        cases, targets = ids[:200], ids[200:]
        cited = {(rng.choice(cases), rng.choice(targets)): rng.randrange(8) for _ in range(400)}
        cited |= {(rng.choice(targets), rng.choice(ids)): rng.randrange(8) for _ in range(3 * mixed)}
        asked = {f"q{k}": (rng.sample(targets, rng.randrange(1, 9)), rng.choice([rng.choice(cases), -1, beside.NOBODY]), rng.randrange(9)) for k in range(6)}
        rows = pa.Table.from_pylist([{"query_id": q, "x": x, "day": day, "ord": k + 1, "s": s} for q, (ss, x, day) in asked.items() for k, s in enumerate(ss)])
        cites = pa.Table.from_pylist([{"c": c, "t": t, "d": d} for (c, t), d in cited.items()])
        got = {}
        for r in pa.table(beside._tree_block(budget, plain, rows, cites)).to_pylist():
            got.setdefault(r["query_id"], []).append(r["node"])
        for q, (ss, x, day) in asked.items():
            near = {c for (c, t), d in cited.items() if x != beside.NOBODY and t in ss and d <= day and c != x}
            want = graph.steiner_tree(ss, {(c, t) for (c, t), d in cited.items() if c in near and d <= day}, budget, 2)
            assert got[q] == want, (seed, q)
            long += any(n in targets and n not in ss for n in want)
    assert long or budget < 9


def test_sizes_of_expansions(spark, monkeypatch):
    """As many nodes as the expansions have, with NULL days and nobody left out; the status cleans the graph once."""
    from docketry.plans import graph_queries
    from tests import oracle

    rng = random.Random(11)
    some = lambda: rng.choice([None, *[D(2010 + y, 1, 1) for y in range(8)]])
    nodes = spark.createDataFrame([(f"n{k:02}", some(), None if k % 3 else some(), some()) for k in range(40)], "node_id string, available_from date, available_to date, decision_date date")
    edges = [("cites", f"n{rng.randrange(42):02}", f"n{rng.randrange(42):02}", some(), None, some()) for _ in range(150)] + [("cites", "n00", f"n{k:02}", None, None, None) for k in range(40)]
    edges = spark.createDataFrame(edges, "relation_type string, source_id string, target_id string, available_from date, available_to date, source_decision_date date")
    asked = [(f"q{i}", rng.choice([None, "nobody", f"n{rng.randrange(40):02}"]), some(), s, k + 1) for i in range(30) for k, s in enumerate(rng.sample([f"n{k:02}" for k in range(40)], rng.randrange(1, 5)))]
    requests = spark.createDataFrame(asked, "query_id string, exclude string, as_of date, seed string, ord int")
    links = graph.dated_links(edges, nodes).select("node_id", "neighbour", "seen_from", "seen_to")
    for budget in (3, 13):
        want = {r["query_id"]: r["count"] for r in graph.expand_shared(requests, links, budget, 2).groupBy("query_id").count().collect()}
        assert {r.query_id: r.nodes for r in graph.expansion_sizes(requests, edges, nodes, budget, 2).collect()} == want and len(want) == 30
    times, cleaned = [], graph_queries.cleaned
    monkeypatch.setattr(graph_queries, "cleaned", lambda *a: times.append(a) or cleaned(*a))
    oracle.assert_same(graph_queries.expansion_status(spark, oracle.FOLDER), oracle.connection().execute(graph_queries.CORE.oracle["expansion_status"]))
    assert len(times) == 1


@pytest.mark.parametrize("budget", [1, 2, 4, 30])
def test_sizes_of_cocitation(spark, budget, monkeypatch):
    """As many nodes as by brute force, though a seed sends no more than three budgets of targets to a block."""
    from docketry.operators import beside

    monkeypatch.setattr(beside, "AT_ONCE", 20)
    for seed in (budget, budget + 50):
        seeds, citations, asked, cited = asked_and_cited(spark, seed, cases=25, targets=30)
        got = {r.query_id: r.nodes for r in graph.cocitation_sizes(seeds, citations, budget).collect()}
        assert got == {q: len(nodes) for q, nodes in brute_cocitation(asked, cited, budget).items()}
    _, cites = beside.numbered_citations(citations)
    assert max(r["count"] for r in beside.earliest(beside.together(cites), budget).groupBy("s").count().collect()) <= 3 * budget
