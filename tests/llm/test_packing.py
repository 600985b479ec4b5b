import os
import random

import pytest

from docketry.llm import packing, tokens


def plain_best_fit(sizes, sources, clusters, capacity):
    """The same rule by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [i for i, b in enumerate(bins) if b[0] >= size and not cluster & b[2]]
        other = [i for i in fits if not source & bins[i][1]]
        tight = min(((bins[i][0]) for i in (other or fits)), default=None)
        out.append((tight, bool(other), bool(fits)))
        chosen = next((i for i in (other or fits) if bins[i][0] == tight), None)
        if chosen is None:
            bins.append([capacity - size, source, cluster])
        else:
            b = bins[chosen]
            bins[chosen] = [b[0] - size, b[1] | source, b[2] | cluster]
    return len(bins)


def check(sizes, sources, clusters, capacity):
    where = packing.best_fit(sizes, sources, clusters, capacity)
    load, held = {}, {}
    for b, size, cluster in zip(where, sizes, clusters, strict=True):
        load[b] = load.get(b, 0) + size
        assert not cluster & held.get(b, 0)
        held[b] = held.get(b, 0) | cluster
    assert max(load.values(), default=0) <= capacity and sorted(load) == list(range(len(load)))
    return len(load)


def test_against_plain_search():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randrange(1, 120)
        sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        sources = [1 << rng.choice([0, 0, 1, 2, 3]) if rng.random() < 0.9 else 0 for _ in range(n)]
        clusters = [1 << rng.randrange(3) if rng.random() < 0.2 else 0 for _ in range(n)]
        # ties between bins of one residual may go either way, and then the number of bins by a few
        assert abs(check(sizes, sources, clusters, 100) - plain_best_fit(sizes, sources, clusters, 100)) <= 2


def test_no_conflict_is_plain_best_fit_decreasing():
    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 101) for _ in range(500)), reverse=True)
    zero = [0] * 500
    assert check(sizes, zero, zero, 100) == plain_best_fit(sizes, zero, zero, 100)
    assert check([], [], [], 10) == 0


def test_hot_source_opens_no_bins():
    sizes = [10] * 90
    assert check(sizes, [1] * 90, [0] * 90, 30) == 30


def test_cluster_never_shares():
    assert check([10] * 5, [0] * 5, [1] * 5, 100) == 5


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer here")
def test_documents(spark):
    long = "many different words stand in this text " * 400
    rows = [(1, long, "s", "x"), (2, "a few words", "s", "x"), (3, "a few words", None, "x"), (4, None, "s", "x"), (5, "", "s", "x"), (6, "other words", "s", "x"), (None, "lost", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster string")
    counter = tokens.Counter()
    size = {i: counter.exact(t) for i, t, _, _ in rows if i and t}
    got = packing.pack(packing.measure(docs), [("k", 64), ("none", None)]).collect()
    assert {r.experiment_id for r in got} == {"k"}
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert {i: sum(p[2] for p in ps) for i, ps in parts.items()} == size
    assert all(len(parts[i]) == 1 for i in (2, 3, 6))
    for ps in parts.values():
        ps.sort()
        assert [p[1] for p in ps] == [64 * k for k in range(len(ps))]
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 64
    assert {r.container_id for r in got if r.doc_id == 2} != {r.container_id for r in got if r.doc_id == 3}
    assert packing.pack(packing.measure(docs.limit(0)), [("k", 64)]).count() == 0
    assert packing.pack(packing.measure(docs), []).count() == 0
