import random

import numpy as np

from docketry.llm import leaks
from docketry.llm.words import Hasher, sequences, shingles, words

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
FORMULA = "Leave granted and with the consent of both sides the matter is taken up for final disposal today."


def sentence(n=14):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


ITEMS = {i: [FORMULA if i % 2 else sentence(), *[sentence() for _ in range(6)]] for i in range(1, 9)}


def run(spark, docs):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, " ".join(s)) for i, s in ITEMS.items()] + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in leaks.leaks(d, e).collect()}


def leaked(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.covered for r in leaks.leaks(d, e).collect()}


def noise(n=20):
    return " ".join(sentence() for _ in range(n))


def test_leaks(spark):
    edited = " ".join(w if k % 12 else "changed" for k, w in enumerate(" ".join(ITEMS[3][1:5]).split(), 1))
    docs = [
        (1, noise() + " " + " ".join(ITEMS[1]) + " " + noise()), (2, noise() + " " + edited.upper() + noise()), (3, noise() + ITEMS[2][5] + " " + ITEMS[2][3] + " " + ITEMS[2][4] + noise()),
        (4, noise() + ITEMS[4][2] + noise()), (5, noise()), (6, None), (7, ""), (8, ITEMS[5][1] + noise(30) + ITEMS[5][3] + noise(30) + ITEMS[5][5]), (9, " ".join(ITEMS[6]) + " " + " ".join(ITEMS[7])), (10, "few words"),
    ]
    docs += [(100 + i, noise(5) + " " + FORMULA + " " + noise(5)) for i in range(8)]
    # whole; edited; three sentences in another order; one sentence only; scattered sentences are no passage
    assert run(spark, docs) == {(1, 1), (2, 3), (3, 2), (9, 6), (9, 7)}


def test_formula_does_not_count(spark):
    """Two sentences and a formula are over a third, two sentences are not; copies of one text do not make a formula."""
    part = " ".join([FORMULA, *ITEMS[1][1:3]])
    assert len(words(part)) / len(words(" ".join(ITEMS[1]))) > leaks.COVERAGE
    unrelated = [(100 + i, noise(4) + FORMULA + " " + noise(4)) for i in range(6)]
    assert run(spark, [(1, noise() + part + " " + noise()), *unrelated]) == set()
    copies = noise(4) + FORMULA + " " + noise(4)
    assert run(spark, [(1, noise() + part + " " + noise()), *[(100 + i, copies) for i in range(6)]]) == {(1, 1)}


def test_near_copies_make_no_formula(spark):
    """Copies of a document that differ in a word each count once among the documents that hold a sentence."""
    item = [sentence() for _ in range(6)]
    quoting = (noise(6) + " " + item[1] + " " + noise(6)).split()
    near = [(100 + i, " ".join([*quoting[: 7 * i], f"other{i}", *quoting[7 * i + 1 :]])) for i in range(10)]
    assert leaked(spark, [(1, noise() + " ".join(item[1:3]) + " " + noise()), *near], [(1, " ".join(item))]) == {(1, 1): 28}


def test_repeated_and_like_items(spark):
    """Items of one text and items that share nearly all their wording are reported each."""
    text, shared = noise(6), [sentence() for _ in range(5)]
    items = [(i, text) for i in range(1, 11)] + [(20 + i, " ".join([*shared, sentence()])) for i in range(10)]
    docs = [(1, noise() + text + " " + noise()), (2, noise() + " ".join(shared[1:4]) + " " + noise()), (3, noise() + shared[1] + " " + noise())]
    assert leaked(spark, docs, items) == {(1, i): 84 for i in range(1, 11)} | {(2, 20 + i): 42 for i in range(10)}


def test_initials_end_no_sentence(spark):
    """An opening up to an initial stands in many documents; it is no sentence, and its words stay covered."""
    opening = "No explanation was offered as to why D."
    told = f"{opening} {sentence()}"
    item = " ".join([told, *[sentence() for _ in range(3)]])
    assert len(words(told)) - len(words(opening)) < leaks.COVERAGE * len(words(item)) < len(words(told))
    openings = [(100 + i, noise(4) + f"{opening} {noise(4)}") for i in range(8)]
    assert leaked(spark, [(1, noise() + told + " " + noise()), *openings], [(1, item)]) == {(1, 1): len(words(told))}
    assert leaks.sentences("Fee of Rs. 5. Paid to A. B. Doe vs. Roe. Why? Yes.") == ["Fee of Rs. 5. Paid to A. B. Doe vs. Roe.", "Why?", "Yes."]


def test_empty(spark):
    assert run(spark, []) == set()


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 1500)
    docs = [(i, noise(3) + " ".join(s) + noise(3)) for i, s in ITEMS.items()]
    assert run(spark, docs) == {(i, i) for i in ITEMS}


def brute_tiles(a, b):
    """Greedy string tiling by its definition: the longest run of free elements, again and again."""
    fa, fb, total = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < leaks.TILE:
            return sorted(total)
        total.append(n)
        for k in range(n):
            fa[i + k] = fb[j + k] = False


def test_tiles_against_definition():
    r = random.Random(9)
    for _ in range(60):
        a = np.array([r.randrange(5) for _ in range(r.randrange(0, 40))], np.uint64)
        b = np.array([r.randrange(5) for _ in range(r.randrange(0, 40))], np.uint64)
        tiles = leaks.tile(a, b)
        assert all((a[i : i + n] == b[j : j + n]).all() and n >= leaks.TILE for i, j, n in tiles)
        assert sum(len(set(range(i, i + n))) for i, _, n in tiles) == len({k for i, _, n in tiles for k in range(i, i + n)})
        want = brute_tiles(a.tolist(), b.tolist())
        assert max((n for *_, n in tiles), default=0) == max(want, default=0)
        assert abs(sum(n for *_, n in tiles) - sum(want)) <= 2 * leaks.TILE  # ties may be taken in another order


def found(index, docs):
    h, first = sequences(docs, Hasher())
    out, _ = leaks.search(index, h, first, shingles(h, leaks.TILE))
    need = lambda i, held: (leaks.COVERAGE if max(run for *_, run in held) >= leaks.LONG else leaks.LOOSE) * index.sizes[i]
    return {(d, index.ids[i][0]) for d, i, held in out if sum(n for _, n, _ in held) >= need(i, held)}


def test_recall_by_share_of_changed_words():
    """Whole items with words replaced at random, in texts of other words: none of 15 % changed is lost, few of 20 %."""
    r = random.Random(3)
    items = [(i, " ".join(r.choice(VOCABULARY) for _ in range(r.randrange(60, 150)))) for i in range(200)]
    index = leaks.build_index(items)
    for share, least in ((0, 1), (0.05, 1), (0.1, 1), (0.15, 0.98), (0.2, 0.93)):
        docs = [noise(4) + " ".join(w if r.random() >= share else r.choice(VOCABULARY) for w in text.split()) + " " + noise(4) for _, text in items]
        got = found(index, docs)
        assert sum((i, i) in got for i in range(200)) >= least * 200, share
        assert all(d == i for d, i in got)


def test_evenly_changed_words():
    """One word in N changed leaves no long run; the item is found all the same, however often it is given."""
    item = " ".join(rng.choice(VOCABULARY) for _ in range(120))
    for every in (5, 6, 7, 8, 9, 10, 12):
        text = noise(3) + " ".join(w if k % every else "changed" for k, w in enumerate(item.split(), 1)) + " " + noise(3)
        for times in (1, 5, 50):
            index = leaks.build_index([(i, item) for i in range(times)] + [(100 + i, sentence(60)) for i in range(20)])
            assert index.ids[0] == list(range(times)) and found(index, [text]) == {(0, 0)}


def test_unbroken_third_has_its_anchors():
    r = random.Random(4)
    for _ in range(200):
        words_ = [r.choice(VOCABULARY) for _ in range(r.randrange(12, 200))]
        n = -(-len(words_) // 3)
        at = r.randrange(0, len(words_) - n + 1)
        if n >= leaks.TILE and n >= leaks.LONG:
            assert found(leaks.build_index([(1, " ".join(words_))]), [noise(2) + " ".join(words_[at : at + n]) + " " + noise(2)]) == {(0, 1)}


def test_sequences_are_those_of_single_texts():
    texts = ["", "One two.", "a\0b", "\u0915\u093e e\u0301t\u00e9\u200b \uff21\uff22 \u0130x", "x" * 70_000 + " y", " ", "\ud800 z"]
    h, first = sequences(texts, Hasher())
    each = [Hasher()(t) for t in texts]
    assert [h[a:b].tolist() for a, b in zip(first, first[1:])] == [e.tolist() for e in each]  # noqa: B905
    assert [len(e) for e in each] == [0, 2, 2, 4, 2, 0, 1]
    assert sequences([], Hasher())[0].tolist() == []
