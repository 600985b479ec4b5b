"""Evaluation texts inside training text: greedy string tiling over shared-token seeds.

The held-out items are the stated query set: they are held in blocks of a bounded number of characters, each an index of some
tens of MB that every task reads. The documents are read once for all blocks (``RESIDENT`` of them at a time). Seeds are runs
of ``TILE`` words; all of a task's documents are looked up at once. A document meets an item if it holds ``ANCHORS`` of its
anchors, the rarest seeds of every stretch of the item (those in the fewest items), so wording that many items share costs
nothing and an item of nothing but shared wording still has its anchors. Then all seeds count: where those of the document
could carry enough of the item, the two are tiled: the longest common run of unmarked words is marked again and again, by
hashed runs (Karp-Rabin) of ``TILE`` words or more. The passage is the stretch of tiles of the highest score, words covered
less words skipped; tiles may come in another order than in the item. A few changed words between two tiles that follow one
another count as carried. A passage has to carry a third of the item's words; one without any run of ``LONG`` words, which
the wording of template sentences also gives, ``LOOSE`` of them. Tiling sees the whole document; nothing is cut or capped.

Formula sentences do not count: a sentence of an item is a formula if it stands in many unrelated documents, that is
in ``FORMULA_LEAST`` and ``FORMULA_SHARE`` of the documents with words, outside passages of the items that hold it, copies
and near copies of a document counting once: of the documents that share a bucket of minwise hashes of their wording outside
the items, only the first counts. A full stop after an initial, a short number or a short form ends no sentence, so openings that many
documents share are no formula. The words of the passage in such sentences are taken off before the threshold is applied.

An unbroken copy of a third of an item always holds two anchors. Copies with changed words may not: see the recall by share of
changed words in ``tests/llm/test_leaks.py`` and the README.

Defined cases: NULL and empty texts leak nothing; items of fewer words than a seed are found by no seed and not reported;
repeated documents are reported each; repeated items are reported each; ties between passages go to the first.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.pieces import _NO_END
from docketry.llm.words import Hasher, digest, mix, sequences, shingles
from docketry.session import materialise

#: Words of a seed, and of the shortest tile.
TILE = 4
#: An item's anchors: the RAREST seeds of every STRETCH of them. A document has to hold ANCHORS (one, of items of less than SHORT words).
STRETCH, RAREST, ANCHORS, SHORT = 8, 2, 2, 72
#: Words in a row that may be changed, added or left out inside a passage; words in a row of which half at most may be replaced, one for one.
CHANGED, REPLACED = 3, 8
#: Share of an item's words that a passage has to carry: with a run of LONG words, and without one.
COVERAGE, LONG, LOOSE = 1 / 3, 9, 0.45
#: Between sentences of one item's wording (0.05 % of documents at most) and formulas (1.1 to 2.6 %).
FORMULA_SHARE, FORMULA_LEAST = 0.003, 3
#: Near copies, of half their shingles or more, share one of BANDS bands of ROWS minwise hashes with some other; unrelated documents share none.
BANDS, ROWS, WORDING = 20, 8, 5
#: Share of a sentence's seeds that have to stand in a document.
SENTENCE_SHARE = 0.8
#: Characters of the items of one index (about ten bytes of index each), and indexes that a task holds at a time.
BLOCK, RESIDENT = 4_000_000, 8
#: Characters of documents that are looked up at once.
AT_ONCE = 4_000_000

_SENTENCE = re.compile(r"(?<=[.!?।])\s+")


def sentences(text: str) -> list[str]:
    """Sentences in order; a full stop after an initial, a short number or a short form ends none."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if not _NO_END.search(text, max(0, m.start() - 12), m.start()):
            out.append(text[at : m.start()])
            at = m.end()
    return [*out, text[at:]]


def _mark(h: np.ndarray) -> int:
    """64 bits that stand for a sequence of words."""
    return int.from_bytes(digest(h)[:8], "little", signed=True)


def _grouped(pairs: list[tuple[int, ...]], n: int) -> tuple[np.ndarray, ...]:
    """Sorted rows ``(key, value...)`` as the first row of each key below ``n``, and the values."""
    columns = np.array(sorted(pairs), np.int64).reshape(len(pairs), -1).T if pairs else np.zeros((3, 0), np.int64)
    return np.searchsorted(columns[0], np.arange(n + 1)), *columns[1:]


@dataclass
class Index:
    """A block of items: their seeds (numbered in order of their hashes) with the places they stand at."""

    ids: list[list[int]] = field(default_factory=list)  # of the items of equal sentences
    tokens: list[np.ndarray] = field(default_factory=list)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sentence_of: list[np.ndarray] = field(default_factory=list)  # per word, the sentence's number
    sentence_keys: list[int] = field(default_factory=list)  # hash of the sentence's words
    sentence_items: dict[int, set[int]] = field(default_factory=dict)
    sentence_need: np.ndarray = field(default_factory=lambda: np.zeros(0))  # seeds of a sentence that have to stand
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    sieve: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))
    places: tuple = ()  # by seed: item, place
    anchors: tuple = ()  # by seed: item
    sentences: tuple = ()  # by seed: sentence
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # anchors that a document has to hold
    runs: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # of the items tiled so far in a task: places of hashed runs

    def runs_of(self, item: int) -> dict[int, list[int]]:
        if item not in self.runs:
            self.runs[item] = hashed_runs(self.tokens[item])
        return self.runs[item]


def build_index(items: list[tuple[int, str]]) -> Index:
    out, hasher = Index(), Hasher()
    numbers: dict[int, int] = {}
    same: dict[tuple, int] = {}
    of_sentence: set[tuple[int, int]] = set()
    for item_id, text in sorted(items):
        parts = [h for part in sentences(text or "") if len(h := hasher(part))]
        if sum(map(len, parts)) < TILE:
            continue
        at = len(out.ids)
        whole = np.concatenate(parts)
        first = same.setdefault((whole.tobytes(), *map(len, parts)), at)
        if first < at:
            if item_id not in out.ids[first]:
                out.ids[first].append(item_id)
            continue
        marks = []
        for s in parts:
            key = _mark(s)
            n = numbers.setdefault(key, len(numbers))
            if n == len(out.sentence_keys):
                out.sentence_keys.append(key)
            out.sentence_items.setdefault(n, set()).add(at)
            marks.append(np.full(len(s), n))
            if len(s) >= TILE:
                of_sentence.update((g, n) for g in shingles(s, TILE).tolist())
        out.ids.append([item_id])
        out.tokens.append(whole)
        out.sentence_of.append(np.concatenate(marks))
    each = [shingles(h, TILE) for h in out.tokens]
    out.seeds = np.unique(np.concatenate(each)) if each else out.seeds
    number = [np.searchsorted(out.seeds, g).tolist() for g in each]
    held = np.bincount(np.concatenate([np.unique(g) for g in number]), minlength=len(out.seeds)) if number else np.zeros(0, int)
    anchors = {(g, i) for i, row in enumerate(number) for low in range(0, len(row), STRETCH) for g in sorted(set(row[low : low + STRETCH]), key=lambda g: (held[g], g))[:RAREST]}
    out.places = _grouped([(g, i, k) for i, row in enumerate(number) for k, g in enumerate(row)], len(out.seeds))
    out.anchors = _grouped(list(anchors), len(out.seeds))
    out.sentences = _grouped([(int(np.searchsorted(out.seeds, np.uint64(g))), n) for g, n in of_sentence], len(out.seeds))
    out.sizes = np.array([len(h) for h in out.tokens], np.int64)
    out.need = np.where(out.sizes < SHORT, 1, ANCHORS)
    counts = np.bincount(out.sentences[1], minlength=len(numbers))
    out.sentence_need = np.where(counts > 0, np.maximum(1, SENTENCE_SHARE * counts), np.inf)  # shorter ones are no formula
    bits = max(20, int(np.ceil(np.log2(len(out.seeds) * 32 + 1))))
    out.sieve = np.zeros(1 << bits, bool)
    out.sieve[(out.seeds & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return out


def hashed_runs(a: np.ndarray) -> dict[int, list[int]]:
    """Places of every run of ``TILE`` words, by its hash."""
    at: dict[int, list[int]] = defaultdict(list)
    if len(a) >= TILE:
        for i, g in enumerate(shingles(a, TILE).tolist()):
            at[g].append(i)
    return at


def tile(a: np.ndarray, b: np.ndarray, at: dict[int, list[int]] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of ``a`` and ``b``: ``(start in a, start in b, length)``, the longest unmarked runs first.

    ``at``: :func:`hashed_runs` of ``a``, where it is known.
    """
    if len(a) < TILE or len(b) < TILE:
        return []
    at = hashed_runs(a) if at is None else at
    la, lb = a.tolist(), b.tolist()
    heap = []
    for j, g in enumerate(shingles(b, TILE).tolist()):
        if g not in at:
            continue
        for i in at[g]:
            if i and j and la[i - 1] == lb[j - 1]:
                continue  # inside a longer run
            n, most = TILE, min(len(la) - i, len(lb) - j)
            while n < most and la[i + n] == lb[j + n]:
                n += 1
            heap.append((-n, i, j))
    heapq.heapify(heap)
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = free_a[i : i + n] & free_b[j : j + n]
        if free.all():
            free_a[i : i + n] = free_b[j : j + n] = False
            out.append((i, j, n))
            continue
        k = 0
        while k < n:  # what is left of the run waits for its turn
            if free[k]:
                end = k
                while end < n and free[end]:
                    end += 1
                if end - k >= TILE:
                    heapq.heappush(heap, (-(end - k), i + k, j + k))
                k = end
            k += 1
    return out


def _follows(one: tuple[int, int, int], two: tuple[int, int, int], a: list[int], b: list[int]) -> bool:
    """Whether only a few changed words stand between two tiles."""
    i, j = one[0] + one[2], one[1] + one[2]
    x, y = two[0] - i, two[1] - j
    if 0 <= x <= CHANGED and 0 <= y <= CHANGED:
        return True
    return 0 < x == y <= REPLACED and 2 * sum(map(int.__eq__, a[i : i + x], b[j : j + y])) >= x


def passage(tiles: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, run)`` of the words of ``a`` that the best passage of ``b`` carries, in order of ``b``.

    The passage is the run of tiles with the most words covered less words skipped. The few words changed between two
    tiles that follow one another are carried, with a run of 0.
    """
    tiles = sorted(tiles, key=lambda t: t[1])
    la, lb = a.tolist(), b.tolist()
    linked = [k > 0 and _follows(tiles[k - 1], t, la, lb) for k, t in enumerate(tiles)]
    best, best_score, at, score, end = (0, 0), 0, 0, 0, 0
    for k, (_, j, n) in enumerate(tiles):
        skipped = 0 if linked[k] else j - end
        if k == 0 or score - skipped <= 0:
            at, score = k, n
        else:
            score += n - skipped
        end = j + n
        if score > best_score:
            best, best_score = (at, k + 1), score
    out = []
    for k in range(*best):
        i, _, n = tiles[k]
        if k > best[0] and linked[k] and (gap := i - tiles[k - 1][0] - tiles[k - 1][2]):
            out.append((i - gap, gap, 0))
        out.append((i, n, n))
    return out


def _matches(index: Index, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of seeds among the hashed runs of documents, and their numbers."""
    where = np.flatnonzero(index.sieve[(g & np.uint64(len(index.sieve) - 1)).astype(np.int64)])
    if not len(where):
        return where, where
    number = np.minimum(np.searchsorted(index.seeds, g[where]), len(index.seeds) - 1)
    good = index.seeds[number] == g[where]
    return where[good], number[good]


def _expand(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``keys`` the rows it has: (index into keys, row)."""
    n = first[keys + 1] - first[keys]
    owner = np.repeat(np.arange(len(keys)), n)
    return owner, first[keys][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, once each, and how often they stand there."""
    values = np.sort(values)
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return values[first], np.diff(first, append=len(values))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def meetings(index: Index, document: np.ndarray, seed: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, first, word)``: the pairs that may carry enough, ``key = document * items + item``, and the places of their seeds.

    ``word[first[i]:first[i + 1]]`` are those of ``key[i]`` in the document, in order. A pair needs its anchors, and seeds that
    reach over enough of the item's words, gaps of ``REPLACED`` words included: no passage can carry more.
    """
    n = len(index.ids)
    held = _distinct(document * len(index.seeds) + seed)[0]
    owner, row = _expand(index.anchors[0], held % len(index.seeds))
    pair, count = _distinct(held[owner] // len(index.seeds) * n + index.anchors[1][row])
    pair = pair[count >= index.need[pair % n]]
    mine = np.flatnonzero(_among(document, _distinct(pair // n)[0]))
    owner, row = _expand(index.places[0], seed[mine])
    key = document[mine][owner] * n + index.places[1][row]
    good = _among(key, pair)
    key, word, place = key[good], word[mine][owner][good], index.places[2][row][good]
    longest = int(index.sizes.max(initial=0)) + 1
    reached = _distinct(key * longest + place)[0]
    of, step = reached // longest, np.diff(reached, append=np.iinfo(np.int64).max)
    words = np.where(step <= TILE + REPLACED, step, TILE)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    words[np.append(starts[1:], len(words)) - 1] = TILE  # the last of each pair
    enough = np.add.reduceat(words, starts) >= COVERAGE * index.sizes[of[starts] % n] if len(starts) else np.zeros(0, bool)
    pair = of[starts][enough]
    good = _among(key, pair)
    order = np.lexsort((word[good], key[good]))
    key, word = key[good][order], word[good][order]
    return pair, np.searchsorted(key, np.append(pair, np.iinfo(np.int64).max)), word


def best_passage(index: Index, item: int, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, run)`` of the item's words that the best passage of the document ``h`` carries; ``at``: where seeds stand."""
    a = index.tokens[item]
    best: list[tuple[int, int, int]] = []
    # a gap of the words asked for is bridged by no passage that was not enough before it
    for part in np.split(at, np.flatnonzero(np.diff(at) > COVERAGE * len(a) + TILE) + 1):
        step = np.diff(part)
        # words in shared runs, and after each of them as many as may be changed
        if TILE + np.minimum(step, TILE).sum() + REPLACED * np.count_nonzero(step > 1) < COVERAGE * len(a):
            continue
        low, high = max(0, int(part[0]) - len(a)), int(part[-1]) + TILE + len(a)
        held = passage(tile(a, h[low:high], index.runs_of(item)), a, h[low:high])
        if sum(n for _, n, _ in held) > sum(n for _, n, _ in best):
            best = held
    return best if sum(n for _, n, _ in best) >= COVERAGE * len(a) else []


def search(index: Index, h: np.ndarray, first: np.ndarray, g: np.ndarray) -> tuple[list[tuple[int, int, list[tuple[int, int, int]]]], list[tuple[int, int]]]:
    """``(document, item, carried)`` of documents that carry enough of an item as one passage, and ``(document, sentence)`` outside such.

    ``h``, ``first``: the documents' words (:func:`sequences`); ``g``: the hashed runs of ``TILE`` words at them.
    """
    if not len(index.seeds) or not len(g):
        return [], []
    where, seed = _matches(index, g)
    document = np.searchsorted(first, where, "right") - 1
    inside = where + TILE <= first[document + 1]  # no run reaches over the end of a document
    where, seed, document = where[inside], seed[inside], document[inside]
    found, held_in = [], set()
    pair, at, word = meetings(index, document, seed, where)
    for k, key in enumerate(pair.tolist()):
        d, item = divmod(key, len(index.ids))
        held = best_passage(index, item, h[first[d] : first[d + 1]], word[at[k] : at[k + 1]] - first[d])
        if held:
            found.append((d, item, held))
            held_in.add((d, item))
    n = len(index.sentence_need)
    held = _distinct(document * len(index.seeds) + seed)[0]
    owner, row = _expand(index.sentences[0], held % len(index.seeds))
    stands, count = _distinct(held[owner] // len(index.seeds) * n + index.sentences[1][row])
    stands = stands[count >= index.sentence_need[stands % n]]
    outside = [(d, s) for d, s in (divmod(key, n) for key in stands.tolist()) if not any((d, i) in held_in for i in index.sentence_items[s])]
    return found, outside


_ODD = np.random.default_rng(20_240_502).integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bands(indexes: list[Index], h: np.ndarray) -> np.ndarray:
    """A bucket per band of the document's shingles that hold no seed of an item; the same for all documents without any."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    g = shingles(h, TILE)
    taken = np.zeros(len(h), bool)
    for index in indexes:
        taken[_matches(index, g)[0]] = True
    rest = shingles(h, WORDING)
    rest = (rest[~taken[: len(rest)]] >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(rest), 4096):
        np.minimum(low, (rest[None, at : at + 4096] * _ODD[:, None]).min(axis=1), out=low)
    rows = mix(low.astype(np.uint64)).reshape(BANDS, ROWS)
    out = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        out = mix(out * np.uint64(31) + rows[:, j])
    return out.view(np.int64)


_OUT = "kind string, doc_id long, item_id long, item_words int, sentence long, covered int, run int, document long, bands array<long>, documents long"


def _scanner(shared: list):
    def chunks(frame: pd.DataFrame) -> Iterator[tuple[list[int], list[str]]]:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes, hasher = [Index(**block.value) for block in shared], Hasher()
        for frame in frames:
            for ids, texts in chunks(frame):
                h, first = sequences(texts, hasher)
                g = shingles(h, TILE) if len(h) >= TILE else h[:0]
                out: list[tuple] = [("documents", *[None] * 8, int(np.count_nonzero(np.diff(first))))]
                signed: dict[int, tuple[int, np.ndarray]] = {}
                for index in indexes:
                    found, outside = search(index, h, first, g)
                    for d, n in outside:
                        if d not in signed:
                            of = h[first[d] : first[d + 1]]
                            signed[d] = _mark(of), bands(indexes, of)
                        out.append(("sentence", None, None, None, index.sentence_keys[n], None, None, *signed[d], None))
                    for d, i, held in found:
                        marked = np.concatenate([index.sentence_of[i][s : s + n] for s, n, _ in held])
                        longest = np.concatenate([np.full(n, run) for _, n, run in held])
                        for n in np.unique(marked).tolist():
                            covered, run = int(np.count_nonzero(marked == n)), int(longest[marked == n].max())
                            out += [("passage", ids[d], item_id, len(index.tokens[i]), index.sentence_keys[n], covered, run, None, None, None) for item_id in index.ids[i]]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return scan


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", formula_share: float = FORMULA_SHARE) -> DataFrame:
    """``doc_id, item_id, covered, item_words``: documents that carry enough of an item as one passage.

    ``formula_share``: the share of the documents in which a sentence has to stand to be a formula.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text <> ''")
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null and text <> ''").distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    out = None
    for turn in range(0, blocks, RESIDENT):
        shared = []
        for block in range(turn, min(blocks, turn + RESIDENT)):
            rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about BLOCK characters
            shared.append(spark.sparkContext.broadcast(vars(build_index([(r.item_id, r.text) for r in rows]))))
        scanned = materialise(docs.mapInPandas(_scanner(shared), _OUT), partition_by="kind")
        many = FORMULA_LEAST + formula_share * (scanned.filter("kind = 'documents'").agg(F.sum("documents")).first()[0] or 0)
        stands = scanned.filter("kind = 'sentence'")
        often = stands.select("sentence", "document").distinct().groupBy("sentence").count().filter(F.col("count") >= many)
        buckets = stands.join(often, "sentence", "left_semi").select("sentence", "document", F.posexplode("bands").alias("band", "bucket"))
        firsts = buckets.groupBy("sentence", "band", "bucket").agg(F.min("document").alias("document")).groupBy("sentence", "document").count().filter(F.col("count") == BANDS)
        formula = firsts.groupBy("sentence").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= many)
        kept = scanned.filter("kind = 'passage'").join(formula.select("sentence"), "sentence", "left_anti")
        summed = kept.groupBy("doc_id", "item_id", "item_words").agg(F.sum("covered").cast("int").alias("covered"), F.max("run").alias("run"))
        found = summed.filter(F.col("covered") >= F.when(F.col("run") >= LONG, COVERAGE).otherwise(LOOSE) * F.col("item_words"))
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", "item_id", "covered", "item_words")
