"""Same or near-same records across splits: minwise hashes in banded buckets, verified exactly.

Texts of equal word sequences become one representative first, so a text copied into a third of all rows is one row from
here on. Representatives get minwise signatures of two sets of word shingles, cut into bands: of all runs of ``SHINGLE``
words, and, for texts edited at every few words, of their word pairs without those that stand in ``COMMON`` of all texts (of
copies and near copies met together only one is counted there). Buckets (a band's hash) with both a train and a held-out
representative are the only ones kept; the train members of a large bucket are cut into
blocks of a bounded size, each met by the bucket's held-out members. Every candidate of comparable length is verified on
the whole texts: exact Jaccard similarity of the shingle sets, and the share of the longer text's words that recur in
the other in the same order. Neither buckets nor partners are capped.

A pair of similarity *s* in a set shares one of ``b`` bands of ``ROWS`` rows with probability 1 - (1 - s^ROWS)^b. Near copies
meet by their long runs; with a fifth of the words replaced one by one, word pairs still have a similarity of 0.28 to 0.4.
The measured recall is in ``tests/llm/test_overlap.py`` and the README.

The result comes as links between texts (:func:`links`), with the records that bear them as membership, so copies need
not be expanded; :func:`overlaps` expands them.

Defined cases: NULL texts and texts without words match nothing; a text of fewer words than a shingle is one shingle;
a record in several splits counts in each; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.words import Hasher, common_subsequence, digest, mix, sequences, shingles
from docketry.session import materialise

SHINGLE, PAIR = 5, 2
#: Bands of the runs of SHINGLE words, bands of word pairs, minwise hashes a band.
LONG_BANDS, PAIR_BANDS, ROWS = 16, 80, 3
#: A word pair in so large a share of the texts (and some more) is common; so there are at most 1 / COMMON of those of a text.
COMMON, COMMON_LEAST = 0.05, 20
#: Train members of a bucket that one task holds against its held-out members, as told by one text in TOLD_BY.
BLOCK, TOLD_BY = 2_000, 64


def _signer(bands: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    seeds = rng.integers(1, 2**31, bands * ROWS, dtype=np.uint32)
    return seeds * np.uint32(2) + np.uint32(1), rng.integers(1, 2**63, bands, dtype=np.uint64)


def lowest(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The minwise hashes of a set of shingle hashes (not empty; repeats change nothing)."""
    low = np.full(len(odd), np.iinfo(np.uint32).max, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        # a product with an odd number permutes the 32-bit hashes
        np.minimum(low, (odd[:, None] * high[None, at : at + 1024]).min(axis=1), out=low)
    return low


def band_hashes(low: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band, of the minwise hashes of many texts (a row each)."""
    rows = mix(low.astype(np.uint64)).reshape(len(low), len(salt), ROWS)
    out = np.broadcast_to(salt, rows.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            out = mix(out * np.uint64(31) + rows[:, :, j])
    return out.view(np.int64)


def _texts(records: DataFrame, record: str, text: str, held_out: Column) -> DataFrame:
    rows = records.select(F.col(record).cast("string").alias("record"), held_out.alias("held_out"), F.xxhash64(text).alias("raw"), F.col(text).alias("text"))
    return rows.filter("record is not null and held_out is not null and text is not null and text <> ''")


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for frame in frames:
        h, first = sequences(frame["text"].tolist(), hasher)
        seen: set[int] = set()
        pairs = []
        for a, b in pairwise(first.tolist()):
            if b > a:
                least = int(shingles(h[a:b], SHINGLE).min())  # near copies have the same
                if least not in seen:
                    seen.add(least)
                    pairs.append(np.unique(shingles(h[a:b], PAIR)))
        if pairs:
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            often = n >= max(2, COMMON / 4 * len(pairs))
            yield pd.DataFrame({"pair": pair[often].view(np.int64), "n": n[often], "texts": 0})
            yield pd.DataFrame({"pair": [None], "n": [0], "texts": [len(pairs)]}).astype({"pair": "Int64"})


def common_pairs(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the word pairs that stand in ``COMMON`` of the texts; there are no more than 1 / ``COMMON`` times those of an average text.

    A pair counts where it stands in a quarter of that share of a batch; one that is counted too low costs candidates, no links.
    """
    counted = materialise(texts.select("text").mapInPandas(_count, "pair long, n long, texts long"))
    least = COMMON_LEAST + COMMON * (counted.agg(F.sum("texts")).first()[0] or 0)
    rows = counted.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("pair").collect()
    return np.sort(np.array([r.pair for r in rows], np.int64).view(np.uint64))


def _runs(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The shingles of each text; ``h``, ``first`` as of :func:`sequences`."""
    every = shingles(h, k) if len(h) >= k else h[:0]
    return [every[a : b - k + 1] if b - a >= k else shingles(h[a:b], k) for a, b in pairwise(first.tolist())]


def _signing(shared):
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, common = Hasher(), shared.value
        (odd_long, salt_long), (odd_pair, salt_pair) = _signer(LONG_BANDS, 20_240_501), _signer(PAIR_BANDS, 20_240_503)
        for frame in frames:
            h, first = sequences(frame["text"].tolist(), hasher)
            keep = np.flatnonzero(np.diff(first))
            long, pairs = _runs(h, first, SHINGLE), _runs(h, first, PAIR)
            low_long, low_pair, digests = [], [], []
            for i in keep.tolist():
                rare = pairs[i] if not len(common) else pairs[i][common[np.minimum(np.searchsorted(common, pairs[i]), len(common) - 1)] != pairs[i]]
                low_long.append(lowest(long[i], odd_long))
                low_pair.append(lowest(rare if len(rare) else pairs[i], odd_pair))
                digests.append(digest(h[first[i] : first[i + 1]]))
            bands = np.hstack([band_hashes(np.array(low), salt) for low, salt in ((low_long, salt_long), (low_pair, salt_pair))]) if len(keep) else np.zeros((0, 1), np.int64)
            yield pd.DataFrame({"record": frame["record"].iloc[keep].to_numpy(), "raw": frame["raw"].iloc[keep].to_numpy(), "held_out": frame["held_out"].iloc[keep].to_numpy(), "digest": digests, "n_words": np.diff(first)[keep], "bands": list(bands)})

    return sign


def sign(records: DataFrame, record: str, text: str, held_out: Column) -> DataFrame:
    """``record, raw, held_out, digest, n_words, bands`` of the records with words; ``held_out`` NULL leaves a record out."""
    rows = _texts(records, record, text, held_out)
    shared = records.sparkSession.sparkContext.broadcast(common_pairs(rows))
    return rows.mapInPandas(_signing(shared), "record string, raw long, held_out boolean, digest binary, n_words int, bands array<long>")


def candidates(signed: DataFrame, least_ratio: float) -> DataFrame:
    """``train, held`` digests of different texts that share a bucket, the shorter at least ``least_ratio`` of the longer.

    Up to the pairs a text goes by half of its digest; digests that agree in it only add candidates. Which buckets have to be
    cut into blocks is told from one text in ``TOLD_BY``, chosen by hash: that decides where pairs are made, not which.
    """
    texts = signed.groupBy("digest").agg(F.max(~F.col("held_out")).alias("in_train"), F.max("held_out").alias("in_held"), F.first("n_words").alias("n"), F.first("bands").alias("bands"))
    texts = materialise(texts.withColumn("text", F.xxhash64("digest")))
    told = texts.filter(F.col("in_train") & (F.pmod("text", F.lit(TOLD_BY)) == 0)).select(F.explode("bands").alias("bucket")).groupBy("bucket").agg((F.count(F.lit(1)) * TOLD_BY).alias("trains"))
    hot = materialise(told.filter(F.col("trains") > BLOCK).select("bucket", F.ceil(F.col("trains") / BLOCK).cast("int").alias("blocks")))
    side = lambda which, name, n: texts.filter(which).select(F.explode("bands").alias("bucket"), F.col("text").alias(name), F.col("n").alias(n)).join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    train = side("in_train", "a", "n_a").withColumn("block", F.pmod(F.hash("a"), "blocks")).drop("blocks")
    held = side("in_held", "b", "n_b").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    close = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least_ratio)
    pairs = train.join(held, ["bucket", "block"]).filter((F.col("a") != F.col("b")) & close).select("a", "b").distinct()
    names = lambda key, name: texts.select(F.col("text").alias(key), F.col("digest").alias(name))
    return pairs.join(names("a", "train"), "a").join(names("b", "held"), "b").select("train", "held")


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for frame in frames:
        seen: dict[bytes, tuple] = {}
        jaccard, share = [], []

        def of(key: bytes, text: str, seen: dict = seen) -> tuple:
            if key not in seen:
                h = hasher(text)
                seen[key] = (h.tolist(), np.unique(shingles(h, SHINGLE)))
            return seen[key]

        for a, ta, b, tb in zip(frame["train"], frame["train_text"], frame["held"], frame["held_text"], strict=True):
            (wa, sa), (wb, sb) = of(bytes(a), ta), of(bytes(b), tb)
            common = len(np.intersect1d(sa, sb, assume_unique=True))
            jaccard.append(common / (len(sa) + len(sb) - common))
            share.append(common_subsequence(wa, wb) / max(len(wa), len(wb)))
        yield pd.DataFrame({"train": frame["train"], "held": frame["held"], "jaccard": jaccard, "in_order": share})


def verify(pairs: DataFrame, signed: DataFrame, records: DataFrame, record: str, text: str) -> DataFrame:
    """``train, held, jaccard, in_order`` of candidate digests, on the whole texts of one record each."""
    asked = pairs.select(F.col("train").alias("digest")).unionByName(pairs.select(F.col("held").alias("digest"))).distinct()
    bearer = signed.join(asked, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("record", "raw")).alias("of")).select("digest", "of.*")
    texts = records.select(F.col(record).cast("string").alias("record"), F.xxhash64(text).alias("raw"), F.col(text).alias("text")).join(bearer, ["record", "raw"])
    texts = materialise(texts.groupBy("digest").agg(F.max("text").alias("text")))
    rows = pairs.join(texts.select(F.col("digest").alias("train"), F.col("text").alias("train_text")), "train").join(texts.select(F.col("digest").alias("held"), F.col("text").alias("held_text")), "held")
    return rows.select("train", "train_text", "held", "held_text").mapInPandas(_verify, "train binary, held binary, jaccard double, in_order double")


def links(records: DataFrame, record: str, text: str, held_out: Column, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(train, held, jaccard, in_order)`` of texts (digests) that agree, and their membership ``(record, digest, held_out)``.

    Two texts agree where ``least`` of the words of the longer one recur in the other in the same order. A text that stands in
    train and held-out records alike is a link to itself.
    """
    signed = materialise(sign(records, record, text, held_out))
    near = verify(materialise(candidates(signed, least)), signed, records, record, text).filter(F.col("in_order") >= least)
    same = signed.groupBy("digest").agg(F.max(~F.col("held_out")).alias("t"), F.max("held_out").alias("h")).filter("t and h")
    found = near.unionByName(same.select(F.col("digest").alias("train"), F.col("digest").alias("held"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("in_order")))
    return materialise(found), signed.select("record", "digest", "held_out").distinct()


def overlaps(records: DataFrame, record: str, text: str, held_out: Column, least: float = 0.8) -> DataFrame:
    """``record_train, record_held, jaccard, in_order`` of records in train and held-out splits whose texts agree."""
    found, members = links(records, record, text, held_out, least)
    train = members.filter("not held_out").select(F.col("record").alias("record_train"), F.col("digest").alias("train"))
    held = members.filter("held_out").select(F.col("record").alias("record_held"), F.col("digest").alias("held"))
    return found.join(train, "train").join(held, "held").select("record_train", "record_held", "jaccard", "in_order").filter("record_train <> record_held")


def held_records(found: DataFrame, members: DataFrame) -> DataFrame:
    """``record, links, exact`` of the held-out records with links: to how many train records, and whether one has the same words.

    Links are counted from the number of records of each text; no pair of records is made.
    """
    bearers = members.filter("not held_out").groupBy(F.col("digest").alias("train")).agg(F.count(F.lit(1)).alias("n"))
    per_text = found.join(bearers, "train").groupBy(F.col("held").alias("digest")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("train") == F.col("held"), F.col("n")).otherwise(0)).alias("n_same"))
    held = members.filter("held_out").select("record", "digest")
    # a record that stands on both sides is no link to itself
    own = held.join(members.filter("not held_out").select("record", F.col("digest").alias("train")), "record").join(found.select("train", F.col("held").alias("digest")), ["digest", "train"], "left_semi")
    own = own.groupBy("record", "digest").agg(F.count(F.lit(1)).alias("own"), F.max((F.col("train") == F.col("digest")).cast("int")).alias("own_same"))
    z = lambda c: F.coalesce(c, F.lit(0))
    rows = held.join(per_text, "digest").join(own, ["record", "digest"], "left").select("record", (F.col("n") - z("own")).alias("n"), (F.col("n_same") - z("own_same")).alias("n_same"))
    return rows.filter("n > 0").groupBy("record").agg(F.sum("n").alias("links"), (F.sum("n_same") > 0).alias("exact"))
