"""Filling containers of fixed capacity: conflict-constrained best fit over residual-ordered bins.

Documents are measured in tokens; one that is larger than a container is divided into full containers and a rest, no
other is divided. Documents and rests are dealt by a hash into shards of about ``SHARD`` items, each packed by one task,
the largest first. The bins of a shard are ordered by what is left in them: a bit set of the residuals in use gives the
successor of an item's size, and the search goes on from there to the tightest bin that is compatible. Every bin carries
bit maps of the sources and the duplicate clusters in it, every residual the bits that all its bins share, so a residual
without a compatible bin is passed in one step.

Two documents of one duplicate cluster (equal words in order) never share a bin. Two of one source do so only where no
bin without that source has room: the rule orders bins, it opens none, so a source with a third of all documents
costs no space.

Defined cases: NULL and empty texts have no tokens and are not packed; a NULL source is no source; repeated documents are
packed each; ties in size go by document id, so the packing is the same for any order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.tokens import TOKENIZER, Counter
from docketry.llm.words import Hasher, digest, sequences
from docketry.session import materialise

SHARD = 20_000


def _measurer(tokenizer: str):
    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, hasher = Counter(tokenizer), Hasher()
        for frame in frames:
            h, first = sequences(frame["text"].tolist(), hasher)
            clusters = [int.from_bytes(digest(h[a:b])[:8], "little", signed=True) for a, b in pairwise(first.tolist())]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "n_tokens": [counter.exact(t) for t in frame["text"]], "cluster": clusters})

    return measure


def measure(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens, cluster`` of the documents with a text."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text <> ''")
    return rows.mapInPandas(_measurer(tokenizer), "doc_id long, source string, n_tokens int, cluster long")


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item, items in the order they are placed. A source or cluster is a bit; 0 is none."""
    rows: dict[int, list[int]] = {}  # residual: its bins
    shared: dict[int, list[int]] = {}  # residual: source and cluster bits common to all its bins
    used = 0  # bit r: some bin has the residual r
    has_source: list[int] = []
    has_cluster: list[int] = []
    out: list[int] = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        chosen = -1
        second = None  # the tightest bin that is compatible but for the source
        at = used >> size << size
        while at:
            r = (at & -at).bit_length() - 1
            at &= at - 1
            common = shared[r]
            if cluster & common[1] or (source & common[0] and second is not None):
                continue
            for k, b in enumerate(rows[r]):
                if cluster & has_cluster[b]:
                    continue
                if source & has_source[b]:
                    if second is None:
                        second = (r, k)
                    continue
                chosen = b
                break
            if chosen >= 0:
                break
        else:
            if second is not None:
                r, k = second
                chosen = rows[r][k]
        if chosen >= 0:
            bins = rows[r]
            bins[k] = bins[-1]
            bins.pop()
            if not bins:
                used &= ~(1 << r)
                del rows[r], shared[r]
            left = r - size
        else:
            chosen, left = len(has_source), capacity - size
            has_source.append(0)
            has_cluster.append(0)
        has_source[chosen] |= source
        has_cluster[chosen] |= cluster
        out.append(chosen)
        if left:
            if left in rows:
                rows[left].append(chosen)
                shared[left][0] &= has_source[chosen]
                shared[left][1] &= has_cluster[chosen]
            else:
                rows[left] = [chosen]
                shared[left] = [has_source[chosen], has_cluster[chosen]]
                used |= 1 << left
    return out


def _bits(values: pd.Series, repeated_only: bool) -> list[int]:
    """A bit for each value; values that conflict with nothing in the shard need none."""
    codes, _ = pd.factorize(values)
    counts = np.bincount(codes[codes >= 0], minlength=1) if len(codes) else np.zeros(1)
    number = np.cumsum(counts > 1) - 1
    return [0 if c < 0 or (repeated_only and counts[c] < 2) else 1 << int(number[c] if repeated_only else c) for c in codes.tolist()]


_PACKED = "experiment_id string, container_id string, doc_id long, piece_no int, start_token int, n_tokens int"


def _pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    name, shard = key
    frame = frame.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    bins = best_fit(frame["n_tokens"].tolist(), _bits(frame["source"], False), _bits(frame["cluster"], True), int(frame["capacity"].iloc[0]))
    return pd.DataFrame({
        "experiment_id": frame["experiment_id"], "container_id": [f"{name}|{shard}|{b}" for b in bins], "doc_id": frame["doc_id"],
        "piece_no": frame["piece_no"], "start_token": frame["start_token"], "n_tokens": frame["n_tokens"],
    })


def pack(measured: DataFrame, capacities: list[tuple[str, int]], shard: int = SHARD) -> DataFrame:
    """``experiment_id, container_id, doc_id, piece_no, start_token, n_tokens`` for every ``(experiment, capacity)``.

    ``shard``: items that one task packs; a shard leaves its last containers part filled, so larger ones lose less.
    """
    measured = materialise(measured)
    shards = max(1, -(-measured.count() // shard))
    capacities = [(name, capacity) for name, capacity in capacities if capacity and capacity > 0]
    if not capacities:
        return measured.sparkSession.createDataFrame([], _PACKED)
    each = F.array(*[F.struct(F.lit(name).alias("experiment_id"), F.lit(capacity).alias("capacity")) for name, capacity in capacities])
    items = measured.filter("n_tokens > 0").select("*", F.explode(each).alias("e")).select("*", "e.*").drop("e")
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    rest = F.col("n_tokens") % F.col("capacity")
    items = items.withColumn("full", full)
    whole = items.filter("full > 0").select(
        "experiment_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"),
    ).select("experiment_id", F.concat_ws("|", "experiment_id", F.lit("full"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    rests = items.filter(rest > 0).select("experiment_id", "capacity", "doc_id", "source", "cluster", F.col("full").alias("piece_no"), (F.col("full") * F.col("capacity")).alias("start_token"), rest.alias("n_tokens"))
    packed = rests.groupBy("experiment_id", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")).applyInPandas(_pack, _PACKED)
    return whole.unionByName(packed)
