"""Prompts within a token budget, prefix assembly, cache keys, offset calibration: small pieces around a scorer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import LABELS
from docketry.sources.sinks import content_id

IGNORED = -100


def prompt(evidence: Column, instruction: Column, body: Column, cue: Column, budget: int, evidence_cap: int) -> Column:
    """Token arrays in a row: evidence up to its cap, the instruction, as much of the body as fits, the cue."""
    head = F.concat(F.slice(evidence, 1, evidence_cap), instruction)
    room = F.greatest(F.lit(0), F.lit(budget) - F.size(head) - F.size(cue))
    return F.concat(head, F.slice(body, F.lit(1), room), cue)


def with_prefix(prefix: Column, prompt_vectors: Column, target_vectors: Column, target_ids: Column) -> Column:
    """Vectors, mask and labels of a prefixed prompt: only the target's tokens are learnt."""
    size = F.size(prefix) + F.size(prompt_vectors) + F.size(target_vectors)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prefix) + F.size(prompt_vectors)), target_ids)
    return F.struct(F.concat(prefix, prompt_vectors, target_vectors).alias("vectors"), F.array_repeat(F.lit(1), size).alias("mask"), labels.alias("labels"))


def cache_key(request: Mapping[str, object], config: Mapping[str, object], graph_version: str) -> str:
    """The content id of a retrieval: equal requests have equal keys, whatever the order of their seeds, splits and relations.

    No relation set (all are allowed) and an empty one differ.
    """
    tidy = {k: sorted(v) if isinstance(v, (list, tuple, set, frozenset)) else v for k, v in request.items()}
    return "sha256:" + content_id({"graph": graph_version, "request": tidy, "config": dict(config)})


def calibrate(scores: DataFrame, grid: Sequence[float], rounds: int = 3) -> dict[str, float]:
    """Offsets per label that raise macro-F1 on ``case, gold, label, score`` (out-of-fold log-probabilities).

    A coordinate search: per round and label all grid values are scored in one plan, as rows, not cases, times values.
    """
    offsets = dict.fromkeys(LABELS, 0.0)
    for _ in range(rounds):
        for label in LABELS:
            add = F.element_at(F.create_map(*[F.lit(x) for k, v in offsets.items() for x in (k, float(v))]), F.col("label"))
            tried = scores.withColumn("g", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
            moved = tried.withColumn("s", F.col("score") + F.when(F.col("label") == label, F.col("g")).otherwise(add))
            picked = moved.groupBy("g", "case", "gold").agg(F.max(F.struct("s", "label")).alias("m")).select("g", "gold", F.col("m.label").alias("predicted"))
            from docketry.operators.evaluate import summary

            best = summary(picked, "g").orderBy(F.desc(F.round("macro_f1", 12)), F.abs("g"), "g").first()
            if best is not None:
                offsets[label] = float(best.g)
    return offsets


def mean_pool(vectors: DataFrame, owner: str, vector: str) -> DataFrame:
    """``owner, vector``: the mean of an owner's vectors, position by position."""
    rows = vectors.select(owner, F.posexplode(vector).alias("i", "v")).groupBy(owner, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return rows.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(vector))


def attention_pool(vector_list: Column, query: Column) -> Column:
    """The mean of vectors weighted by the softmax of their products with a query vector; NULL of none."""
    dot = lambda v: F.aggregate(F.zip_with(v, query, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scores = F.transform(vector_list, dot)
    weights = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    scaled = F.zip_with(vector_list, weights, lambda v, w: F.transform(v, lambda x: x * w / total))
    return F.when(F.size(vector_list) > 0, F.aggregate(F.slice(scaled, 2, F.size(scaled)), F.get(scaled, F.lit(0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)))
