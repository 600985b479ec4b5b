"""Count-based classification in SQL, feature vectors in long form, and small model utilities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import LABELS, words
from docketry.session import materialise


@dataclass
class Model:
    #: label, documents, tokens (all four labels)
    classes: DataFrame
    #: token, label, n
    counts: DataFrame
    #: token
    vocabulary: DataFrame
    size: int
    documents: int
    alpha: float


def fit(train: DataFrame, case: str, text: str, label: str, vocabulary: int = 2000, alpha: float = 1.0) -> Model:
    """Multinomial naive Bayes; the vocabulary is what most documents hold, ties in the order of the alphabet."""
    tokens = materialise(train.select(F.col(case).alias("case"), F.col(label).alias("label"), F.explode(words(F.col(text))).alias("token")).groupBy("case", "label", "token").agg(F.count(F.lit(1)).alias("n")))
    kept = materialise(tokens.groupBy("token").agg(F.countDistinct("case").alias("df")).orderBy(F.desc("df"), "token").limit(vocabulary).select("token"))
    counts = materialise(tokens.join(F.broadcast(kept), "token").groupBy("token", "label").agg(F.sum("n").alias("n")))  # at most `vocabulary` rows
    named = train.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    documents = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("documents"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("tokens"))
    classes = named.join(documents, "label", "left").join(totals, "label", "left").na.fill(0, ["documents", "tokens"])
    return Model(materialise(classes), counts, kept, kept.count(), train.count(), alpha)


def predict(model: Model, cases: DataFrame, case: str, text: str) -> DataFrame:
    """``case, label, score, probability`` of each case and label; a case without a known word has the priors."""
    a, v = model.alpha, model.size
    prior = F.log((F.col("documents") + a) / (model.documents + a * len(LABELS)))
    room = F.col("tokens") + a * v
    classes = F.broadcast(model.classes.select("label", prior.alias("prior"), room.alias("room")))  # four rows
    found = cases.select(F.col(case).alias("case"), F.explode(words(F.col(text))).alias("token")).groupBy("case", "token").agg(F.count(F.lit(1)).alias("f")).join(F.broadcast(model.vocabulary), "token")
    grid = found.withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS]))).join(F.broadcast(model.counts), ["token", "label"], "left").join(classes, "label")
    sums = grid.groupBy("case", "label").agg(F.sum(F.col("f") * F.log((F.coalesce("n", F.lit(0)) + a) / F.col("room"))).alias("likelihood"))
    every = cases.select(F.col(case).alias("case")).distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS]))).join(classes, "label").join(sums, ["case", "label"], "left")
    scored = every.withColumn("score", F.col("prior") + F.coalesce("likelihood", F.lit(0.0)))
    w = Window.partitionBy("case")
    shifted = F.exp(F.col("score") - F.max("score").over(w))
    return scored.withColumn("e", shifted).select("case", "label", "score", (F.col("e") / F.sum("e").over(w)).alias("probability"))


def best(predictions: DataFrame, digits: int = 8) -> DataFrame:
    """``case, label, probability``: the likeliest label, of equal ones the last in the alphabet."""
    p = F.round("probability", digits)
    return predictions.groupBy("case").agg(F.max(F.struct(p.alias("probability"), "label")).alias("m")).select("case", "m.label", "m.probability")


def pick_label(scores: dict[str, Column]) -> Column:
    """The label of the largest score, of equal ones the first in the order of the schema."""
    return F.greatest(*[F.struct(c.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("label")) for i, (name, c) in enumerate(scores.items())])["label"]


def tfidf(documents: DataFrame, doc: str, text: str, least: int = 2) -> DataFrame:
    """``doc, term, weight``: sublinear tf, smoothed idf, unit length, over words and pairs of words in ``least`` documents or more."""
    t = documents.select(F.col(doc).alias("doc"), words(F.col(text)).alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    counted = t.select("doc", F.explode(F.concat("t", pairs)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = materialise(counted)
    n = documents.count()
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    weighted = counted.join(df, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def bags(cases: DataFrame, case: str, blocks: dict[str, Column], least: int = 2) -> DataFrame:
    """``case, block, feature`` of the features (an array per block) that ``least`` cases have at least, each once."""
    parts = [cases.select(case, F.lit(name).alias("block"), F.explode(F.array_distinct(features)).alias("feature")) for name, features in blocks.items()]
    rows = reduce(DataFrame.unionByName, parts)
    known = rows.groupBy("block", "feature").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least).select("block", "feature")
    return rows.join(known, ["block", "feature"])


def stack(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The features of :func:`bags` with a ``value``: every case's block has the length that ``weights`` gives it."""
    case = next(c for c in rows.columns if c not in ("block", "feature"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("block"))
    sizes = rows.groupBy(case, "block").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, [case, "block"]).select(case, "block", "feature", (weight / F.sqrt("n")).alias("value"))


def averaged(rows: DataFrame, case: str, p: str, q: str, digits: int = 8) -> DataFrame:
    """``case, label, mean``: the label of the largest mean of two probabilities, of equal ones the first of the schema."""
    order = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label"))
    mean = rows.withColumn("mean", F.round((F.col(p) + F.col(q)) / 2, digits))
    return mean.groupBy(case).agg(F.min_by(F.struct("label", "mean"), F.struct((-F.col("mean")).alias("m"), order.alias("o"))).alias("b")).select(case, "b.*")


def class_weights(counts: DataFrame) -> DataFrame:
    """``label, weight`` of ``label, n``: n / (k n_c), scaled so that the mean over examples is 1."""
    w = Window.partitionBy()  # a row per label
    raw = F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
    rows = counts.withColumn("raw", raw)
    return rows.select("label", "n", (F.col("raw") * F.sum("n").over(w) / F.sum(F.col("raw") * F.col("n")).over(w)).alias("weight"))


def learning_rate(update: Column, total: int, warmup_ratio: float, schedule: str) -> Column:
    """Factor of the rate at an update: linear warm-up, then constant or linear decay."""
    warmup = int(total * warmup_ratio)
    after = F.greatest(F.lit(0.0), (F.lit(total) - update) / F.lit(max(1, total - warmup))) if schedule == "linear" else F.lit(1.0)
    return F.when(update < warmup, (update + 1) / F.lit(warmup)).otherwise(after) if warmup else after
