"""BM25 as tables: index statistics, search for many queries at once, dated evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import terms
from docketry.session import materialise


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.k1 <= 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be positive and b between 0 and 1")


@dataclass
class Index:
    #: term, doc, tf, length; the rows are grouped by term when written
    postings: DataFrame
    #: term, df
    frequencies: DataFrame
    #: one row: n, average
    corpus: DataFrame


def build(documents: DataFrame, doc: str, text: str) -> Index:
    """Postings of the documents with an id and a term; repeated ids are an error of the caller."""
    tokens = documents.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), terms(F.col(text)).alias("t")).filter(F.size("t") > 0)
    counted = tokens.select("doc", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    postings = materialise(counted)
    frequencies = materialise(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    lengths = postings.groupBy("doc").agg(F.first("length").alias("length"))
    return Index(postings, frequencies, materialise(lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))))


def search(index: Index, queries: DataFrame, query: str, text: str, limit: int, settings: Settings = Settings()) -> DataFrame:
    """``query, rank, doc, score``: the ``limit`` best documents of every query.

    A query's terms count once. Scores are compared to nine digits, so that the order of a sum decides nothing, and
    equal ones are ordered by document.
    """
    if limit < 1:
        raise ValueError("limit must be at least one")
    n, average = index.corpus.first() or (0, 0.0)
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).join(index.frequencies, "term")
    asked = asked.withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = F.col("tf") + settings.k1 * (1 - settings.b + settings.b * F.col("length") / F.lit(average))
    hits = asked.join(index.postings, "term").withColumn("part", F.col("idf") * F.col("tf") * (settings.k1 + 1) / norm)
    scores = hits.groupBy("query", "doc").agg(F.round(F.sum("part"), 9).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query", "rank", "doc", "score")


def evidence(index: Index, queries: DataFrame, query: str, text: str, date: str, enacted: DataFrame, top: int, over: int = 20, settings: Settings = Settings()) -> DataFrame:
    """``query, rank, doc, score``: of the ``top * over`` best, the ``top`` best whose ``enacted (doc, since)`` is not later than the date.

    The dates are applied after the cut, as the ranking is defined; undated documents and queries pass.
    """
    wide = search(index, queries, query, text, top * over, settings)
    dated = wide.join(enacted.select("doc", "since"), "doc", "left").join(queries.select(F.col(query).alias("query"), F.col(date).alias("as_of")), "query")
    kept = dated.filter(F.coalesce(F.col("since") <= F.col("as_of"), F.lit(True)))
    w = Window.partitionBy("query").orderBy("rank")
    return kept.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("query", F.col("r").alias("rank"), "doc", "score")
