"""Queries of problem 5: judgments longer than an experiment's limits, in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import pieces
from docketry.llm.registry import LLM
from docketry.session import table


def configurations(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """The experiments (a table of a few rows) as ``(name, characters, tokens, overlap)``."""
    return [tuple(r) for r in table(spark, sf_dir, "configs").filter("experiment_id is not null").select("experiment_id", "input_character_limit", "max_seq_length", "piece_overlap").distinct().collect()]


@LLM.add(
    "p5_found", "PIECES",
    sql="select distinct experiment_id, case_id from judgments, configs where case_id is not null and input_character_limit > 0 and length(text) > input_character_limit",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments that come out in more than one piece under the character limit."""
    parts = pieces.split(table(spark, sf_dir, "judgments"), "case_id", "text", configurations(spark, sf_dir), by_tokens=False, with_text=False)
    return parts.filter("piece_no = 1").select("experiment_id", F.col("record").alias("case_id")).distinct()


@LLM.add("p5_pieces", "PIECES")
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judgment in pieces within both limits of every experiment."""
    rows = table(spark, sf_dir, "judgments").select("case_id", "text").distinct()
    parts = pieces.split(rows, "case_id", "text", configurations(spark, sf_dir))
    return parts.select("experiment_id", F.col("record").alias("case_id"), "piece_no", "n_pieces", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "n_shared", "n_tokens", "text")


@LLM.add("p5_checks", "PIECES", sql="""
with t as (select distinct case_id, text from judgments where case_id is not null and text is not null and text <> ''), c as (select distinct experiment_id, input_character_limit, piece_overlap from configs where experiment_id is not null)
select experiment_id, count(*) texts, sum(length(text))::bigint characters, 0::bigint over_the_limit, 0::bigint gaps, 0::bigint not_as_asked from t, c group by 1""")  # fmt: skip
def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment: texts, the characters of their pieces without what they share, and pieces over the character limit, after a gap, or sharing other than asked."""
    rows = table(spark, sf_dir, "judgments").select("case_id", "text").distinct()
    parts = pieces.split(rows, "case_id", "text", configurations(spark, sf_dir), by_tokens=False, with_text=False)
    limits = table(spark, sf_dir, "configs").select("experiment_id", "input_character_limit", F.coalesce("piece_overlap", F.lit(0)).alias("asked")).distinct()
    size, limit = F.col("end") - F.col("start"), F.col("input_character_limit")
    each = parts.join(F.broadcast(limits), "experiment_id")  # a row per experiment
    return each.groupBy("experiment_id").agg(
        F.count_if(F.col("piece_no") == 0).alias("texts"), F.sum(size - F.col("n_shared")).alias("characters"), F.count_if((limit > 0) & (size > limit)).alias("over_the_limit"),
        F.count_if(F.col("n_shared") < 0).alias("gaps"), F.count_if((F.col("piece_no") > 0) & (F.col("n_shared") != F.col("asked"))).alias("not_as_asked"),
    )
