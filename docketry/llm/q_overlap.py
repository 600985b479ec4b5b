"""Queries of problem 4: held-out judgments that also stand in a train judgment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import overlap
from docketry.llm.registry import LLM
from docketry.session import table


def held_out(split: str = "origin_split") -> Column:
    """Whether a record is held out; NULL for other splits."""
    name = F.lower(F.trim(split))
    return F.when(name == "train", False).when(name.isin("validation", "test"), True)


def judgment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "judgments"), "case_id", "text", held_out())


@LLM.add("p4_found", "CROSS-SPLIT")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a held-out judgment of (nearly) the same text."""
    found = judgment_overlaps(spark, sf_dir)
    return found.select(F.least("record_train", "record_held").alias("case_id_a"), F.greatest("record_train", "record_held").alias("case_id_b")).distinct()


@LLM.add("p4_report", "CROSS-SPLIT")
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out split and source: its judgments, those that stand in train too, exactly or almost, and the links."""
    per_case = overlap.held_records(*overlap.links(table(spark, sf_dir, "judgments"), "case_id", "text", held_out())).withColumnRenamed("record", "case_id")
    sources = table(spark, sf_dir, "examples").filter("case_id is not null").groupBy("case_id").agg(F.max("source").alias("source"))
    cases = table(spark, sf_dir, "judgments").filter(held_out()).select("case_id", F.lower(F.trim("origin_split")).alias("split")).distinct()
    rows = cases.join(per_case, "case_id", "left").join(sources, "case_id", "left").groupBy("split", F.coalesce("source", F.lit("")).alias("source"))
    return rows.agg(
        F.count(F.lit(1)).alias("judgments"), F.count("links").alias("leaked"), F.count_if(F.col("exact")).alias("leaked_exactly"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
    )
