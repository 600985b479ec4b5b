"""Queries of problem 8: documents that carry text of the evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import leaks
from docketry.llm.registry import LLM
from docketry.session import materialise, table


def item_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@LLM.add("p8_found", "LEAKAGE")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a third of an item or more as one passage, formula sentences aside."""
    return item_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


@LLM.add("p8_items", "LEAKAGE")
def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the documents that leak it and the largest share of its words in one of them."""
    found = materialise(item_leaks(spark, sf_dir)).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max(F.col("covered") / F.col("item_words")).alias("largest_share"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "split", "task")
    return items.join(found, "item_id", "left").select("item_id", "split", "task", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("largest_share", F.lit(0.0)).alias("largest_share"))
