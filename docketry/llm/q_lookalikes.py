"""Queries of problem 9: documents that read the same on the page but differ in their characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import lookalikes
from docketry.llm.registry import LLM
from docketry.session import materialise, table


@LLM.add("p9_found", "ONE FORM")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of different characters and one form."""
    return lookalikes.pairs(materialise(lookalikes.classes(materialise(lookalikes.forms(table(spark, sf_dir, "documents"))))))


@LLM.add("p9_classes", "ONE FORM")
def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a text: its class (the smallest doc_id of the same form) and whether the class has other variants."""
    formed = materialise(lookalikes.forms(table(spark, sf_dir, "documents")))
    heads = formed.groupBy("form").agg(F.min("doc_id").alias("class_id"), (F.min("raw") != F.max("raw")).alias("varies"))
    return formed.join(heads, "form").select("doc_id", "class_id", "varies")


@LLM.add("p9_forms", "ONE FORM")
def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    return lookalikes.repair(table(spark, sf_dir, "documents"))
