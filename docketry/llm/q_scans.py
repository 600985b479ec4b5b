"""Queries of problem 2: provision texts from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import scans
from docketry.llm.registry import LLM
from docketry.session import materialise, table


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(scans.lines(table(spark, sf_dir, "provisions"), "node_id", "act_id", "act_title", "text", "source_page_start", "source_page_end"))


@LLM.add("p2_found", "SCAN NOISE")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running lines, broken words and misread words, with what they should be."""
    marked = marked_lines(spark, sf_dir)
    words = materialise(scans.repair(materialise(scans.tokens(marked))))
    as_row = lambda rows, damage, repaired: rows.select(F.col("record").alias("node_id"), F.lit(damage).alias("damage"), F.col(repaired).alias("repaired"))
    found = as_row(marked.filter("running"), "running_line", "line")
    found = found.unionByName(as_row(words.filter("broken"), "broken_word", "repaired"))
    return found.unionByName(as_row(words.filter("misread"), "misread_word", "repaired")).distinct()


@LLM.add("p2_paragraphs", "SCAN NOISE")
def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provision text in continuous paragraphs of repaired words."""
    marked = marked_lines(spark, sf_dir)
    words = materialise(scans.tokens(marked, printed=True))
    rows = scans.paragraphs(marked, words, materialise(scans.repair(words)))
    return rows.select(F.col("record").alias("node_id"), "paragraph", "text").distinct()
