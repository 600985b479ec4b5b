"""Queries of problem 7: documents in containers of an experiment's max_seq_length tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import packing
from docketry.llm.registry import LLM
from docketry.session import materialise, table


@LLM.add("p7_containers", "PACKING")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or each part of one larger than a container, with its container, for every experiment."""
    rows = table(spark, sf_dir, "configs").filter("experiment_id is not null").select("experiment_id", "max_seq_length").distinct().collect()  # a few experiments
    return packing.pack(packing.measure(table(spark, sf_dir, "documents")), [tuple(r) for r in rows])


@LLM.add("p7_fill", "PACKING")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment: containers, documents, and the share of the containers' room that is used."""
    capacities = table(spark, sf_dir, "configs").select("experiment_id", "max_seq_length").distinct()
    rows = p7_containers(spark, sf_dir).groupBy("experiment_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    totals = rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"))
    return totals.join(capacities, "experiment_id").select("experiment_id", "containers", "items", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("max_seq_length")), 6).alias("fill"))


@LLM.add("p7_checks", "PACKING", sql="""
with d as (select doc_id from documents where doc_id is not null and text is not null and text <> ''), c as (select distinct experiment_id from configs where experiment_id is not null and max_seq_length > 0)
select experiment_id, count(*) documents, 0::bigint over_capacity, 0::bigint divided_though_small, 0::bigint not_whole from d, c group by 1""")  # fmt: skip
def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment: documents packed; containers over their capacity; documents divided though they fit one; documents of which a token is lost or twice there."""
    capacities = table(spark, sf_dir, "configs").filter("experiment_id is not null").select("experiment_id", "max_seq_length").distinct()
    measured = materialise(packing.measure(table(spark, sf_dir, "documents")))
    packed = materialise(packing.pack(measured, [tuple(r) for r in capacities.collect()]))  # a few experiments
    over = packed.groupBy("experiment_id", "container_id").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(capacities), "experiment_id")
    over = over.groupBy("experiment_id").agg(F.count_if(F.col("used") > F.col("max_seq_length")).alias("over_capacity"))
    each = packed.groupBy("experiment_id", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("placed"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach")).join(measured.select("doc_id", F.col("n_tokens").alias("size")), "doc_id")
    each = each.join(F.broadcast(capacities), "experiment_id").groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("max_seq_length"))).alias("divided_though_small"), F.count_if((F.col("placed") != F.col("size")) | (F.col("reach") != F.col("size"))).alias("not_whole"),
    )
    return each.join(over, "experiment_id").select("experiment_id", "documents", "over_capacity", "divided_though_small", "not_whole")
