"""Queries of problem 6: references that name no record present at their time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.ids import tidy
from docketry.operators import orphans
from docketry.registry import CORE
from docketry.session import materialise, table

#: A batch of the ledger: a year of references, arrivals and deletions.
BATCH = "year"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_table, ref_id, key, at``; keys are ``id|`` and a whole id, or ``prefix|`` and what a provision's id begins with."""
    whole = lambda c: F.concat(F.lit("id|"), tidy(c))
    resolved = table(spark, sf_dir, "resolutions").filter("resolved_target_id is not null")
    hint = F.when(F.col("kind") == "provision", F.concat(F.lit("prefix|"), tidy("canonical_hint"))).otherwise(whole("canonical_hint"))
    unresolved = table(spark, sf_dir, "candidates").join(resolved.select("extraction_id").distinct(), "extraction_id", "left_anti")
    parts = [
        ("edges", "edge_id", table(spark, sf_dir, "edges").select("edge_id", F.col("ingested_at").alias("at"), whole("target_id").alias("key"))),
        ("resolutions", "extraction_id", table(spark, sf_dir, "resolutions").select("extraction_id", F.col("resolved_at").alias("at"), whole("resolved_target_id").alias("key"))),
        ("candidates", "extraction_id", unresolved.select("extraction_id", F.col("extracted_at").alias("at"), hint.alias("key"))),
    ]
    dated = [orphans.earliest(rows, key, "at", "key").select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), "key", "at") for name, key, rows in parts]
    return reduce(DataFrame.unionByName, dated)


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, arrived, withdrawn``: each node under its id, provisions also under what their id begins with, up to each colon."""
    columns = ["node_id", "node_type", "ingested_at", "withdrawn_at"]
    rows = table(spark, sf_dir, "nodes").select(columns).unionByName(table(spark, sf_dir, "core_nodes").select(columns)).filter("node_id is not null")
    nodes = rows.groupBy(tidy("node_id").alias("id")).agg(F.min("ingested_at").alias("arrived"), F.min("withdrawn_at").alias("withdrawn"), F.max(F.col("node_type") == "provision").alias("provision"))
    colons = F.size(F.split("id", ":")) - 1
    prefixes = F.expr("transform(sequence(1, size(split(id, ':')) - 1), i -> concat('prefix|', substring_index(id, ':', i), ':'))")
    keys = F.concat(F.array(F.concat(F.lit("id|"), "id")), F.when(F.col("provision") & (colons > 0), prefixes).otherwise(F.array().cast("array<string>")))
    return nodes.select(F.explode(keys).alias("key"), "arrived", "withdrawn")


def through_ledger(spark: SparkSession, sf_dir: str) -> tuple[orphans.Ledger, list[DataFrame]]:
    """The ledger after all batches, in order of time, and the cases each decided. Only keys that some reference has enter it."""
    unit = lambda df: df.filter("at is not null").withColumn("batch", F.year("at"))
    refs = materialise(unit(references(spark, sf_dir)), partition_by="batch")
    asked = refs.filter("key is not null").select("key").distinct()
    events = materialise(unit(orphans.parent_events(parents(spark, sf_dir).join(asked, "key", "left_semi"))), partition_by="batch")
    batches = sorted({r.batch for df in (refs, events) for r in df.select("batch").distinct().collect()})  # years
    ledger, decided = orphans.Ledger(), []
    for batch in batches or [0]:
        ledger, cases = orphans.advance(ledger, refs.filter(F.col("batch") == batch).drop("batch"), events.filter(F.col("batch") == batch).drop("batch"))
        decided.append(cases)
    return ledger, decided


def ledger_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, decided = through_ledger(spark, sf_dir)
    return reduce(DataFrame.unionByName, [*decided, orphans.close(ledger)])


_SQL = """
with allnodes as (select node_id, node_type, ingested_at, withdrawn_at from nodes union all select node_id, node_type, ingested_at, withdrawn_at from core_nodes),
present as (
  select lower(trim(node_id)) id, min(ingested_at) arrived, min(withdrawn_at) gone, bool_or(node_type = 'provision') provision
  from allnodes where node_id is not null group by 1),
keyed as (
  select 'id|' || id as key, arrived, gone from present
  union all select 'prefix|' || regexp_replace(id, '[^:]*$', ''), arrived, gone from present where provision),
refs as (
  select 'edges' ref_table, edge_id ref_id, 'id|' || lower(trim(target_id)) as key, min(ingested_at) over (partition by edge_id) as made from edges
  union all select 'resolutions', extraction_id, 'id|' || lower(trim(resolved_target_id)), min(resolved_at) over (partition by extraction_id) from resolutions
  union all select 'candidates', extraction_id, case when kind = 'provision' then 'prefix|' else 'id|' end || lower(trim(canonical_hint)), min(extracted_at) over (partition by extraction_id)
  from candidates c where not exists (select 1 from resolutions r where r.extraction_id = c.extraction_id and r.resolved_target_id is not null)),
probed as (
  select ref_table, ref_id, r.key, made, bool_or(arrived <= made and (gone is null or gone > made)) is_there, min(arrived) first_arrival
  from (select distinct * from refs where key is not null) r left join keyed k on k.key = r.key group by all),
found as (
  select ref_table, ref_id, case when first_arrival is null then 'missing' when first_arrival > made then 'late' else 'deleted' end reason, strftime(made, '%Y-%m') period
  from probed where not coalesce(is_there, false))
"""


@CORE.add("p6_found", "ORPHANS", sql=_SQL + "select distinct ref_table, ref_id, reason, period from found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that named no node present at their time, with what became of it."""
    return ledger_cases(spark, sf_dir).select("ref_table", "ref_id", "reason", F.date_format("at", "yyyy-MM").alias("period")).distinct()


@CORE.add("p6_report", "ORPHANS", sql=_SQL + "select ref_table, period, reason, count(distinct ref_id) orphans from found group by 1, 2, 3")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return p6_found(spark, sf_dir).groupBy("ref_table", "period", "reason").agg(F.countDistinct("ref_id").alias("orphans"))


@CORE.add(
    "p6_open_by_month", "ORPHANS",
    sql=_SQL + """, months as (select distinct strftime(made, '%Y-%m') m from refs union select distinct strftime(t, '%Y-%m') from (select arrived t from keyed union all select gone from keyed) where t is not null),
    at_end as (
      select ref_table, m, r.ref_id, r.key, bool_or(strftime(arrived, '%Y-%m') <= m and (gone is null or strftime(gone, '%Y-%m') > m)) is_there
      from (select distinct * from refs where key is not null) r join months on strftime(r.made, '%Y-%m') <= m left join keyed k on k.key = r.key group by all)
    select ref_table, m "month", count(*) open_orphans from at_end where not coalesce(is_there, false) group by 1, 2 having count(*) > 0""",
)
def p6_open_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References open at the end of each month: made by then, their key not live then; from the ledger's snapshots."""
    ledger, _ = through_ledger(spark, sf_dir)
    months = orphans.parent_events(parents(spark, sf_dir)).select(F.date_format("at", "yyyy-MM").alias("month")).distinct()
    return orphans.open_by_month(ledger, months).filter("open > 0").select("ref_table", "month", F.col("open").alias("open_orphans"))
