"""Queries of problem 1: provision references with the attributes in force on the date of the event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.ids import tidy, up_to_last_colon
from docketry.operators import asof
from docketry.registry import CORE
from docketry.session import table

#: Ten years to a period: about sixteen snapshots of a provision since 1869, logs of a handful of entries.
SNAPSHOT_YEARS = 10


def provision_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provision versions as last delivered, keyed by act and section."""
    columns = ["node_id", "node_type", "label", "available_from", "available_to", "attributes", "ingested_at"]
    rows = table(spark, sf_dir, "nodes").select(columns).unionByName(table(spark, sf_dir, "core_nodes").select(columns)).filter("node_id is not null")
    rows = rows.withColumn("node_key", tidy("node_id"))
    latest = asof.latest_delivery(rows.filter(F.col("node_key").startswith("provision:")), "node_key", "ingested_at")
    return latest.filter("node_type = 'provision'").withColumn("section_key", up_to_last_colon(F.col("node_key")))


def dated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``refers_to_provision`` edges with a target, and ``event_date``: their own, else their case's in the examples.

    Only edges without a date of their own meet the examples.
    """
    edges = table(spark, sf_dir, "edges").filter("relation_type = 'refers_to_provision' and target_id is not null")
    edges = edges.select("edge_id", "source_id", "target_id", "source_decision_date", tidy("target_id").alias("target_key"))
    cases = (
        table(spark, sf_dir, "examples").filter("case_id is not null and (decision_date is not null or year is not null)")
        .groupBy(tidy("case_id").alias("case_key"))
        .agg(F.min("decision_date").alias("decided"), F.min("year").alias("year"))
        .select("case_key", F.coalesce("decided", F.make_date("year", F.lit(1), F.lit(1))).alias("case_date"))
    )
    own = edges.filter("source_decision_date is not null").withColumn("event_date", F.col("source_decision_date"))
    borrowed = edges.filter("source_decision_date is null").join(cases, tidy("source_id") == F.col("case_key")).withColumn("event_date", F.col("case_date"))
    return own.unionByName(borrowed.select(own.columns))


def references_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = provision_versions(spark, sf_dir)
    known = asof.build(versions, "section_key", "node_key", "available_from", "available_to", ["node_id", "label", "available_from", "available_to", "attributes"], SNAPSHOT_YEARS)
    return asof.attach(dated_edges(spark, sf_dir), known, up_to_last_colon(F.col("target_key")), F.col("event_date"), into="known")


_SQL = r"""
with raw as (
  select node_id, node_type, label, available_from, available_to, attributes, ingested_at from nodes
  union all select node_id, node_type, label, available_from, available_to, attributes, ingested_at from core_nodes),
latest as (
  select *, lower(trim(node_id)) node_key,
         row_number() over (partition by lower(trim(node_id)) order by ingested_at desc) rn
  from raw where node_id is not null),
versions as (select *, regexp_replace(node_key, '[^:]*$', '') section_key from latest where rn = 1 and node_type = 'provision'),
cases as (
  select lower(trim(case_id)) case_key, coalesce(min(decision_date), make_date(min("year"), 1, 1)) case_date
  from examples group by 1),
dated as (
  select e.edge_id, e.target_id, lower(trim(e.target_id)) target_key, coalesce(e.source_decision_date, c.case_date) event_date
  from edges e left join cases c on c.case_key = lower(trim(e.source_id))
  where e.relation_type = 'refers_to_provision' and e.target_id is not null),
ranked as (
  select d.*, v.node_id, v.node_key, v.label, v.available_from, v.available_to, v.attributes,
         row_number() over (partition by d.edge_id, d.target_key, d.event_date order by coalesce(v.available_from, date '0001-01-01') desc, v.node_key) pick
  from (select distinct * from dated) d join versions v on v.section_key = regexp_replace(d.target_key, '[^:]*$', '')
   and (v.available_from is null or v.available_from <= d.event_date) and (v.available_to is null or v.available_to >= d.event_date)
  where d.event_date is not null)
"""


@CORE.add("p1_found", "AS-OF", sql=_SQL + "select distinct edge_id, node_id from ranked where pick = 1 and node_key <> target_key")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose stored target is not the version in force on the event date, with the version that is."""
    found = references_as_known(spark, sf_dir).filter("known is not null and known.version <> target_key")
    return found.select("edge_id", F.col("known.node_id").alias("node_id")).distinct()


@CORE.add(
    "p1_attributes", "AS-OF",
    sql=_SQL + """
    select d.edge_id, d.event_date, r.node_id as_known_node, r.label as_known_label, r.available_from valid_from, r.available_to valid_to,
           r.attributes['heading'] heading, r.attributes['max_penalty_years'] max_penalty_years
    from (select distinct edge_id, target_key, event_date from dated where event_date is not null) d
    left join (select * from ranked where pick = 1) r using (edge_id, target_key, event_date)""",
)
def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dated reference with the attributes of the version in force; NULL where none was."""
    rows = references_as_known(spark, sf_dir).filter("event_date is not null")
    return rows.select(
        "edge_id", "event_date", F.col("known.node_id").alias("as_known_node"), F.col("known.label").alias("as_known_label"), F.col("known.available_from").alias("valid_from"),
        F.col("known.available_to").alias("valid_to"), F.col("known.attributes")["heading"].alias("heading"), F.col("known.attributes")["max_penalty_years"].alias("max_penalty_years"),
    ).distinct()
