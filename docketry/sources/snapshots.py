"""Graph snapshots and ranking indexes as versioned tables: a new version is a new partition, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.graph import DOMAINS, violations
from docketry.operators.ranking import Index
from docketry.sources.sinks import table_digest, write_new

# The types of nodes and the splits.
NODE_TYPES = ("case", "rhetorical_unit", "provision", "contract_clause", "legal_concept", "court", "party", "date_anchor", "act")
SPLITS = ("train", "validation", "test", "external")


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, version: str) -> dict[str, object]:
    """Write a valid graph; the manifest has its counts and digests, which do not depend on the order of rows."""
    broken = violations(nodes, edges).filter("severity = 'error'").limit(3).collect()
    if broken:
        raise ValueError(f"the graph breaks rules: {[tuple(r) for r in broken]}")
    write_new(nodes, f"{root}/nodes/graph_version={version}")
    write_new(edges, f"{root}/edges/graph_version={version}")
    return {"version": version, "nodes": nodes.count(), "edges": edges.count(), "nodes_digest": table_digest(nodes, "node_id"), "edges_digest": table_digest(edges, "edge_id"), "relations": {r.relation_type: r["count"] for r in edges.groupBy("relation_type").count().collect()}}


def read_graph(spark: SparkSession, root: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a version; values outside the enumerations raise."""
    nodes, edges = (spark.read.parquet(f"{root}/{t}/graph_version={version}") for t in ("nodes", "edges"))
    odd = [r[0] for r in nodes.filter(~F.col("node_type").isin(*NODE_TYPES)).select("node_type").union(edges.filter(~F.col("relation_type").isin(*DOMAINS)).select("relation_type")).union(edges.filter(~F.lower(F.trim("origin_split")).isin(*SPLITS)).select("origin_split")).distinct().limit(3).collect()]
    if odd:
        raise ValueError(f"unknown values {odd}")
    return nodes, edges


def write_index(index: Index, root: str, version: str, policy: str | None = None) -> dict[str, object]:
    """The index's tables; it counts as validated only under a policy."""
    for name, rows in (("postings", index.postings), ("frequencies", index.frequencies), ("corpus", index.corpus)):
        write_new(rows, f"{root}/{name}/index_version={version}")
    return {"version": version, "status": "validated" if policy else "draft", "policy_sha256": policy}


def read_index(spark: SparkSession, root: str, version: str) -> Index:
    """The index of a version, if its tables agree: frequencies count postings, every tf is one at least, pairs are unique."""
    index = Index(*(spark.read.parquet(f"{root}/{t}/index_version={version}") for t in ("postings", "frequencies", "corpus")))
    counted = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("least"), F.countDistinct("doc").alias("docs"))
    bad = counted.join(index.frequencies, "term", "full").filter("n is null or df is null or n <> df or least < 1 or docs <> n").limit(3).collect()
    if bad:
        raise ValueError(f"the index does not agree with itself: {[r.term for r in bad]}")
    return index
