"""Queries of reference extraction and statute splitting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import references
from docketry.operators import statutes
from docketry.registry import CORE
from docketry.session import materialise, table


def act_grammar(spark: SparkSession, sf_dir: str) -> references.Grammar:
    """The grammar of the acts in the node tables, by title (with or without year) and by id; a registry of some dozens."""
    nodes = [table(spark, sf_dir, t).filter("node_type = 'act' and node_id is not null and label is not null").select("node_id", "label") for t in ("nodes", "core_nodes")]
    acts, names = {}, {"(?!)"}  # matches nothing: there may be no act
    for r in nodes[0].unionByName(nodes[1]).distinct().collect():
        act, title = r.node_id.strip().lower().split(":")[-1], re.sub(r",?\s*\d{4}$", "", r.label.strip())
        for name in filter(None, (title, act)):
            acts[re.sub(r"[\s.,]", "", name).lower()] = act
            names.add(re.escape(name).replace(r"\ ", r"\s+"))
    return references.Grammar(2, tuple(sorted(acts.items())), "(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + r")\b")


@CORE.add("extract_references", "EXT-02", "EXT-03", "TXT-12")
def extract_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in every judgment; places need a regex engine with offsets, so there is no SQL."""
    rows = table(spark, sf_dir, "judgments").filter("document_id is not null and text is not null").select("document_id", "text").distinct()
    return references.extract(rows, "document_id", "text", act_grammar(spark, sf_dir))


@CORE.add("extract_references_v1", "EXT-01")
def extract_references_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the first version of the grammar: one section a match."""
    rows = table(spark, sf_dir, "judgments").filter("document_id is not null and text is not null").select("document_id", "text").distinct()
    known = act_grammar(spark, sf_dir)
    return references.extract(rows, "document_id", "text", references.Grammar(1, known.acts, known.names.removesuffix(r"\b")))


_TEXTS = [
    ("one", 1, "Charges were framed under s. 411 IPC and Sec. 7(2) of the Bharatiya Nyaya Sanhita; (1987) 3 SCC 45 was read in reply to 2011 SCC OnLine SC 88."),
    ("two", 2, "He pleaded guilty to Sections 379, 411 and 34 I.P.C. and was heard on Section 437 of the Code of Criminal Procedure."),
    ("three", 2, "Ss. 65B and 27 Evidence Act were put to the witness; u/s 64(1)(a) BNS nothing was found."),
    ("four", 2, "A writ under Article 226 and Articles 14 and 19(1)(a) of the Constitution was dismissed as withdrawn."),
    ("five", 2, "The seller relied on Article 35 of the Hague Convention alone."), ("six", 2, "No provision was named."),
]
_HINTS = [
    ("one", "provision:india:ipc:411:"), ("one", "provision:india:bns:7(2):"), ("one", "case:india:reporter:scc:1987:3:45"), ("one", "case:india:reporter:scc-online-sc:2011:88"),
    ("two", "provision:india:ipc:379:"), ("two", "provision:india:ipc:411:"), ("two", "provision:india:ipc:34:"), ("two", "provision:india:crpc:437:"),
    ("three", "provision:india:iea:65B:"), ("three", "provision:india:iea:27:"), ("three", "provision:india:bns:64:"),
    ("four", "provision:india:constitution:226:"), ("four", "provision:india:constitution:14:"), ("four", "provision:india:constitution:19:"),
]


@CORE.add("reference_hints", "EXT-01", "EXT-02", "TXT-13", sql="select * from (values " + ", ".join(f"('{d}', '{h}')" for d, h in _HINTS) + ") t(document_id, canonical_hint)")
def reference_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_TEXTS, "document_id string, version int, text string")
    parts = [references.extract(rows.filter(F.col("version") == v), "document_id", "text", references.Grammar(v)) for v in (1, 2)]
    return parts[0].unionByName(parts[1]).select("document_id", "canonical_hint")


_PAGES = [
    ("ferry", 11, "An Act to regulate ferries.\n1. Name of this Act.\nIt may be called the Ferries Act."), ("ferry", 12, "It extends to every river.\n2.(1) A ferry is a boat for hire.\n(2) A bridge is none.\n"), ("ferry", 13, "2. Form of licence, printed by mistake.\n"),
    ("toll", 1, "1. Tolls may be levied.\n3. Who is exempt.\n"), ("toll", 2, "1. Clause of a State.\n4. Recovery of tolls.\n"), ("well", 5, "1. Wells shall be fenced.\nSECOND SCHEDULE\n1. Pattern of a fence.\n"),
]


@CORE.add("statute_sections", "EXT-04", "EXT-05", "SRC-05", sql="""
select * from (values ('ferry', '1', 11, 12, true), ('ferry', '2', 12, 12, true), ('ferry', '2', 13, 13, false), ('toll', '1', 1, 1, true), ('toll', '3', 1, 1, true), ('toll', '1', 2, 2, false), ('toll', '4', 2, 2, true), ('well', '1', 5, 5, true), ('well', '1', 5, 5, false)) t(act_id, section, page_start, page_end, kept)""")  # fmt: skip
def statute_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame(_PAGES, "act_id string, page_no int, text string")
    return statutes.kept(statutes.split_acts(pages)).select("act_id", "section", "page_start", "page_end", "kept")


@CORE.add("view_seeds", "RET-04", "WIN-08")
def view_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes cited in every example's view, in order of first mention: what a subgraph query starts from."""
    from docketry.operators import graph

    nodes = graph.clean_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "core_nodes"))
    views = table(spark, sf_dir, "examples").filter("case_id is not null and view_text is not null").select("case_id", "view_text").distinct()
    found = materialise(references.extract(views, "case_id", "view_text", act_grammar(spark, sf_dir)).withColumnRenamed("document_id", "case_id"))
    targets = graph.resolve(found, nodes).filter("resolved_target_id is not null")
    first = found.join(targets, "extraction_id").groupBy("case_id", F.col("resolved_target_id").alias("seed")).agg(F.min(F.struct("span_start", "span_end")).alias("at"))
    order = Window.partitionBy("case_id").orderBy("at", "seed")
    return first.select("case_id", "seed", F.row_number().over(order).alias("ord"))
