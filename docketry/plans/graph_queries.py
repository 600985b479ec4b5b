"""Queries over the graph: validation, eligibility, resolution, assembly, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.ids import tidy
from docketry.operators import graph
from docketry.registry import CORE
from docketry.session import materialise, table

AS_OF = "2015-01-01"
BUDGET, HOPS = 32, 2

_CLEAN = """
with recursive alln as (select node_id, node_type, label, source_document_ids, available_from, available_to, decision_date, ingested_at from nodes
  union all select node_id, node_type, label, source_document_ids, available_from, available_to, decision_date, ingested_at from core_nodes),
n as (select lower(trim(node_id)) node_id, node_type, label, source_document_ids, available_from, available_to, decision_date from alln where node_id is not null
  qualify row_number() over (partition by lower(trim(node_id)) order by ingested_at desc) = 1),
e as (select edge_id, relation_type, lower(trim(source_id)) source_id, lower(trim(target_id)) target_id, lower(trim(origin_split)) origin_split, evidence_extraction_ids, confidence, available_from, available_to, source_decision_date from edges
  where edge_id is not null qualify row_number() over (partition by edge_id order by ingested_at desc) = 1)
"""


def _force(alias: str, date: str, decided: str = "decision_date") -> str:
    return f"coalesce({alias}.available_from <= {date}, true) and coalesce({alias}.available_to >= {date}, true) and coalesce({alias}.{decided} <= {date}, true)"


def cleaned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.clean_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "core_nodes")), graph.clean_edges(table(spark, sf_dir, "edges"))


@CORE.add("relation_counts", "AGG-03", "SNK-04", sql=_CLEAN + "select 'edge' record, relation_type kind, count(*) n from e group by 2 union all select 'node', node_type, count(*) from n group by 2")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = cleaned(spark, sf_dir)
    out = edges.groupBy(F.col("relation_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("record"), "kind", "n")
    return out.unionByName(nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("record"), "kind", "n"))


@CORE.add("edge_eligibility", "FLT-01", "FLT-02", "JOIN-02", sql=_CLEAN + f"""
select e.edge_id, e.relation_type from e join n s on s.node_id = e.source_id join n t on t.node_id = e.target_id
where e.origin_split = 'train' and {_force('e', f"date '{AS_OF}'", 'source_decision_date')} and {_force('s', f"date '{AS_OF}'")} and {_force('t', f"date '{AS_OF}'")}""")  # fmt: skip
def edge_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges a query of 2015 may use."""
    nodes, edges = cleaned(spark, sf_dir)
    return graph.eligible_edges(edges, nodes, F.lit(AS_OF).cast("date")).select("edge_id", "relation_type")


@CORE.add("node_exclusion", "FLT-03", "SET-04", sql=_CLEAN + """, x as (select node_id from n where node_type = 'case' and decision_date >= date '2020-01-01')
select (select count(*) from n where node_id not in (select node_id from x)) n_nodes,
  (select count(*) from e where coalesce(source_id not in (select node_id from x), true) and coalesce(target_id not in (select node_id from x), true)) n_edges""")  # fmt: skip
def node_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph without the cases since 2020 and the edges at them, counted."""
    nodes, edges = cleaned(spark, sf_dir)
    n, e = graph.without(nodes, edges, nodes.filter("node_type = 'case' and decision_date >= date'2020-01-01'"))
    return n.agg(F.count(F.lit(1)).alias("n_nodes")).join(e.agg(F.count(F.lit(1)).alias("n_edges")))  # two single rows


_PAIRS = ", ".join(f"('{r}', '{t}', '{side}')" for side, table_ in (("from", graph.DOMAINS), ("to", graph.RANGES)) for r, types in table_.items() for t in types)


@CORE.add("graph_violations", "VAL-01", "SNK-10", sql=f"""
with n as (select node_id, label, source_document_ids, available_from, available_to, node_type, decision_date from nodes union all select node_id, label, source_document_ids, available_from, available_to, node_type, decision_date from core_nodes),
pairs(relation_type, node_type, side) as (values {_PAIRS}),
one as (select node_id, max(node_type) typ, max(decision_date) dat from n group by 1),
b as (select e.edge_id, e.relation_type, e.source_id, e.target_id, s.typ st, s.dat sd, t.typ tt, t.dat td, s.node_id s, t.node_id t from edges e left join one s on s.node_id = e.source_id left join one t on t.node_id = e.target_id),
v as (
  select 'node' record, node_id id, 'duplicate id' rule, 'error' severity from n group by node_id having count(*) > 1
  union all select 'edge', edge_id, 'duplicate id', 'error' from edges group by edge_id having count(*) > 1
  union all select 'node', node_id, 'empty id', 'error' from n where node_id is null or node_id = ''
  union all select 'node', node_id, 'empty label', 'error' from n where label is null or trim(label) = ''
  union all select 'node', node_id, 'no provenance', 'error' from n where source_document_ids is null or len(source_document_ids) = 0
  union all select 'node', node_id, 'inverted window', 'error' from n where available_from > available_to
  union all select 'edge', edge_id, 'inverted window', 'error' from edges where available_from > available_to
  union all select 'edge', edge_id, 'no evidence', 'error' from edges where evidence_extraction_ids is null or len(evidence_extraction_ids) = 0
  union all select 'edge', edge_id, 'confidence out of range', 'error' from edges where not (confidence between 0 and 1)
  union all select 'edge', edge_id, 'source does not resolve', 'error' from b where s is null
  union all select 'edge', edge_id, 'target does not resolve', 'error' from b where s is not null and t is null
  union all select 'edge', edge_id, 'cannot start there', 'error' from b where s is not null and t is not null and not exists (select 1 from pairs p where p.relation_type = b.relation_type and p.node_type = b.st and p.side = 'from')
  union all select 'edge', edge_id, 'cannot end there', 'error' from b where s is not null and t is not null and not exists (select 1 from pairs p where p.relation_type = b.relation_type and p.node_type = b.tt and p.side = 'to')
  union all select 'edge', edge_id, 'precedes out of order', 'error' from b where relation_type = 'temporally_precedes' and sd >= td
  union all select 'edge', edge_id, 'overrules a same or later decision', 'error' from b where relation_type = 'overrules' and sd <= td
  union all select 'edge', edge_id, 'cites a later decision', 'warning' from b where relation_type = 'cites' and sd < td)
select record, rule, severity, count(*) n, count(distinct id) ids from v group by all""")  # fmt: skip
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the graph as delivered, counted."""
    columns = ["node_id", "node_type", "label", "source_document_ids", "available_from", "available_to", "decision_date"]
    nodes = table(spark, sf_dir, "nodes").select(columns).unionByName(table(spark, sf_dir, "core_nodes").select(columns))
    return graph.violations(nodes, table(spark, sf_dir, "edges")).groupBy("record", "rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


_RESOLVED = _CLEAN + """, c as (select distinct extraction_id, kind, lower(trim(canonical_hint)) h from candidates),
hits as (select c.extraction_id, count(distinct n.node_id) k, min(n.node_id) target from c left join n on (c.kind = 'case' and n.node_id = c.h) or (c.kind <> 'case' and starts_with(n.node_id, c.h)) group by 1),
res as (select extraction_id, case when k = 1 then target end resolved_target_id, case when k = 0 then 'no_canonical_target' when k > 1 then 'ambiguous_canonical_target' end unresolved_reason from hits)
"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = cleaned(spark, sf_dir)
    return graph.resolve(table(spark, sf_dir, "candidates"), nodes)


@CORE.add("resolve_references", "JOIN-01", sql=_RESOLVED + "select * from res")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)


@CORE.add("resolution_summary", "AGG-02", sql=_RESOLVED + """
select count(*) filter (resolved_target_id is not null) resolved, count(*) filter (unresolved_reason = 'no_canonical_target') unresolved, count(*) filter (unresolved_reason = 'ambiguous_canonical_target') ambiguous from res""")  # fmt: skip
def resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.col("unresolved_reason")
    return resolved(spark, sf_dir).agg(F.count("resolved_target_id").alias("resolved"), F.count_if(reason == "no_canonical_target").alias("unresolved"), F.count_if(reason == "ambiguous_canonical_target").alias("ambiguous"))


@CORE.add("edge_assembly", "AGG-01", "WIN-08", sql=_RESOLVED + """,
d as (select distinct document_id, case_id from judgments where document_id is not null),
r as (select distinct d.case_id source_id, c.relation_type, res.resolved_target_id target_id, c.extraction_id from candidates c join res using (extraction_id) join d using (document_id) where res.resolved_target_id is not null),
g as (select source_id, relation_type, target_id, list_sort(list(distinct extraction_id)) ev from r group by all)
select 'edge:' || sha256(relation_type || '|' || source_id || '|' || target_id || '|' || array_to_string(ev, '|'))[1:20] edge_id, relation_type, source_id, target_id, len(ev) evidence from g""")  # fmt: skip
def edge_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved references as edges of their judgments."""
    documents = table(spark, sf_dir, "judgments").filter("document_id is not null").select("document_id", F.col("case_id").alias("source_id")).distinct()
    hits = resolved(spark, sf_dir).filter("resolved_target_id is not null").select("extraction_id", F.col("resolved_target_id").alias("target_id"))
    rows = table(spark, sf_dir, "candidates").select("extraction_id", "document_id", "relation_type").distinct().join(hits, "extraction_id").join(documents, "document_id")
    return graph.assemble_edges(rows).select("edge_id", "relation_type", "source_id", "target_id", F.size("evidence_extraction_ids").cast("long").alias("evidence"))


_CITED = _CLEAN + f""",
q as (select lower(trim(case_id)) query_id, min(decision_date) as_of from judgments where case_id is not null and decision_date is not null group by 1),
ok as (select e.source_id case_id, e.target_id target, greatest(e.source_decision_date, e.available_from, s.decision_date, s.available_from, t.available_from) seen_from, t.available_from tf, t.available_to tt
  from e join n s on s.node_id = e.source_id join n t on t.node_id = e.target_id where e.origin_split = 'train' and e.relation_type = 'refers_to_provision' and t.node_type = 'provision' and e.available_to is null and s.available_to is null),
cit as (select case_id, target, min(seen_from) seen_from from ok group by 1, 2),
own as (select distinct e.source_id query_id, e.target_id seed from e join n on n.node_id = e.target_id where e.relation_type = 'refers_to_provision' and n.node_type = 'provision'),
sd as (select own.query_id, own.seed, q.as_of, row_number() over (partition by own.query_id order by own.seed) ord from own join q using (query_id) join n on n.node_id = own.seed where {_force('n', 'q.as_of')}),
near as (select sd.query_id, sd.as_of, c.case_id, sd.seed from sd join cit c on c.target = sd.seed where c.case_id <> sd.query_id and coalesce(c.seen_from <= sd.as_of, true)),
cand as (select near.query_id, c.target, count(distinct near.seed) shared_seeds, count(distinct near.case_id) support from near join cit c on c.case_id = near.case_id
  where coalesce(c.seen_from <= near.as_of, true) and not exists (select 1 from sd where sd.query_id = near.query_id and sd.seed = c.target) group by 1, 2),
ranked as (select cand.*, row_number() over (partition by query_id order by shared_seeds desc, support desc, target) r from cand),
cnt as (select query_id, count(*) k from sd group by 1),
sel as (select query_id, ord position, seed node_id, null::bigint shared_seeds, null::bigint support from sd where ord <= {BUDGET}
  union all select query_id, k + r, target, shared_seeds, support from ranked join cnt using (query_id) where k + r <= {BUDGET})
"""


def citations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests (one per judgment with a date, its own provisions as seeds) and the train citations with their first day."""
    nodes, edges = cleaned(spark, sf_dir)
    refers = edges.filter("relation_type = 'refers_to_provision'")
    return in_order(named(refers, nodes, requested(spark, sf_dir)).filter("valid")), seen(refers, nodes)


def seen(refers: DataFrame, nodes: DataFrame) -> DataFrame:
    """``case_id, target, seen_from``: the train citations with their first day."""
    s = nodes.select(F.col("node_id").alias("source_id"), F.col("decision_date").alias("sd"), F.col("available_from").alias("sf"), F.col("available_to").alias("st"))
    t = nodes.filter("node_type = 'provision'").select(F.col("node_id").alias("target_id"), F.col("available_from").alias("tf"), F.col("available_to").alias("tt"))
    ok = refers.filter("origin_split = 'train' and available_to is null").join(s, "source_id").filter("st is null").join(t, "target_id")
    first = F.greatest("source_decision_date", "available_from", "sd", "sf", "tf")
    return ok.groupBy(F.col("source_id").alias("case_id"), F.col("target_id").alias("target")).agg(F.min(first).alias("seen_from"))


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, as_of``: one per judgment with a date."""
    return table(spark, sf_dir, "judgments").filter("case_id is not null and decision_date is not null").groupBy(tidy("case_id").alias("query_id")).agg(F.min("decision_date").alias("as_of"))


def named(refers: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, exclude, as_of, seed, valid``: the provisions that each query's judgment names, and whether they are in force on its date."""
    own = refers.select(F.col("source_id").alias("query_id"), F.col("target_id").alias("seed")).distinct().join(queries, "query_id")
    window = nodes.filter("node_type = 'provision'").select(F.col("node_id").alias("seed"), "available_from", "available_to", F.lit(None).cast("date").alias("decision_date"))
    return own.join(window, "seed").select("query_id", F.col("query_id").alias("exclude"), "as_of", "seed", graph.in_force(F.col("as_of")).alias("valid"))


def in_order(seeds: DataFrame) -> DataFrame:
    """Requests: seeds with their place in their query."""
    return seeds.select("query_id", "exclude", "as_of", "seed", F.row_number().over(Window.partitionBy("query_id").orderBy("seed")).alias("ord"))


@CORE.add("cocitation", "RET-06", "RET-04", "JOIN-13", "RET-10", sql=_CITED + "select query_id, position::int position, node_id, shared_seeds, support from sel")
def cocitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every judgment its provisions, then those that earlier train cases cite beside them."""
    seeds, cited = citations(spark, sf_dir)
    return graph.cocitation(materialise(seeds), materialise(cited), BUDGET)


@CORE.add("cocitation_coverage", "AGG-12", sql=_CITED + f"""
select count(*) n_queries, avg((k is not null)::int::double) share_with_graph, avg(k) mean_nodes from q left join (select query_id, count(*) k from sel group by 1) using (query_id)""")  # fmt: skip
def cocitation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = cleaned(spark, sf_dir)
    nodes = materialise(nodes.select("node_id", "node_type", "available_from", "available_to", "decision_date"))
    refers = materialise(edges.filter("relation_type = 'refers_to_provision'").select("source_id", "target_id", "origin_split", "available_from", "available_to", "source_decision_date"))
    queries = requested(spark, sf_dir)
    sizes = graph.cocitation_sizes(materialise(in_order(named(refers, nodes, queries).filter("valid"))), materialise(seen(refers, nodes)), BUDGET).withColumnRenamed("nodes", "k")
    return queries.select("query_id").join(sizes, "query_id", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.col("k").isNotNull().cast("int")).alias("share_with_graph"), F.avg("k").alias("mean_nodes"))


@CORE.add("cocitation_links", "RET-06", "RET-11", sql=_CITED + """
select a.query_id, a.position::int - 1 source_at, b.position::int - 1 target_at, 9 relation
from sel a join sel b on a.query_id = b.query_id and a.node_id <> b.node_id join q on q.query_id = a.query_id
where exists (select 1 from cit x join cit y on x.case_id = y.case_id where x.target = a.node_id and y.target = b.node_id and x.case_id <> a.query_id and coalesce(x.seen_from <= q.as_of, true) and coalesce(y.seen_from <= q.as_of, true))""")  # fmt: skip
def cocitation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between selected provisions that one eligible case cites."""
    seeds, cited = citations(spark, sf_dir)
    return graph.cocitation_links(materialise(seeds), materialise(cited), BUDGET).withColumn("relation", F.lit(9))


_WALK = _CLEAN + f""",
ok as (select e.source_id, e.target_id, e.relation_type from e join n s on s.node_id = e.source_id join n t on t.node_id = e.target_id
  where e.origin_split = 'train' and e.relation_type <> 'decided_by' and {_force('e', f"date '{AS_OF}'", 'source_decision_date')} and {_force('s', f"date '{AS_OF}'")} and {_force('t', f"date '{AS_OF}'")}),
adj as (select source_id node_id, target_id neighbour from ok union select target_id, source_id from ok),
seed as (select distinct target_id seed from ok where relation_type = 'refers_to_provision'),
l1 as (select s.seed, a.neighbour, row_number() over (partition by s.seed order by a.neighbour) rn from seed s join adj a on a.node_id = s.seed and a.neighbour <> s.seed),
k1 as (select seed, neighbour, rn + 1 pos from l1 where rn < {BUDGET}),
v1 as (select seed, seed node_id, 1 pos, 0 depth from seed union all select seed, neighbour, pos, 1 from k1),
f2 as (select k1.seed, a.neighbour, min(k1.pos) parent from k1 join adj a on a.node_id = k1.neighbour where not exists (select 1 from v1 where v1.seed = k1.seed and v1.node_id = a.neighbour) group by 1, 2),
l2 as (select f2.seed, f2.neighbour, (select max(pos) from v1 where v1.seed = f2.seed) + row_number() over (partition by f2.seed order by f2.parent, f2.neighbour) pos from f2),
walk as (select seed, pos, node_id, depth from v1 union all select seed, pos, neighbour, 2 from l2 where pos <= {BUDGET})
"""


def walk_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Provisions that a train case of before 2015 cites, as seeds, and the edges eligible then (courts join everything)."""
    nodes, edges = cleaned(spark, sf_dir)
    ok = materialise(graph.eligible_edges(edges, nodes, F.lit(AS_OF).cast("date"), relations=tuple(r for r in graph.RELATIONS if r != "decided_by")).select("source_id", "target_id", "relation_type"))
    return ok.filter("relation_type = 'refers_to_provision'").select(F.col("target_id").alias("seed")).distinct(), ok


def walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seeds, ok = walk_inputs(spark, sf_dir)
    adjacency = ok.select(F.lit("all").alias("query_id"), F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour")).unionByName(ok.select(F.lit("all").alias("query_id"), F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour"))).distinct()
    adjacency = materialise(adjacency.withColumn("prize", F.lit(0.0)))
    starts = materialise(seeds.select(F.lit("all").alias("query_id"), "seed", F.lit(BUDGET).alias("budget")))
    return graph.expand(starts, adjacency, HOPS), ok


@CORE.add("expand_two_hops", "RET-01", sql=_WALK + "select seed, pos::int position, node_id, depth::int depth from walk")
def expand_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prize-guided breadth-first expansion of every cited provision, within a budget of nodes."""
    return walked(spark, sf_dir)[0].select("seed", F.col("position").cast("int").alias("position"), "node_id", "depth")


_NUMBERS = "case relation_type " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(graph.RELATIONS)) + " end"


@CORE.add("subgraph_triples", "RET-05", "JOIN-14", "CLS-11", sql=_WALK + f"""
, f as (select distinct a.seed query_id, a.pos::int - 1 source_at, b.pos::int - 1 target_at, {_NUMBERS} relation from ok join walk a on a.node_id = ok.source_id join walk b on b.seed = a.seed and b.node_id = ok.target_id)
select * from f union select query_id, target_at, source_at, relation + 11 from f""")  # fmt: skip
def subgraph_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the nodes selected for each seed, by position, with their inverses."""
    nodes, ok = walked(spark, sf_dir)
    selected = materialise(nodes.select(F.col("seed").alias("query_id"), F.col("position").cast("int").alias("position"), "node_id"))
    touching = ok.join(selected.select("query_id", F.col("node_id").alias("source_id")), "source_id")
    return graph.triples(selected, touching)


_SHARED = _CITED + f""",
wide as (select e.relation_type, e.source_id, e.target_id, greatest(e.available_from, e.source_decision_date, s.available_from, s.decision_date, t.available_from, t.decision_date) lo, least(e.available_to, s.available_to, t.available_to) hi
  from e join n s on s.node_id = e.source_id join n t on t.node_id = e.target_id where e.origin_split = 'train' and e.relation_type <> 'decided_by'),
adj as (select source_id node_id, target_id neighbour, lo, hi from wide union select target_id, source_id, lo, hi from wide),
parts as (select sd.*, greatest(1, {BUDGET} // count(*) over (partition by query_id)) part from sd),
f1 as (select distinct p.query_id, p.as_of, p.ord, p.seed, p.part, a.neighbour from parts p join adj a on a.node_id = p.seed where coalesce(a.lo <= p.as_of, true) and coalesce(a.hi >= p.as_of, true) and a.neighbour <> p.query_id and a.neighbour <> p.seed),
l1 as (select f1.*, row_number() over (partition by query_id, seed order by (exists (select 1 from sd where sd.query_id = f1.query_id and sd.seed = f1.neighbour)) desc, neighbour) + 1 pos from f1),
k1 as (select * from l1 where pos <= part),
v1 as (select query_id, seed, seed node_id, ord, 1 pos, 0 depth from parts union all select query_id, seed, neighbour, ord, pos, 1 from k1),
f2 as (select k.query_id, k.ord, k.seed, k.part, a.neighbour, min(k.pos) parent from k1 k join adj a on a.node_id = k.neighbour where k.pos < k.part and coalesce(a.lo <= k.as_of, true) and coalesce(a.hi >= k.as_of, true) and a.neighbour <> k.query_id
  and not exists (select 1 from v1 where v1.query_id = k.query_id and v1.seed = k.seed and v1.node_id = a.neighbour) group by all),
l2 as (select f2.*, (select max(pos) from v1 where v1.query_id = f2.query_id and v1.seed = f2.seed) + row_number() over (partition by query_id, seed order by parent, (exists (select 1 from sd where sd.query_id = f2.query_id and sd.seed = f2.neighbour)) desc, neighbour) pos from f2),
walk as (select query_id, node_id, ord, pos, depth from v1 union all select query_id, neighbour, ord, pos, 2 from l2 where pos <= part),
first_seen as (select query_id, node_id, min((ord, pos, depth)) k from walk group by 1, 2),
chosen as (select query_id, row_number() over (partition by query_id order by k) as position, node_id, k[3] depth from first_seen qualify position <= {BUDGET})
"""


def shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (one per judgment, its provisions in force as seeds), the dated links of train edges, and the nodes selected."""
    nodes, edges = cleaned(spark, sf_dir)
    links = materialise(graph.dated_links(edges.filter("origin_split = 'train' and relation_type <> 'decided_by'"), nodes))
    seeds = materialise(citations(spark, sf_dir)[0])
    return seeds, links, materialise(graph.expand_shared(seeds, links.select("node_id", "neighbour", "seen_from", "seen_to").distinct(), BUDGET, HOPS))


@CORE.add("shared_expansion", "RET-02", "RET-03", "SRT-02", "WIN-09", sql=_SHARED + "select query_id, position::int position, node_id, depth::int depth from chosen")
def shared_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every judgment the expansions of its provisions, which share one budget of nodes; its own node is left out."""
    return shared(spark, sf_dir)[2]


@CORE.add("expansion_status", "RET-02", "RET-05", sql=_SHARED + """
select q.query_id, case when count(c.node_id) > 0 then 'ok' when exists (select 1 from own where own.query_id = q.query_id) then 'no_eligible_seed' else 'no_seed' end status, count(c.node_id) nodes from q left join chosen c using (query_id) group by 1""")  # fmt: skip
def expansion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every request: nodes, or why there are none."""
    nodes, edges = cleaned(spark, sf_dir)
    nodes = materialise(nodes.select("node_id", "node_type", "available_from", "available_to", "decision_date"))
    links, refers = "origin_split = 'train' and relation_type <> 'decided_by'", "relation_type = 'refers_to_provision'"
    edges = materialise(edges.filter(f"{links} or {refers}").select("relation_type", "source_id", "target_id", "origin_split", "available_from", "available_to", "source_decision_date"))
    queries = requested(spark, sf_dir)
    asked = materialise(named(edges.filter(refers), nodes, queries))
    sizes = graph.expansion_sizes(in_order(asked.filter("valid")), edges.filter(links), nodes, BUDGET, HOPS)
    return graph.sized_status(queries.select("query_id").join(asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("named")), "query_id", "left"), sizes)


@CORE.add("expansion_triples", "RET-05", "JOIN-14", sql=_SHARED + f"""
, f as (select distinct a.query_id, a.position::int - 1 source_at, b.position::int - 1 target_at, {_NUMBERS} relation from wide join chosen a on a.node_id = wide.source_id join chosen b on b.query_id = a.query_id and b.node_id = wide.target_id join q on q.query_id = a.query_id
  where coalesce(lo <= q.as_of, true) and coalesce(hi >= q.as_of, true))
select * from f union select query_id, target_at, source_at, relation + 11 from f""")  # fmt: skip
def expansion_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in force among the nodes selected for every judgment, by position, with their inverses."""
    seeds, links, selected = shared(spark, sf_dir)
    dated = selected.join(seeds.select("query_id", "as_of").distinct(), "query_id")
    edges = links.filter("forward").withColumnsRenamed({"node_id": "source_id", "neighbour": "target_id"}).join(dated.select("query_id", "as_of", F.col("node_id").alias("source_id")), "source_id")
    return graph.triples(selected, edges.filter(graph._seen("as_of")))


# a small graph of its own: two acts' provisions, five train cases, a test case, one decided later, and the asking case
_CASES = {"a": ("2009-03-02", "train", ("p1", "p2", "p4")), "b": ("2010-06-05", "train", ("p1", "p3")), "c": ("2011-01-09", "train", ("p3", "p5")), "t": ("2011-02-01", "test", ("p1", "p5")), "l": ("2016-01-01", "train", ("p1", "p5")), "q": ("2012-08-08", "train", ("p1", "p3"))}


@CORE.add("fixture_subgraph", "RET-12", "RET-01", "RET-03", sql="""
select * from (values ('q', 1, 'p1', 0), ('q', 2, 'case-a', 1), ('q', 3, 'case-b', 1), ('q', 4, 'p3', 0), ('q', 5, 'case-c', 1), ('late', 1, 'p4', 0), ('late', 2, 'case-a', 1), ('late', 3, 'p1', 2), ('late', 4, 'p2', 2)) t(query_id, position, node_id, depth)""")  # fmt: skip
def fixture_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests on a small literal graph: later and test cases, and the asking case itself, are never reached."""
    nodes = spark.createDataFrame([(f"case-{c}", d) for c, (d, *_) in _CASES.items()] + [(f"p{i}", None) for i in range(1, 6)], "node_id string, d string")
    nodes = nodes.select("node_id", F.lit(None).cast("date").alias("available_from"), F.lit(None).cast("date").alias("available_to"), F.to_date("d").alias("decision_date"))
    edges = spark.createDataFrame([(f"case-{c}", p, split) for c, (_, split, ps) in _CASES.items() for p in ps], "source_id string, target_id string, origin_split string")
    none = F.lit(None).cast("date")
    edges = edges.withColumns({"relation_type": F.lit("refers_to_provision"), "available_from": none, "available_to": none, "source_decision_date": none})
    asked = [("q", "case-q", "2012-08-08", "p1", 1), ("q", "case-q", "2012-08-08", "p3", 2), ("late", None, "2017-01-01", "p4", 1)]
    requests = spark.createDataFrame(asked, "query_id string, exclude string, d string, seed string, ord int").select("query_id", "exclude", F.to_date("d").alias("as_of"), "seed", "ord")
    links = graph.dated_links(edges.filter("origin_split = 'train'"), nodes).select("node_id", "neighbour", "seen_from", "seen_to")
    return graph.expand_shared(requests, links, 6, HOPS)


@CORE.add("steiner_trees", "RET-07")
def steiner_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prize-collecting tree per judgment, over the neighbourhood of its provisions."""
    seeds, cited = citations(spark, sf_dir)
    return graph.near_trees(materialise(seeds), materialise(cited), BUDGET, HOPS)


@CORE.add("random_control", "RET-08", "SRT-05", "SET-06", sql=_CLEAN + f"""
, pool as (select n.node_id from n where node_id in (select source_id from e where origin_split = 'train' union select target_id from e where origin_split = 'train') and {_force('n', f"date '{AS_OF}'")})
select node_id, row_number() over (order by sha256('7|' || node_id), node_id)::int as position from pool qualify position <= {BUDGET}""")  # fmt: skip
def random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many nodes as a subgraph has, drawn by hash from the eligible nodes of train edges."""
    nodes, edges = cleaned(spark, sf_dir)
    train = edges.filter("origin_split = 'train'")
    reached = train.select(F.col("source_id").alias("node_id")).union(train.select("target_id")).distinct()
    drawn = nodes.filter(graph.in_force(F.lit(AS_OF).cast("date"))).select("node_id").join(reached, "node_id", "left_semi")
    drawn = drawn.withColumn("h", F.sha2(F.concat(F.lit("7|"), "node_id"), 256)).orderBy("h", "node_id").limit(BUDGET)
    return drawn.select("node_id", F.row_number().over(Window.orderBy("h", "node_id")).alias("position"))


@CORE.add("provision_neighbour_means", "CLS-11", "JOIN-07", sql=_CLEAN + """
select e.target_id, e.relation_type, count(*) n, avg(year(s.decision_date)) mean_year from e join n s on s.node_id = e.source_id where s.decision_date is not null group by 1, 2""")  # fmt: skip
def provision_neighbour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the neighbours' values per target and relation: a message-passing layer with identity weights."""
    nodes, edges = cleaned(spark, sf_dir)
    s = nodes.filter("decision_date is not null").select(F.col("node_id").alias("source_id"), F.year("decision_date").alias("y"))
    return edges.join(s, "source_id").groupBy("target_id", "relation_type").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_year"))
