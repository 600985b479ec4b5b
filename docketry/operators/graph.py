"""The dated, split-tagged graph: cleaning, eligibility, validation, assembly, and retrieval in batch.

Every retrieval takes a table of requests and answers all of them in one plan; hops are unrolled joins. Node and edge
tables have the columns of the data model; ids compare tidied.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.ids import tidy
from docketry.operators import beside
from docketry.operators.asof import latest_delivery
from docketry.session import materialise

# Relations in the order of their numbers, and the node types each may start and end at.
RELATIONS = ("cites", "is_cited_by", "overrules", "distinguishes", "refers_to_provision", "contains", "defines", "amends", "decided_by", "co_occurs_with", "temporally_precedes")
DOMAINS = {
    "cites": ("case",), "is_cited_by": ("case",), "overrules": ("case",), "distinguishes": ("case",), "refers_to_provision": ("case", "contract_clause"),
    "contains": ("act", "case", "contract_clause"), "defines": ("provision", "contract_clause"), "amends": ("provision",), "decided_by": ("case",), "co_occurs_with": ("provision",), "temporally_precedes": ("case",),
}
RANGES = {
    "cites": ("case",), "is_cited_by": ("case",), "overrules": ("case",), "distinguishes": ("case",), "refers_to_provision": ("provision",),
    "contains": ("provision", "rhetorical_unit", "contract_clause"), "defines": ("legal_concept",), "amends": ("provision",), "decided_by": ("court",), "co_occurs_with": ("provision",), "temporally_precedes": ("case",),
}


def clean_nodes(*tables: DataFrame) -> DataFrame:
    """The rows delivered last, one per tidied id."""
    columns = ["node_id", "node_type", "label", "source_document_ids", "available_from", "available_to", "decision_date", "attributes", "ingested_at"]
    rows = reduce(DataFrame.unionByName, [t.select(columns) for t in tables]).filter("node_id is not null").withColumn("node_key", tidy("node_id"))
    return latest_delivery(rows, "node_key", "ingested_at").drop("node_id").withColumnRenamed("node_key", "node_id")


def clean_edges(edges: DataFrame) -> DataFrame:
    rows = latest_delivery(edges.filter("edge_id is not null"), "edge_id", "ingested_at")
    return rows.withColumn("source_id", tidy("source_id")).withColumn("target_id", tidy("target_id")).withColumn("origin_split", F.lower(F.trim("origin_split")))


def in_force(date: Column, prefix: str = "", decided: str = "decision_date") -> Column:
    """Inclusive on both ends; a NULL bound and a NULL date always pass."""
    c = lambda name: F.col(prefix + name)
    yes = F.lit(True)
    return F.coalesce(c("available_from") <= date, yes) & F.coalesce(c("available_to") >= date, yes) & F.coalesce(c(decided) <= date, yes)


def eligible_edges(edges: DataFrame, nodes: DataFrame, date: Column, splits: tuple[str, ...] = ("train",), relations: tuple[str, ...] | None = None) -> DataFrame:
    """Edges of the allowed splits and relations whose ends exist and, like the edge, are in force on ``date``."""
    rows = edges.filter(F.col("origin_split").isin(*splits))
    if relations is not None:
        rows = rows.filter(F.col("relation_type").isin(*relations))
    end = lambda side: nodes.select(F.col("node_id").alias(side), *[F.col(c).alias(f"{side}_node_{c}") for c in ("node_type", "available_from", "available_to", "decision_date")])
    rows = rows.join(end("source"), F.col("source_id") == F.col("source")).join(end("target"), F.col("target_id") == F.col("target"))
    own = in_force(date, "", "source_decision_date") & in_force(date, "source_node_") & in_force(date, "target_node_")
    return rows.filter(own).drop("source", "target")


def without(nodes: DataFrame, edges: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of ``excluded (node_id)`` and the edges at them."""
    gone = excluded.select(F.col("node_id").alias("gone")).distinct()
    kept = edges.join(gone, edges["source_id"] == gone["gone"], "left_anti").join(gone, edges["target_id"] == gone["gone"], "left_anti")
    return nodes.join(gone, nodes["node_id"] == gone["gone"], "left_anti"), kept


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``record, id, rule, severity`` of every broken rule."""
    row = lambda df, record, key, rule, severity="error": df.select(F.lit(record).alias("record"), F.col(key).alias("id"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    twice = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    inverted = F.col("available_from") > F.col("available_to")
    out = [
        row(twice(nodes, "node_id"), "node", "node_id", "duplicate id"), row(twice(edges, "edge_id"), "edge", "edge_id", "duplicate id"),
        row(nodes.filter("node_id is null or node_id = ''"), "node", "node_id", "empty id"),
        row(nodes.filter("label is null or trim(label) = ''"), "node", "node_id", "empty label"),
        row(nodes.filter("source_document_ids is null or size(source_document_ids) = 0"), "node", "node_id", "no provenance"),
        row(nodes.filter(inverted), "node", "node_id", "inverted window"), row(edges.filter(inverted), "edge", "edge_id", "inverted window"),
        row(edges.filter("evidence_extraction_ids is null or size(evidence_extraction_ids) = 0"), "edge", "edge_id", "no evidence"),
        row(edges.filter("not (confidence between 0 and 1)"), "edge", "edge_id", "confidence out of range"),
    ]
    one = nodes.groupBy("node_id").agg(F.max("node_type").alias("type"), F.max("decision_date").alias("date"))
    ends = edges.select("edge_id", "relation_type", "source_id", "target_id").join(one.select(F.col("node_id").alias("source_id"), F.col("type").alias("st"), F.col("date").alias("sd"), F.lit(True).alias("s")), "source_id", "left")
    ends = ends.join(one.select(F.col("node_id").alias("target_id"), F.col("type").alias("tt"), F.col("date").alias("td"), F.lit(True).alias("t")), "target_id", "left")
    both = ends.filter("s and t")

    def misplaced(allowed: dict[str, tuple[str, ...]], column: str) -> DataFrame:
        pairs = [(r, t) for r, types in allowed.items() for t in types]
        known = edges.sparkSession.createDataFrame(pairs, "relation_type string, node_type string")
        return both.join(F.broadcast(known), (both["relation_type"] == known["relation_type"]) & (both[column] == known["node_type"]), "left_anti")

    out += [
        row(ends.filter("s is null"), "edge", "edge_id", "source does not resolve"), row(ends.filter("s and t is null"), "edge", "edge_id", "target does not resolve"),
        row(misplaced(DOMAINS, "st"), "edge", "edge_id", "cannot start there"), row(misplaced(RANGES, "tt"), "edge", "edge_id", "cannot end there"),
        row(both.filter("relation_type = 'temporally_precedes' and sd >= td"), "edge", "edge_id", "precedes out of order"),
        row(both.filter("relation_type = 'overrules' and sd <= td"), "edge", "edge_id", "overrules a same or later decision"),
        row(both.filter("relation_type = 'cites' and sd < td"), "edge", "edge_id", "cites a later decision", "warning"),
    ]
    return reduce(DataFrame.unionByName, out)


def resolve(candidates: DataFrame, node_ids: DataFrame) -> DataFrame:
    """``extraction_id, resolved_target_id, unresolved_reason``: exactly one target, or why not.

    Case hints name an id, provision hints what an id begins with: the part up to its last colon, an equi-join.
    """
    targets = node_ids.select(tidy("node_id").alias("target")).distinct()
    keyed = targets.select("target", F.concat(F.lit("="), "target").alias("key")).unionByName(targets.select("target", F.concat(F.lit("^"), F.regexp_replace("target", "[^:]*$", "")).alias("key")))
    hint = F.concat(F.when(F.col("kind") == "case", "=").otherwise("^"), tidy("canonical_hint"))
    hits = candidates.select("extraction_id", hint.alias("key")).distinct().join(keyed, "key", "left").groupBy("extraction_id").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    reason = F.when(F.col("n") == 0, "no_canonical_target").when(F.col("n") > 1, "ambiguous_canonical_target")
    return hits.select("extraction_id", F.when(F.col("n") == 1, F.col("target")).alias("resolved_target_id"), reason.alias("unresolved_reason"))


def assemble_edges(references: DataFrame) -> DataFrame:
    """Edges of ``source_id, relation_type, target_id, extraction_id``: one per target, its evidence sorted, its id a hash."""
    grouped = references.groupBy("source_id", "relation_type", "target_id").agg(F.array_sort(F.collect_set("extraction_id")).alias("evidence_extraction_ids"))
    seed = F.concat_ws("|", "relation_type", "source_id", "target_id", F.array_join("evidence_extraction_ids", "|"))
    return grouped.withColumn("edge_id", F.concat(F.lit("edge:"), F.substring(F.sha2(seed, 256), 1, 20)))


def cocitation(seeds: DataFrame, citations: DataFrame, budget: int) -> DataFrame:
    """``query_id, position, node_id, shared_seeds, support``: seeds first, then what train cases cite beside them.

    ``seeds``: query_id, exclude (a case), as_of, seed, ord. ``citations``: case_id, target, the date from which the
    citation may be seen. A candidate ranks by the seeds it shares a case with, then by such cases, then by its id.
    """
    names, cites = beside.numbered_citations(citations)
    return _with_seeds(seeds, _ranked(seeds, names, cites, budget), names, budget)


def _ranked(seeds: DataFrame, names: DataFrame, cites: DataFrame, budget: int) -> DataFrame:
    return beside.ranked(beside.asked(seeds, names), materialise(beside.together(cites)), budget)


def _with_seeds(seeds: DataFrame, ranked: DataFrame, names: DataFrame, budget: int) -> DataFrame:
    count = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    first = seeds.select("query_id", F.col("ord").alias("position"), F.col("seed").alias("node_id"), F.lit(None).cast("long").alias("shared_seeds"), F.lit(None).cast("long").alias("support"))
    rest = ranked.join(names.select(F.col("no").alias("t"), F.col("name").alias("node_id")), "t").join(count, "query_id")
    rest = rest.select("query_id", (F.col("n") + F.col("r")).cast("int").alias("position"), "node_id", "shared_seeds", "support")
    return first.unionByName(rest).filter(F.col("position") <= budget)


def cocitation_sizes(seeds: DataFrame, citations: DataFrame, budget: int) -> DataFrame:
    """``query_id, nodes``: how many nodes :func:`cocitation` selects, which takes no ranking."""
    names, cites = beside.numbered_citations(citations)
    more = beside.covered(beside.asked(seeds, names), beside.together(cites), budget)
    count = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return count.join(more, "query_id", "left").select("query_id", F.least(F.lit(budget).cast("long"), F.col("n") + F.coalesce("more", F.lit(0))).alias("nodes"))


def cocitation_links(seeds: DataFrame, citations: DataFrame, budget: int) -> DataFrame:
    """``query_id, source_at, target_at``: nodes of :func:`cocitation` by position (from 0) that one case may be seen to cite both.

    Two nodes meet by the first day and case that have both, and the first day of another case for the query that is that case.
    """
    names, cites = beside.numbered_citations(citations)
    pairs = materialise(beside.together(cites))
    chosen = materialise(beside.chosen(beside.asked(seeds, names), pairs, budget))
    linked = beside.linked(chosen, beside.first_two(pairs)).select("query_id", F.explode("links").alias("at"))
    one, two = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    both = linked.select("query_id", F.explode(F.array(F.struct(one.alias("source_at"), two.alias("target_at")), F.struct(two.alias("source_at"), one.alias("target_at")))).alias("l"))
    return both.select("query_id", "l.source_at", "l.target_at")


def expand(seeds: DataFrame, adjacency: DataFrame, hops: int) -> DataFrame:
    """Breadth-first expansion of ``query_id, seed, budget``: ``query_id, seed, position, node_id, depth``.

    ``adjacency``: query_id, node_id, neighbour, prize. A node is visited from the parent that was reached first, the
    neighbours of a parent by prize, then id; a seed keeps its first ``budget`` nodes in that order.
    """
    start = seeds.select("query_id", "seed", "budget", F.col("seed").alias("node_id"), F.lit(0).alias("depth"), F.lit(1).alias("position"))
    visited, level = start, start
    for depth in range(1, hops + 1):
        found = level.select("query_id", "seed", "budget", F.col("node_id").alias("parent"), F.col("position").alias("parent_at")).join(adjacency.withColumnRenamed("node_id", "parent"), ["query_id", "parent"])
        found = found.join(visited.select("query_id", "seed", F.col("node_id").alias("neighbour")), ["query_id", "seed", "neighbour"], "left_anti")
        found = found.groupBy("query_id", "seed", "budget", "neighbour").agg(F.min(F.struct("parent_at", (-F.col("prize")).alias("p"))).alias("k"))
        offset = visited.groupBy("query_id", "seed").agg(F.max("position").alias("last"))
        w = Window.partitionBy("query_id", "seed").orderBy("k.parent_at", "k.p", "neighbour")
        level = found.withColumn("r", F.row_number().over(w)).join(offset, ["query_id", "seed"]).withColumn("position", F.col("last") + F.col("r")).filter(F.col("position") <= F.col("budget"))
        level = level.select("query_id", "seed", "budget", F.col("neighbour").alias("node_id"), F.lit(depth).alias("depth"), "position")
        visited = visited.unionByName(level)
    return visited.select("query_id", "seed", "position", "node_id", "depth")


def dated_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, neighbour, relation_type, forward, seen_from, seen_to``: every edge from both ends, with the days on which it and its ends are in force."""
    end = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.greatest("available_from", "decision_date").alias(f"{side}_from"), F.col("available_to").alias(f"{side}_to"))
    rows = edges.join(end("source"), "source_id").join(end("target"), "target_id")
    rows = rows.select("source_id", "target_id", "relation_type", F.greatest("available_from", "source_decision_date", "source_from", "target_from").alias("seen_from"), F.least("available_to", "source_to", "target_to").alias("seen_to"))
    forward = rows.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour"), "relation_type", F.lit(True).alias("forward"), "seen_from", "seen_to")
    back = rows.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour"), "relation_type", F.lit(False).alias("forward"), "seen_from", "seen_to")
    return forward.unionByName(back).distinct()


def _seen(date: str) -> Column:
    return F.coalesce(F.col("seen_from") <= F.col(date), F.lit(True)) & F.coalesce(F.col("seen_to") >= F.col(date), F.lit(True))


def expand_shared(requests: DataFrame, links: DataFrame, budget: int, hops: int) -> DataFrame:
    """``query_id, position, node_id, depth``: connected expansions of all seeds of a query that share its budget of nodes.

    ``requests``: query_id, exclude (a node, or NULL), as_of, seed, ord; ``links``: :func:`dated_links`. Every seed has an equal part
    of the budget, one node at least; its neighbours are visited from the parent that was reached first, other seeds before
    others, then by id. The parts are put one after the other in the order of the seeds, a node counts where it is first,
    and what is beyond the budget is cut off. Links not in force on the query's date, and the excluded node, do not exist.
    """
    names, visited = beside.expand(materialise(_with_parts(requests, budget)), links, hops)
    first = visited.groupBy("query_id", "node").agg(F.min(F.struct("ord", "at", "depth")).alias("k"))
    w = Window.partitionBy("query_id").orderBy("k")
    chosen = first.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= budget)
    return chosen.join(names.select(F.col("no").alias("node"), F.col("name").alias("node_id")), "node").select("query_id", "position", "node_id", F.col("k.depth").alias("depth"))


def _with_parts(requests: DataFrame, budget: int) -> DataFrame:
    return requests.withColumn("part", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.count(F.lit(1)).over(Window.partitionBy("query_id")))))


def expansion_sizes(requests: DataFrame, edges: DataFrame, nodes: DataFrame, budget: int, hops: int) -> DataFrame:
    """``query_id, nodes``: how many nodes :func:`expand_shared` selects over the :func:`dated_links` of ``edges``.

    Every seed is one of ``nodes``. Links are numbers as soon as they are made, and no node gets its place or its name.
    """
    names, near = beside.numbered_links(edges, nodes)
    visited = beside.walked(materialise(_with_parts(requests, budget)), names, near, hops)
    return visited.groupBy("query_id").agg(F.least(F.lit(budget).cast("long"), F.countDistinct("node")).alias("nodes"))


def with_status(requested: DataFrame, selected: DataFrame) -> DataFrame:
    """``query_id, status, nodes`` of every request (``query_id, named``: seeds that it names, in force or not).

    ``ok`` with nodes; else ``no_seed`` where it names none, ``no_eligible_seed`` where none is in force.
    """
    return sized_status(requested, selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes")))


def sized_status(requested: DataFrame, sizes: DataFrame) -> DataFrame:
    """:func:`with_status` of ``sizes (query_id, nodes)``, which has no request without nodes."""
    rows = requested.join(sizes, "query_id", "left")
    status = F.when(F.col("nodes").isNotNull(), "ok").when(F.col("named") > 0, "no_eligible_seed").otherwise("no_seed")
    return rows.select("query_id", status.alias("status"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def triples(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, source_at, target_at, relation``: edges among the selected nodes of a query, and their inverses.

    ``selected``: query_id, position (from 1), node_id; ``edges``: query_id, source_id, target_id, relation_type.
    """
    number = F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation_type")).cast("int") - 1
    a = selected.select("query_id", F.col("node_id").alias("source_id"), (F.col("position") - 1).alias("source_at"))
    b = selected.select("query_id", F.col("node_id").alias("target_id"), (F.col("position") - 1).alias("target_at"))
    forward = edges.join(a, ["query_id", "source_id"]).join(b, ["query_id", "target_id"]).select("query_id", "source_at", "target_at", number.alias("relation"))
    back = forward.select("query_id", F.col("target_at").alias("source_at"), F.col("source_at").alias("target_at"), (F.col("relation") + len(RELATIONS)).alias("relation"))
    return forward.unionByName(back).distinct()


def _bits(mask: int) -> list[int]:
    """The places of the bits that are set, the lowest first."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def steiner_tree(seeds: list[str], links: set[tuple[str, str]], budget: int, hops: int, edge_cost: float = beside.COST, neighbour_prize: float = beside.PRIZE) -> list[str]:
    """Greedy prize-collecting tree over bit masks: nodes are numbered in the order of their ids, a set of nodes is an integer.

    A seed is worth 1, another node ``neighbour_prize`` per seed beside it, every node costs ``edge_cost``. Rings of nodes around the
    tree, up to twice ``hops``, give each seed its shortest way, at each step back by the smallest id; the way that gains most is
    taken until none gains. Then the nodes beside the tree that gain join, the best first, and ends that do not pay go.
    """
    if not seeds or budget < 1:
        return []
    names = sorted({*seeds, *(x for link in links for x in link)})
    number = {name: i for i, name in enumerate(names)}
    beside = [0] * len(names)
    for a, b in links:
        beside[number[a]] |= 1 << number[b]
        beside[number[b]] |= 1 << number[a]
    goal = sum(1 << i for i in {number[s] for s in seeds})
    gain = [(1.0 if goal >> i & 1 else neighbour_prize * (beside[i] & goal).bit_count()) - edge_cost for i in range(len(names))]
    around = lambda mask: reduce(lambda m, i: m | beside[i], _bits(mask), 0)
    order, tree = [number[seeds[0]]], 1 << number[seeds[0]]
    while len(order) < budget:
        rings, reached = [tree], tree
        while len(rings) <= 2 * hops and (ring := around(rings[-1]) & ~reached):
            rings.append(ring)
            reached |= ring
        best, best_gain = None, 0.0
        for depth, ring in enumerate(rings):
            for seed in _bits(ring & goal & ~tree):
                way = [seed]
                for inner in range(depth - 1, 0, -1):
                    way.append(_bits(beside[way[-1]] & rings[inner])[0])
                total = sum(gain[i] for i in way)
                if len(order) + len(way) <= budget and (total > best_gain or (total == best_gain and best and seed < best[0])):
                    best, best_gain = way, total
        if best is None:
            break
        order += reversed(best)
        tree |= sum(1 << i for i in best)
    paying = sorted((i for i in _bits(around(tree) & ~tree) if gain[i] > 0), key=lambda i: (-gain[i], i))[: max(0, budget - len(order))]
    order += paying
    tree |= sum(1 << i for i in paying)
    idle = [i for i in order if not goal >> i & 1 and gain[i] < 0]
    while ends := sum(1 << i for i in idle if tree >> i & 1 and (beside[i] & tree).bit_count() <= 1):
        tree &= ~ends
    return [names[i] for i in order if tree >> i & 1]


def near_links(seeds: DataFrame, citations: DataFrame, budget: int) -> DataFrame:
    """``query_id, a, b``: the citations around a query's seeds that a tree can need, ``a`` the citing case, ``b`` what it cites.

    ``seeds``, ``citations`` as in :func:`cocitation`. A way goes through the smallest case that cites both a seed and
    another target, and the tree takes the cases of most seeds, then the smallest, up to the budget: only those cases stay. So
    what a query brings to a task is bounded by its seeds times the targets beside them, however many cases cite a seed.
    Where seeds stay outside the tree, their cases can take the places of some beside it; :func:`near_trees` has all.
    """
    seen = F.coalesce(F.col("seen_from") <= F.col("as_of"), F.lit(True))
    near = seeds.join(citations.withColumnRenamed("target", "seed"), "seed").filter((F.col("case_id") != F.col("exclude")) & seen).select("query_id", "as_of", "seed", "case_id").distinct()
    cites = near.join(citations, "case_id").filter(seen).select("query_id", "seed", "case_id", "target")
    through = cites.groupBy("query_id", "seed", "target").agg(F.min("case_id").alias("case_id")).select("query_id", "case_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "case_id")
    most = near.groupBy("query_id", "case_id").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= budget).select("query_id", "case_id")
    return cites.join(through.unionByName(most).distinct(), ["query_id", "case_id"], "left_semi").select("query_id", F.col("case_id").alias("a"), F.col("target").alias("b")).distinct()


def steiner_trees(seeds: DataFrame, links: DataFrame, budget: int, hops: int) -> DataFrame:
    """``query_id, position, node_id`` of the tree of every query; ``links``: query_id, a, b of its neighbourhood.

    What :func:`near_links` leaves of a query's neighbourhood comes to one task.
    """

    def solve(key: tuple, start: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        nodes = steiner_tree(start.sort_values("ord")["seed"].tolist(), set(zip(around["a"], around["b"], strict=True)), budget, hops)
        return pd.DataFrame({"query_id": [key[0]] * len(nodes), "position": range(1, len(nodes) + 1), "node_id": nodes})

    # what was computed from the seeds is cut off: both sides would have the same columns
    return seeds.groupBy("query_id").cogroup(materialise(links).groupBy("query_id")).applyInPandas(solve, "query_id string, position int, node_id string")


def near_trees(seeds: DataFrame, citations: DataFrame, budget: int, hops: int) -> DataFrame:
    """The trees of :func:`steiner_trees` over all that the cases near a query's seeds cite, whose links never leave the block of queries that needs them."""

    def tree(start: list[int], links: set[tuple[int, int]]) -> list[int]:
        return steiner_tree(start, links, budget, hops)

    return beside.trees(seeds, citations, budget, tree, every=hops != 2)  # arrays have ways of two hops from either end
