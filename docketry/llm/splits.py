"""Splits that keep related records together: random-mate contraction of the graph of shared keys.

Records that share a key (an author, a party, a matter) belong together, directly or through others. The vertices are
the *distinct keys*, not the records: each record only chains its own few keys, so a key with a third of all records is
one vertex and its records never meet in one task. Each round every vertex tosses a coin (a hash of its name and the
round); each *tail* with a *head* among its neighbours contracts into the smallest of them; edges are relabelled by two
joins and made distinct. A constant share of the vertices goes in each round, so rounds grow with the logarithm and all
work with the size. When no edge is left, the rounds are unwound from last to first to give every key its root.

Every round is written to the shared folder, so lineage stays short and lost executors cost their tasks only.

Defined cases: NULL or empty keys link nothing; a record without a key is a component of its own; repeated rows count
once; the order is by a hash of the component, so the assignment does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialise, release

#: Each round contracts a quarter of the vertices with edges or more, on average; this many never come.
MAX_ROUNDS = 200
UNWOUND = 3


def _coin(vertex: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), F.col(vertex)), F.lit(2)) == 1


def contract(edges: DataFrame) -> DataFrame:
    """``(vertex, root)`` of every vertex that has an edge to another one; ``edges`` has string columns ``u, v``."""
    tidy = lambda e: e.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialise(tidy(edges))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(rounds)
        if turn == MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
        u_head, v_head = _coin("u", turn), _coin("v", turn)
        mate = F.when(u_head & ~v_head, F.struct(F.col("v").alias("tail"), F.col("u").alias("head"))).when(v_head & ~u_head, F.struct(F.col("u").alias("tail"), F.col("v").alias("head")))
        mates = materialise(edges.select(mate.alias("m")).filter("m is not null").groupBy(F.col("m.tail").alias("tail")).agg(F.min("m.head").alias("head")))
        relabelled = (
            edges.join(mates.select(F.col("tail").alias("u"), F.col("head").alias("u_to")), "u", "left")
            .join(mates.select(F.col("tail").alias("v"), F.col("head").alias("v_to")), "v", "left")
            .select(F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"))
        )
        after = materialise(tidy(relabelled))
        release(edges)
        edges = after
        rounds.append(mates)
    release(edges)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "vertex string, root string")
    roots, written = None, None
    for k, mates in enumerate(reversed(rounds)):
        if roots is None:
            roots = mates.select(F.col("tail").alias("vertex"), F.col("head").alias("root"))
            continue
        lifted = mates.join(roots.select(F.col("vertex").alias("head"), "root"), "head", "left").select(F.col("tail").alias("vertex"), F.coalesce("root", "head").alias("root"))
        roots = lifted.unionByName(roots)
        if k % UNWOUND == 0 or k == len(rounds) - 1:  # a few rounds to a table: each doubles what the plan reads
            roots = materialise(roots)
            if written is not None:
                release(written)
            written = roots
    return roots


def components(records: DataFrame, record_id: str, keys: list[Column]) -> DataFrame:
    """``(record, component)``; the component is named by its smallest record id."""
    chained = F.array_sort(F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != ""))))
    held = records.filter(F.col(record_id).isNotNull()).select(F.col(record_id).alias("record"), F.explode_outer(chained).alias("key")).distinct()
    held = materialise(held.groupBy("record").agg(F.array_sort(F.collect_set("key")).alias("keys")))
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.size("keys") - 1), lambda i: F.struct(F.element_at("keys", i).alias("u"), F.element_at("keys", i + 1).alias("v"))))
    roots = contract(held.filter(F.size("keys") > 1).select(pairs.alias("e")).select("e.u", "e.v"))
    first = held.select("record", F.get("keys", F.lit(0)).alias("vertex"))
    # a record without a key stands for itself
    labelled = first.join(roots, "vertex", "left").select("record", F.coalesce("root", "vertex", F.concat(F.lit("record|"), "record")).alias("label"))
    labelled = materialise(labelled)
    names = labelled.groupBy("label").agg(F.min("record").alias("component"))
    return labelled.join(names, "label").select("record", "component")


def assign(members: DataFrame, shares: list[tuple[str, float]], digits: int = 3, heavy: float = 0.005) -> DataFrame:
    """``(component, weight, split)``: whole components to splits, in about the given shares of the records.

    Components are laid out in the order of a hash of their name and cut where the cumulative weight passes the shares, so
    every split has components of all sizes alike. Only those of more than ``heavy`` of all records (1 / ``heavy`` at most)
    come before the others, the heaviest first: none of them stands at a cut unless they fill a split. A share is
    met up to the weight of the component at its cut. Without shares the split is NULL. The running sum is taken over
    buckets first (the leading hexadecimal ``digits`` of the hash) and inside a bucket then, so no task sees all components.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("weight")).withColumn("spot", F.md5(F.col("component").cast("binary")))
    sizes = materialise(sizes.withColumn("bucket", F.substring("spot", 1, digits)))
    total = sizes.agg(F.sum("weight")).first()[0] or 0
    sizes = sizes.withColumn("bucket", F.when(F.col("weight") > heavy * total, "").otherwise(F.col("bucket")))
    before = lambda order: F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    blocks = sizes.groupBy("bucket").agg(F.sum("weight").alias("weight"))
    blocks = blocks.select("bucket", before(Window.orderBy("bucket")).alias("start"))  # one row per bucket
    inside = Window.partitionBy("bucket").orderBy(F.when(F.col("bucket") == "", -F.col("weight")), "spot", "component")
    placed = sizes.withColumn("inside", before(inside)).join(blocks, "bucket").withColumn("at", (F.col("start") + F.col("inside")) / F.lit(max(total, 1)))
    split, edge = None, 0.0
    whole = sum(share for _, share in shares)
    for name, share in shares[:-1]:
        edge += share / whole
        split = (F.when if split is None else split.when)(F.col("at") < F.lit(edge - 1e-12), F.lit(name))
    last = F.lit(shares[-1][0] if shares else None).cast("string")
    split = last if split is None else split.otherwise(last)
    return placed.select("component", "weight", split.alias("split"))
