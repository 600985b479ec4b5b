"""What cases cite beside the seeds of a query, for all queries, without a row per query and citing case.

Ids become numbers in the order of their names. What is cited together goes once to every block of queries that names one of
both; a block's queries are then answered in memory by slices of arrays that are sorted by date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import materialise

#: Blocks of queries at least, and the seeds of queries (rows) of a block at most, about.
BLOCKS, ROWS = 24, 100_000
_EARLY, _LATE = -(2**31), 2**31 - 1


def numbered(*ids: DataFrame) -> DataFrame:
    """``name, no``: distinct names with numbers in their order."""
    names = ids[0].toDF("name")
    for other in ids[1:]:
        names = names.unionByName(other.toDF("name"))
    return materialise(names.filter("name is not null").distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("no")))


def day(date: str, missing: int) -> Column:
    return F.coalesce(F.unix_date(date), F.lit(missing))


def numbered_citations(citations: DataFrame, *more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``name, no`` of all cases and targets, and of ``more``; ``c, t, d``: who cites what, from which day."""
    names = numbered(citations.select("case_id"), citations.select("target"), *more)
    rows = citations.join(names.select(F.col("name").alias("case_id"), F.col("no").alias("c")), "case_id").join(names.select(F.col("name").alias("target"), F.col("no").alias("t")), "target")
    return names, materialise(rows.groupBy("c", "t").agg(F.min(day("seen_from", _EARLY)).alias("d")))


def together(cites: DataFrame) -> DataFrame:
    """``s, t, c, d``: case ``c`` cites ``s`` and ``t``, both from day ``d`` on."""
    other = cites.select("c", F.col("t").alias("s"), F.col("d").alias("e"))
    return other.join(cites, "c").filter("s <> t").select("s", "t", "c", F.greatest("d", "e").alias("d"))


def asked(seeds: DataFrame, names: DataFrame) -> DataFrame:
    """``block, query_id, x, day, s, n, ord``: cited seeds of queries with a node to leave out; ``n``: all seeds of the query."""
    of = names.select(F.col("name").alias("seed"), F.col("no").alias("s"))
    left_out = names.select(F.col("name").alias("exclude"), F.col("no").alias("x"))
    count = seeds.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = seeds.filter("exclude is not null").join(count, "query_id").join(of, "seed").join(left_out, "exclude", "left")
    blocks = max(BLOCKS, seeds.count() // ROWS)
    return materialise(rows.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", F.coalesce("x", F.lit(-1).cast("long")).alias("x"), day("as_of", _LATE).alias("day"), "s", "n", F.col("ord").cast("int").alias("ord")))


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def by_query(rows: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    """Every query with the places of its rows."""
    ids = rows.column("query_id").combine_chunks().dictionary_encode()
    code = ids.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(ids.dictionary)))
    yield from zip(ids.dictionary.to_pylist(), np.split(order, ends[:-1]), strict=True)


def _counts(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``most``, ascending, and how often each stands there."""
    if len(values) * 16 < most:
        return np.unique(values, return_counts=True)
    n = np.bincount(values, minlength=most)
    there = np.flatnonzero(n)
    return there, n[there]


def _best(shared: np.ndarray, support: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by shared, then support, then the smallest ``u``; ``u`` ascends."""
    if len(u) > 4 * k:
        key = shared * (int(support.max()) + 1) + support
        least = np.partition(key, len(key) - k)[len(key) - k]
        some = np.flatnonzero(key >= least)
    else:
        some = np.arange(len(u))
    return some[np.lexsort((u[some], -support[some], -shared[some]))[:k]]


def _rank_block(budget: int, rows: pa.Table, pairs: pa.Table) -> dict:
    out: dict = {k: [] for k in ("query_id", "r", "t", "shared_seeds", "support")}
    d, order = column(pairs, "d"), np.lexsort((column(pairs, "d"), column(pairs, "s")))
    d = d[order]
    seeds, first = np.unique(column(pairs, "s")[order], return_index=True)
    last = np.append(first[1:], len(order))
    targets, t = np.unique(column(pairs, "t")[order], return_inverse=True)
    cases, c = np.unique(column(pairs, "c")[order], return_inverse=True)
    t, c, most = t.astype(np.int32), c.astype(np.int32), len(targets)
    taken = np.zeros(len(cases), dtype=bool)
    s, x, days, n = (column(rows, k) for k in ("s", "x", "day", "n"))
    for query, at in by_query(rows):
        k = budget - int(n[at[0]])
        if k <= 0:
            continue
        own, places = np.unique(s[at]), []
        for one in own:
            i = int(np.searchsorted(seeds, one))
            if i < len(seeds) and seeds[i] == one:
                lo = first[i]
                hi = lo + int(np.searchsorted(d[lo : last[i]], days[at[0]], "right"))
                if hi > lo:
                    places.append((lo, hi))
        if not places:
            continue
        i = int(np.searchsorted(cases, x[at[0]]))
        left_out = i if i < len(cases) and cases[i] == x[at[0]] else -1
        distinct, fresh, marked = [], [], []
        for lo, hi in places:
            tt, cc = t[lo:hi], c[lo:hi]
            if left_out >= 0 and not (kept := cc != left_out).all():
                tt, cc = tt[kept], cc[kept]
            if len(places) > 1:
                distinct.append(_counts(tt, most)[0])
                fresh.append(tt[~taken[cc]])  # a case counts once, with the first seed that it cites
                taken[cc] = True
                marked.append(cc)
            else:
                fresh.append(tt)
        for cc in marked:
            taken[cc] = False
        u, support = _counts(np.concatenate(fresh), most)
        shared = np.ones(len(u), dtype=np.int64)
        if distinct:  # a seed beside another is no candidate; other targets stand in both
            other, shared = _counts(np.concatenate(distinct), most)
            shared = shared[~np.isin(targets[other], own)]
            kept = ~np.isin(targets[u], own)
            u, support = u[kept], support[kept]
        best = _best(shared, support, u, k)
        out["query_id"] += [query] * len(best)
        out["r"].append(np.arange(1, len(best) + 1, dtype=np.int32))
        out["t"].append(targets[u[best]])
        out["shared_seeds"].append(shared[best])
        out["support"].append(support[best])
    kinds = {"r": np.int32, "t": np.int64, "shared_seeds": np.int64, "support": np.int64}
    return {"query_id": pa.array(out["query_id"], pa.string())} | {k: pa.array(np.concatenate(out[k]).astype(kind) if out[k] else np.array([], kind)) for k, kind in kinds.items()}


def _near(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``to, s, t, c, d``: what the seeds of a block are cited with."""
    here = rows.groupBy("block", "s").agg(F.max("day").alias("most")).join(pairs, "s").filter("d <= most")
    return here.select(F.col("block").alias("to"), F.col("s").alias("of"), "t", "c", "d").withColumnRenamed("of", "s")


def ranked(rows: DataFrame, pairs: DataFrame, budget: int) -> DataFrame:
    """``query_id, r, t, shared_seeds, support``: the best targets beside a query's seeds, as many as its budget leaves."""

    def solve(_: tuple, rows: pa.Table, pairs: pa.Table) -> pa.Table:
        return pa.table(_rank_block(budget, rows, pairs))

    return rows.groupBy("block").cogroup(_near(rows, pairs).groupBy("to")).applyInArrow(solve, "query_id string, r int, t long, shared_seeds long, support long")


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _choose_block(budget: int, rows: pa.Table, pairs: pa.Table) -> dict:
    more = _rank_block(budget, rows, pairs)
    ids = pa.chunked_array([*rows.column("query_id").chunks, more["query_id"]], pa.string()).combine_chunks().dictionary_encode()
    code, n = ids.indices.to_numpy(), column(rows, "n")
    one = np.unique(code[: len(n)], return_index=True)[1]  # a row of every query
    no = np.concatenate([column(rows, "s"), more["t"].to_numpy()])
    at = np.concatenate([column(rows, "ord") - 1, n[one][code[len(n) :]] + more["r"].to_numpy() - 1])
    code, no, at = (v[at < budget] for v in (code, no, at))
    order, sizes = np.lexsort((no, code)), np.bincount(code, minlength=len(one))
    out = {k: rows.column(k).take(pa.array(one)) for k in ("block", "query_id", "x", "day")}
    return out | {"nodes": _lists(no[order], sizes, pa.int64()), "at": _lists(at[order], sizes, pa.int32())}


def chosen(rows: DataFrame, pairs: DataFrame, budget: int) -> DataFrame:
    """``block, query_id, x, day, nodes, at``: the nodes of every query (its seeds, then :func:`ranked`) in their order, and their positions from 0."""

    def solve(_: tuple, rows: pa.Table, pairs: pa.Table) -> pa.Table:
        return pa.table(_choose_block(budget, rows, pairs))

    return rows.groupBy("block").cogroup(_near(rows, pairs).groupBy("to")).applyInArrow(solve, "block int, query_id string, x long, day int, nodes array<long>, at array<int>")


def _link_block(rows: pa.Table, meets: pa.Table) -> dict:
    a, b, d, c, later = (column(meets, k) for k in ("a", "b", "d", "c", "later"))
    names = np.unique(np.concatenate([a, b]))
    key = np.searchsorted(names, a) * len(names) + np.searchsorted(names, b)
    order = np.argsort(key)
    key, d, c, later = (v[order] for v in (key, d, c, later))
    nodes, at = (rows.column(k).combine_chunks() for k in ("nodes", "at"))
    sizes = np.diff(nodes.offsets.to_numpy())
    q, no, at = np.repeat(np.arange(len(sizes)), sizes), nodes.flatten().to_numpy(), at.flatten().to_numpy().astype(np.int64)
    i = np.searchsorted(names, no)
    known = i < len(names)
    known[known] = names[i[known]] == no[known]  # others meet nobody
    q, i, at = q[known], i[known], at[known]
    x, day = column(rows, "x"), column(rows, "day")
    after = np.cumsum(np.bincount(q, minlength=len(sizes)))[q] - np.arange(len(q)) - 1  # nodes of the query behind a node
    found, met = [np.array([], np.int64)], np.zeros(len(sizes), dtype=np.int64)
    groups = np.cumsum(after) // AT_ONCE
    cuts = np.append(np.flatnonzero(np.diff(groups, prepend=-1)), len(q))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = after[lo:hi]
        one = np.repeat(np.arange(lo, hi), n)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        pair = i[one] * len(names) + i[two]
        k = np.minimum(np.searchsorted(key, pair), len(key) - 1)
        of = q[one]
        seen = (key[k] == pair) & (np.where(c[k] == x[of], later[k], d[k]) <= day[of])
        found.append(at[one[seen]] << 32 | at[two[seen]])
        met += np.bincount(of[seen], minlength=len(met))
    return {"query_id": rows.column("query_id"), "links": _lists(np.concatenate(found), met, pa.int64())}


def linked(asking: DataFrame, meets: DataFrame) -> DataFrame:
    """``query_id, links``: two positions in one number, of nodes of a query (:func:`chosen`) that meet (:func:`first_two`) for it.

    What two nodes meet by goes once to a block of queries that has the first of them; no row per query and two nodes is made here.
    """

    def solve(_: tuple, rows: pa.Table, meets: pa.Table) -> pa.Table:
        return pa.table(_link_block(rows, meets))

    nodes = asking.select("block", "day", F.explode("nodes").alias("a")).groupBy("block", "a").agg(F.max("day").alias("most"))
    here = nodes.join(meets.withColumn("later", F.coalesce(F.col("later").cast("long"), F.lit(_LATE + 1))), "a").filter("d <= most")
    here = here.select(F.col("block").alias("to"), "a", "b", "d", "c", "later")
    return asking.groupBy("block").cogroup(here.groupBy("to")).applyInArrow(solve, "query_id string, links array<long>")


def first_two(pairs: DataFrame) -> DataFrame:
    """``a, b, d, c, later``, a < b: the first day and case of two nodes, and the first day of any other case."""
    from pyspark.sql import Window

    w = Window.partitionBy("s", "t").orderBy("d", "c")
    rows = pairs.filter("s < t").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    rows = rows.groupBy(F.col("s").alias("a"), F.col("t").alias("b")).agg(F.min(F.struct("d", "c")).alias("k"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("later"))
    return rows.select("a", "b", "k.d", "k.c", "later")


def earliest(pairs: DataFrame, budget: int) -> DataFrame:
    """``s, t, c, d, later``: :func:`first_two` from both sides, as many targets of a seed as a count up to ``budget`` can need.

    Of a seed and a first case the ``budget`` targets seen first and the ``budget`` that another case shows first stay, then of a seed the first
    three times ``budget``. Whatever case a query leaves out and whatever its date, of what it sees beside a seed either all is here, or ``budget``
    targets are: at most two thirds of those that stay have that case as their first, and what goes stands behind ``budget`` that are seen when it is.
    """
    from pyspark.sql import Window

    rows = first_two(pairs).select("d", "c", F.coalesce(F.col("later").cast("long"), F.lit(_LATE + 1)).alias("later"), F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("two"))
    rows = rows.select("two.s", "two.t", "c", "d", "later").repartition("s")
    of, r = Window.partitionBy("s", "c"), F.row_number()
    rows = rows.withColumn("p", r.over(of.orderBy("d", "t"))).withColumn("u", r.over(of.orderBy("later", "t"))).filter((F.col("p") <= budget) | (F.col("u") <= budget))
    return rows.withColumn("r", r.over(Window.partitionBy("s").orderBy("d", "t"))).filter(F.col("r") <= 3 * budget).select("s", "t", "c", "d", "later")


#: Targets that are compared at once, about.
AT_ONCE = 2_000_000


def _cover_block(rows: pa.Table, pairs: pa.Table) -> dict:
    order = np.lexsort((column(pairs, "d"), column(pairs, "s")))
    c, d, later = (column(pairs, k)[order] for k in ("c", "d", "later"))
    seeds, first, of = np.unique(column(pairs, "s")[order], return_index=True, return_inverse=True)
    targets, t = np.unique(column(pairs, "t")[order], return_inverse=True)
    when = (of.astype(np.int64) << 32) + d.astype(np.int64) - _EARLY
    ids = rows.column("query_id").combine_chunks().dictionary_encode()
    code = ids.indices.to_numpy()
    by = np.argsort(code, kind="stable")
    q, (s, x, days) = code[by].astype(np.int64), (column(rows, k)[by] for k in ("s", "x", "day"))
    i = np.searchsorted(seeds, s)
    i[i == len(seeds)] = 0
    there = seeds[i] == s if len(seeds) else np.zeros(len(s), dtype=bool)
    lo = np.where(there, first[i], 0) if len(seeds) else np.zeros(len(s), dtype=np.int64)
    n = np.where(there, np.searchsorted(when, (i.astype(np.int64) << 32) + days.astype(np.int64) - _EARLY, "right") - lo, 0)
    out = np.zeros(len(ids.dictionary), dtype=np.int64)
    starts = np.flatnonzero(np.diff(q, prepend=-1))  # cut where a query begins
    groups = np.cumsum(n)[starts] // AT_ONCE
    cuts = np.append(starts[np.flatnonzero(np.diff(groups, prepend=-1))], len(q))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        row = np.repeat(np.arange(a, z), n[a:z])
        at = np.arange(len(row)) - np.repeat(np.cumsum(n[a:z]) - n[a:z], n[a:z]) + lo[row]
        seen = (c[at] != x[row]) | (later[at] <= days[row])
        found = np.unique(q[row[seen]] * len(targets) + t[at[seen]])
        j = np.searchsorted(targets, s[a:z])
        own = j < len(targets)
        own[own] = targets[j[own]] == s[a:z][own]
        found = found[~np.isin(found, q[a:z][own] * len(targets) + j[own])]  # a seed is no candidate
        if len(found):
            out += np.bincount(found // len(targets), minlength=len(out))
    return {"query_id": ids.dictionary, "more": pa.array(out, pa.int64())}


def covered(rows: DataFrame, pairs: DataFrame, budget: int) -> DataFrame:
    """``query_id, more``: how many targets stand beside the seeds of a query (:func:`asked`); exact up to what its budget leaves, at least that beyond."""

    def solve(_: tuple, rows: pa.Table, pairs: pa.Table) -> pa.Table:
        return pa.table(_cover_block(rows, pairs))

    here = rows.groupBy("block", "s").agg(F.max("day").alias("most")).join(earliest(pairs, budget).withColumnRenamed("s", "of"), F.col("s") == F.col("of")).filter("d <= most")
    here = here.select(F.col("block").alias("to"), F.col("of").alias("s"), "t", "c", "d", "later")
    return rows.groupBy("block").cogroup(here.groupBy("to")).applyInArrow(solve, "query_id string, more long")


def _hop_block(depth: int, rows: pa.Table, links: pa.Table) -> dict:
    order = np.lexsort((column(links, "nb"), column(links, "of")))
    of, nb, lo, hi = (column(links, k)[order] for k in ("of", "nb", "lo", "hi"))
    nodes, first = np.unique(of, return_index=True)
    ends = dict(zip(nodes.tolist(), zip(first.tolist(), np.append(first[1:], len(of))[: len(first)].tolist(), strict=True), strict=True))
    s, x, node, at, part, far, since, until, ord_ = (column(rows, k) for k in ("s", "x", "node", "at", "part", "depth", "since", "until", "ord"))
    source, found, places, done = [], [], [], []
    for _, mine in by_query(rows):
        seeds = np.unique(s[mine]).tolist()
        mine = mine[np.lexsort((at[mine], ord_[mine], s[mine]))]
        for own in np.split(mine, np.flatnonzero(np.diff(s[mine])) + 1):
            one, last = own[0], int(at[own[-1]])
            room, out, known = int(part[one]) - last, [], {*node[own].tolist(), int(x[one])}
            for parent in own[(far[own] == depth - 1) & (at[own] < part[one])].tolist() if room > 0 else []:
                a, z = ends.get(int(node[parent]), (0, 0))
                for v in seeds if z > a else ():  # other seeds before others
                    i, j = a + np.searchsorted(nb[a:z], [v, v + 1])
                    if j > i and v not in known and len(out) < room and ((lo[i:j] <= until[one]) & (hi[i:j] >= since[one])).any():
                        known.add(v)
                        out.append(v)
                size = 128
                while a < z and len(out) < room:  # in their order, only as far as there is room
                    b = min(a + size, z)
                    for v in nb[a:b][(lo[a:b] <= until[one]) & (hi[a:b] >= since[one])].tolist():
                        if v not in known:
                            known.add(v)
                            out.append(v)
                            if len(out) == room:
                                break
                    a, size = b, size * 4
                if len(out) == room:
                    break
            source += [one] * len(out)
            found += out
            places += range(last + 1, last + 1 + len(out))
            done += [len(out) < room] * len(out)
    kept = rows.take(pa.array(source, pa.int64()))
    new = {"node": pa.array(found, pa.int64()), "at": pa.array(places, pa.int32()), "depth": pa.array([depth] * len(found), pa.int32()), "open": pa.array(done, pa.bool_())}
    return {k: new.get(k, kept.column(k)) for k in rows.column_names}


STATE = "block int, query_id string, x long, since int, until int, ord int, part int, s long, node long, at int, depth int, open boolean"


def hop(visited: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """The nodes (``STATE``) that the seeds of all queries reach next, in order, as many as their parts have room for.

    ``visited``: what was reached before; ``links``: of, nb, lo, hi. A node's links go once to a block of queries.
    """

    def solve(_: tuple, rows: pa.Table, links: pa.Table) -> pa.Table:
        return pa.table(_hop_block(depth, rows, links))

    parents = visited.filter(f"open and depth = {depth - 1} and at < part").groupBy("block", "node").agg(F.max("until").alias("most"))
    here = parents.join(links, F.col("node") == F.col("of")).filter("lo <= most").select(F.col("block").alias("to"), "of", "nb", "lo", "hi")
    return materialise(visited.filter("open or depth = 0").groupBy("block").cogroup(here.groupBy("to")).applyInArrow(solve, STATE))


def expand(requests: DataFrame, links: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Names, and every node (``STATE``) that the seeds of ``requests (query_id, exclude, as_of, seed, ord, part)`` reach within so many hops."""
    names = numbered(links.select("node_id"), links.select("neighbour"), requests.select("seed"), requests.select("exclude"))
    number = lambda old, new: names.select(F.col("name").alias(old), F.col("no").alias(new))
    near = links.join(number("node_id", "of"), "node_id").join(number("neighbour", "nb"), "neighbour")
    near = materialise(near.select("of", "nb", day("seen_from", _EARLY).alias("lo"), day("seen_to", _LATE).alias("hi")).distinct())
    return names, walked(requests, names, near, hops)


def numbered_links(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``name, no`` of all nodes, and ``of, nb, lo, hi``: the dated links of edges, which are numbers as soon as they meet their ends."""
    ends = nodes.select("node_id", F.greatest("available_from", "decision_date").alias("from"), F.col("available_to").alias("to"))
    ends = materialise(ends.orderBy("node_id").withColumn("no", F.monotonically_increasing_id()))
    end = lambda side: ends.select(F.col("node_id").alias(f"{side}_id"), F.col("no").alias(side), F.col("from").alias(f"{side}_from"), F.col("to").alias(f"{side}_to"))
    rows = edges.join(end("source"), "source_id").join(end("target"), "target_id")
    rows = rows.select("source", "target", F.greatest("available_from", "source_decision_date", "source_from", "target_from").alias("seen_from"), F.least("available_to", "source_to", "target_to").alias("seen_to"))
    ways = F.explode(F.array(F.struct(F.col("source").alias("of"), F.col("target").alias("nb")), F.struct(F.col("target").alias("of"), F.col("source").alias("nb"))))
    near = rows.select(ways.alias("way"), day("seen_from", _EARLY).alias("lo"), day("seen_to", _LATE).alias("hi")).select("way.of", "way.nb", "lo", "hi")
    return ends.select(F.col("node_id").alias("name"), "no"), materialise(near.distinct())


def walked(requests: DataFrame, names: DataFrame, near: DataFrame, hops: int) -> DataFrame:
    """Every node (``STATE``) that the seeds of ``requests`` reach over ``near (of, nb, lo, hi)`` within so many hops."""
    number = lambda old, new: names.select(F.col("name").alias(old), F.col("no").alias(new))
    rows = requests.join(number("seed", "s"), "seed").join(number("exclude", "x"), "exclude", "left")
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(BLOCKS, requests.count() // ROWS))).cast("int")
    start = rows.select(
        block.alias("block"), "query_id", F.coalesce("x", F.lit(-1).cast("long")).alias("x"), day("as_of", _EARLY).alias("since"), day("as_of", _LATE).alias("until"), F.col("ord").cast("int").alias("ord"),
        F.col("part").cast("int").alias("part"), "s", F.col("s").alias("node"), F.lit(1).alias("at"), F.lit(0).alias("depth"), (F.col("part") > 1).alias("open"),
    )
    visited = materialise(start)
    for depth in range(1, hops + 1):
        visited = visited.unionByName(hop(visited, near, depth))
    return visited


#: What a node of a tree costs, and what a node beside a seed is worth a seed; a seed is worth 1.
COST, PRIZE = 0.1, 0.25


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places from each ``lo`` to its ``hi``."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Near:
    """What cases cite, both ways, with the tree of one query after the other; nodes are places in ``names``."""

    def __init__(self, cites: pa.Table, more: np.ndarray) -> None:
        c, t, d = (column(cites, k) for k in ("c", "t", "d"))
        self.names = np.unique(np.concatenate([c, t, more]))
        c, t, n = np.searchsorted(self.names, c), np.searchsorted(self.names, t), len(self.names)
        by_case, by_target = np.lexsort((t, c)), np.lexsort((d, t))
        self.to, self.to_d, self.to_at = t[by_case], d[by_case], np.searchsorted(c[by_case], np.arange(n + 1))
        self.of, self.of_d, self.of_at = c[by_target], d[by_target], np.searchsorted(t[by_target], np.arange(n + 1))
        self.both = (np.diff(self.to_at) > 0) & (np.diff(self.of_at) > 0)
        self.worth, self.beside, self.behind = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)

    def citing(self, t: int, x: int, day: int) -> np.ndarray:
        lo, hi = self.of_at[t], self.of_at[t + 1]
        out = self.of[lo : lo + int(np.searchsorted(self.of_d[lo:hi], day, "right"))]
        return out[out != x]

    def cited(self, cases: np.ndarray, day: int) -> tuple[np.ndarray, np.ndarray]:
        """Cases, and what each of them cites."""
        lo, hi = self.to_at[cases], self.to_at[cases + 1]
        at, case = _ranges(lo, hi), np.repeat(cases, hi - lo)
        seen = self.to_d[at] <= day
        return case[seen], self.to[at[seen]]

    def tree(self, seeds: list[int], x: int, day: int, budget: int, slow: Callable[[list[int], set[tuple[int, int]]], list[int]], every: bool) -> list[int]:
        around = {u: self.citing(u, x, day) for u in seeds}
        if every or self.both.any():  # what cites and is cited may be on either side of a way
            case, target = self.cited(np.unique(np.concatenate([*around.values()])), day)
            if every or self.both[case].any() or self.both[target].any():
                return slow(seeds, set(zip(case.tolist(), target.tolist(), strict=True)))
        for cases in around.values():
            self.worth[cases] += 1
        try:
            return self._grow(seeds, around, x, day, budget)
        finally:
            for cases in around.values():
                self.worth[cases] = 0

    def _grow(self, seeds: list[int], around: dict[int, np.ndarray], x: int, day: int, budget: int) -> list[int]:
        """Cases and targets alternate on every way, and all cases are beside a seed: rings come from flags of what is beside the tree
        (``beside``) and of the targets of cases there (``behind``), and only for seeds that no case joins to the tree."""
        gain = lambda i: 1.0 - COST if i in around else PRIZE * int(self.worth[i]) - COST
        shared = {u: cases[self.worth[cases] > 1] for u, cases in around.items()}
        order: list[int] = []
        cases_beside: list[np.ndarray] = []  # of targets of the tree
        targets_beside: list[np.ndarray] = []
        behind: list[np.ndarray] = []
        beyond: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def add(node: int) -> None:
            order.append(node)
            if node in around or not self.worth[node]:
                cases = around[node] if node in around else self.citing(node, x, day)
                cases_beside.append(cases if node in around else cases[self.worth[cases] > 0])
                self.beside[cases_beside[-1]] = True
            else:
                targets_beside.append(self.cited(np.array([node]), day)[1])
                self.beside[targets_beside[-1]] = True

        def way_from(u: int, plain: bool) -> list[int] | None:
            if self.beside[u]:
                return [u]
            near = shared[u] if plain else around[u]
            near = near[self.beside[near]]
            if len(near):
                return [u, int(near.min())]
            if u not in beyond:
                beyond[u] = self.cited(around[u], day)
            case, target = beyond[u]
            there = self.beside[target]
            if there.any():
                w = case[there].min()
                return [u, int(w), int(target[there & (case == w)].min())]
            while len(behind) < len(cases_beside):
                behind.append(self.cited(cases_beside[len(behind)], day)[1])
                self.behind[behind[-1]] = True
            there = self.behind[target]
            if not there.any():
                return None
            w = case[there].min()
            t = int(target[there & (case == w)].min())
            last = self.citing(t, x, day)
            return [u, int(w), t, int(last[self.beside[last]].min())]

        try:
            add(seeds[0])
            left, plain = sorted(u for u in around if u != seeds[0] and len(around[u])), True
            while left and len(order) < budget:
                best, best_gain = None, 0.0
                for u in left:
                    way = way_from(u, plain)
                    if way and len(order) + len(way) <= budget and (total := sum(gain(i) for i in way)) > best_gain:
                        best, best_gain = way, total
                if best is None:
                    break
                for node in reversed(best):
                    add(node)
                plain = plain and len(best) < 3  # else a target may be no seed, and cases of one seed beside it
                left = [u for u in left if u not in best]  # another seed may stand on the way
            room = budget - len(order)
            if room > 0:
                keys = np.concatenate(cases_beside)
                keys = keys - self.worth[keys] * len(self.names)
                most = budget * len(cases_beside)
                keys = np.unique(np.partition(keys, most)[:most] if len(keys) > 4 * most else keys)
                taken = set(order)
                order += [i for i in (keys % len(self.names)).tolist() if i not in taken and gain(i) > 0][:room]
            return order
        finally:
            for at in (*cases_beside, *targets_beside):
                self.beside[at] = False
            for at in behind:
                self.behind[at] = False


def _tree_block(budget: int, tree: Callable[[list[int], set[tuple[int, int]]], list[int]], rows: pa.Table, cites: pa.Table, every: bool = False) -> dict:
    s, x, days, ord_ = (column(rows, k) for k in ("s", "x", "day", "ord"))
    near = _Near(cites, s)
    s, known = np.searchsorted(near.names, s), np.searchsorted(near.names, x)
    known[known == len(near.names)] = 0
    place = np.where(near.names[known] == x, known, -1)
    out: dict = {k: [] for k in ("query_id", "position", "node")}
    for query, at in by_query(rows):
        at = at[np.argsort(ord_[at], kind="stable")]
        seeds, one = s[at].tolist(), at[0]
        nodes = seeds[: min(1, budget)] if x[one] == NOBODY or budget < 1 else near.tree(seeds, int(place[one]), int(days[one]), budget, tree, every)
        out["query_id"] += [query] * len(nodes)
        out["position"] += range(1, len(nodes) + 1)
        out["node"] += near.names[nodes].tolist() if nodes else []
    return {"query_id": pa.array(out["query_id"], pa.string()), "position": pa.array(out["position"], pa.int32()), "node": pa.array(out["node"], pa.int64())}


#: The node to leave out of a query that has none: comparisons with it are unknown, so no case is near.
NOBODY = -2


def trees(seeds: DataFrame, citations: DataFrame, budget: int, tree: Callable[[list[int], set[tuple[int, int]]], list[int]], every: bool = False) -> DataFrame:
    """``query_id, position, node_id`` of the greedy tree (two hops) of every query's seeds in what the cases that cite one of them cite.

    What a case cites goes once to every block of queries that it is near to. ``tree`` solves queries where a node
    cites and is cited, or every query.
    """

    def solve(_: tuple, rows: pa.Table, cites: pa.Table) -> pa.Table:
        return pa.table(_tree_block(budget, tree, rows, cites, every))

    names, cites = numbered_citations(citations, seeds.select("seed"))
    left_out = F.when(F.col("exclude").isNull(), NOBODY).otherwise(F.coalesce("x", F.lit(-1))).cast("long")
    rows = seeds.join(names.select(F.col("name").alias("seed"), F.col("no").alias("s")), "seed").join(names.select(F.col("name").alias("exclude"), F.col("no").alias("x")), "exclude", "left")
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(BLOCKS, seeds.count() // ROWS))).cast("int")
    rows = materialise(rows.select(block.alias("block"), "query_id", left_out.alias("x"), day("as_of", _LATE).alias("day"), F.col("ord").cast("int").alias("ord"), "s"))
    cases = rows.groupBy("block", "s").agg(F.max("day").alias("most")).join(cites.withColumnRenamed("t", "s"), "s").filter("d <= most").groupBy("block", "c").agg(F.max("most").alias("most"))
    here = cases.join(cites, "c").filter("d <= most").select(F.col("block").alias("to"), F.col("c").alias("by"), "t", "d").withColumnRenamed("by", "c")
    found = rows.groupBy("block").cogroup(here.groupBy("to")).applyInArrow(solve, "query_id string, position int, node long")
    return found.join(names.select(F.col("no").alias("node"), F.col("name").alias("node_id")), "node").select("query_id", "position", "node_id")
