import io
import tarfile
from datetime import date

import pytest

from docketry.operators import ranking
from docketry.sources import archives, sinks, snapshots
from tests.test_graph import EDGES, NODES, edge, node


def tar(path, files):
    with tarfile.open(path, "w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    tar(tmp_path / "meta.tar.gz", {"m/a.json": b"{}", "m/b.json": b"{}"})
    tar(tmp_path / "pdf.tar.gz", {"p/a_EN.pdf": b"x", "p/c_EN.pdf": b"y"})
    rows = archives.members(spark, str(tmp_path))
    both, counters = archives.paired(rows.filter("name like '%.json'"), rows.filter("name like '%.pdf'"))
    assert [r.stem for r in both.collect()] == ["a"]
    assert tuple(counters.first()) == (2, 2, 1, 1)
    archives.refuse_changed(rows, {"other.tar": "x"})
    with pytest.raises(ValueError):
        archives.refuse_changed(rows, {"pdf.tar.gz": "x"})
    assert archives.index_parts('{"parts": [{"name": "p1"}, "p2"]}') == ["p1", "p2"]


def test_graph_versions(spark, tmp_path):
    nodes = spark.createDataFrame([node("a", "case", d=date(2020, 1, 1)), node("b", "case", d=date(2019, 1, 1))], NODES)
    edges = spark.createDataFrame([edge("e", "cites", "a", "b")], EDGES)
    made = snapshots.write_graph(nodes, edges, str(tmp_path), "1")
    n, e = snapshots.read_graph(spark, str(tmp_path), "1")
    assert (n.count(), e.count()) == (made["nodes"], made["edges"]) == (2, 1) and made["relations"] == {"cites": 1}
    again = snapshots.write_graph(nodes.orderBy("label"), edges, str(tmp_path), "2")
    assert again["nodes_digest"] == made["nodes_digest"]
    with pytest.raises(FileExistsError):
        snapshots.write_graph(nodes, edges, str(tmp_path), "1")
    with pytest.raises(ValueError):
        snapshots.write_graph(nodes, spark.createDataFrame([edge("e", "cites", "a", "x")], EDGES), str(tmp_path), "3")


def test_ranking(spark, tmp_path):
    docs = [("bns:103", "103. Punishment for murder and culpable homicide."), ("bnss:173", "173. Information in cognizable cases."), ("crpc:154", "154. Information in cognizable cases to police."), ("n", None), ("e", "!!!")]
    d = spark.createDataFrame(docs, "id string, text string")
    q = spark.createDataFrame([("q", "punishment for murder"), ("none", "!!!"), ("tie", "information")], "q string, t string")
    index = ranking.build(d, "id", "text")
    run = lambda i: [(r.query, r.rank, r.doc) for r in ranking.search(i, q, "q", "t", 5).orderBy("query", "rank").collect()]
    assert run(index) == [("q", 1, "bns:103"), ("tie", 1, "bnss:173"), ("tie", 2, "crpc:154")]
    assert run(ranking.build(d.orderBy("text"), "id", "text")) == run(index)
    made = snapshots.write_index(index, str(tmp_path), "1")
    assert made["status"] == "draft" and run(snapshots.read_index(spark, str(tmp_path), "1")) == run(index)
    with pytest.raises(ValueError):
        ranking.search(index, q, "q", "t", 0)
    with pytest.raises(ValueError):
        ranking.Settings(k1=0)
    snapshots.write_index(ranking.Index(index.postings, index.frequencies.limit(2), index.corpus), str(tmp_path), "2", policy="p")
    with pytest.raises(ValueError):
        snapshots.read_index(spark, str(tmp_path), "2")


def test_node_types_both_ways(spark, tmp_path):
    """Every type of the data model is read; others are refused."""
    edges = spark.createDataFrame([], "edge_id string, relation_type string, origin_split string")
    for version, types in (("known", snapshots.NODE_TYPES), ("odd", ("contract",))):
        sinks.write_new(spark.createDataFrame([(t, t) for t in types], "node_id string, node_type string"), f"{tmp_path}/nodes/graph_version={version}")
        sinks.write_new(edges, f"{tmp_path}/edges/graph_version={version}")
    assert {"party", "date_anchor"} < {r.node_type for r in snapshots.read_graph(spark, str(tmp_path), "known")[0].collect()}
    with pytest.raises(ValueError, match="contract"):
        snapshots.read_graph(spark, str(tmp_path), "odd")


def test_a_version_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_new(rows, f"{tmp_path}/t")
    with pytest.raises(FileExistsError):
        sinks.write_new(rows.limit(0), f"{tmp_path}/t")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()] == [("a", 1)]
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
