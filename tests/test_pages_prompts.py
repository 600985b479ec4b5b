import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import references
from docketry.operators import pages, prompts
from docketry.sources import files, registries, sinks


def test_clean_pages(spark):
    bodies = ["The appeal was heard and the judg-", "His claim was met with a judg-", "No court has passed a judg-"]
    rows = [("d", n, f"ALPHA v. BETA\n{n}\nA\n{b}\nment reserved on {n}\nfor good reasons.\n(2) Next point stands.\nSUPREME COURT REPORTS [2015]\nORDER\nDone.") for n, b in enumerate(bodies, 1)]
    text = pages.clean(spark.createDataFrame(rows, "document_id string, page_no int, text string")).first().text
    assert text == "\n".join(f"{b[:-1]}ment reserved on {n} for good reasons.\n(2) Next point stands.\nORDER\nDone." for n, b in enumerate(bodies, 1))


def test_prompt(spark):
    row = spark.range(1).select(prompts.prompt(F.sequence(F.lit(1), F.lit(9)), F.array(F.lit(0)), F.sequence(F.lit(101), F.lit(199)), F.array(F.lit(-1)), 10, 3).alias("p")).first()
    assert row.p == [1, 2, 3, 0, 101, 102, 103, 104, 105, -1]


def test_prefix_and_pooling(spark):
    v = lambda *x: F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in x])
    out = spark.range(1).select(prompts.with_prefix(v((1, 1)), v((2, 2), (3, 3)), v((4, 4)), F.array(F.lit(7))).alias("x"), prompts.attention_pool(v((1, 0), (0, 1)), F.array(F.lit(0.0), F.lit(0.0))).alias("a")).first()
    assert out.x.labels == [-100, -100, -100, 7] and out.x.mask == [1] * 4 and len(out.x.vectors) == 4
    assert out.a == [0.5, 0.5]
    pooled = prompts.mean_pool(spark.createDataFrame([("o", [1.0, 2.0]), ("o", [3.0, 6.0])], "o string, v array<double>"), "o", "v").first()
    assert pooled.v == [2.0, 4.0]


def test_cache_key():
    key = lambda seeds, relations: prompts.cache_key({"query": "q", "seeds": seeds, "prizes": {"a": 1.0}, "relations": relations}, {"budget": 8, "hops": 2}, "v")
    assert key(["a", "b"], None) == key(["b", "a"], None) != key(["a", "b"], [])


def test_calibration(spark):
    rows = [(f"c{i}", "dismissed", x, s) for i in range(4) for x, s in (("allowed", -0.5), ("dismissed", -0.9), ("disposed", -3.0), ("partly_allowed", -3.0))]
    offsets = prompts.calibrate(spark.createDataFrame(rows, "case string, gold string, label string, score double"), [-1.0, 0.0, 1.0], rounds=1)
    assert offsets["dismissed"] - offsets["allowed"] > 0.4


def test_spans_and_ids(spark):
    text = "Under Section 302 IPC and (2020) 4 SCC 123."
    rows = references.extract(spark.createDataFrame([("d", text), ("n", None)], "doc string, t string"), "doc", "t").collect()
    assert [(r.span_start, text[r.span_start : r.span_end]) for r in rows] == [(6, "Section 302 IPC"), (26, "(2020) 4 SCC 123")]
    assert all(r.raw_text == text[r.span_start : r.span_end] and r.method == "indian_regex_v2" for r in rows)
    assert rows[0].extraction_id == references.extraction_id("d", "provision", 6, 21, "provision:india:ipc:302:")
    assert [m[5] for m in references.Grammar(1).find("Section 302 of the I.P.C.")] == []
    assert references.Grammar.numbers("302, 34 and 120b(1)") == ["302", "34", "120B"]


def test_judgment_pairs(spark, tmp_path):
    (tmp_path / "extracted_jsons").mkdir()
    (tmp_path / "md").mkdir()
    meta = {"filename": "a.md", "metadata": {"year": "2016"}, "entities": {"case_title": "", "judges": [{"name": " A  B "}, {"name": ""}], "parties": [], "topics": [{"text": "x"}]}}
    (tmp_path / "extracted_jsons" / "a.json").write_text(json.dumps(meta))
    (tmp_path / "md" / "a.md").write_bytes(b"# Alpha v. Beta\r\nJANUARY 13, 2016\r\n")
    row = files.judgment_pairs(spark, str(tmp_path)).first()
    assert row.title == "Alpha v. Beta" and row.attributes["judges"] == "A B" and row.attributes["topics"] == "x" and row.text == "# Alpha v. Beta\nJANUARY 13, 2016"
    (tmp_path / "extracted_jsons" / "b.json").write_text(json.dumps(meta | {"filename": "absent.md"}))
    with pytest.raises(ValueError, match="missing transcript"):
        files.judgment_pairs(spark, str(tmp_path))


def test_json_lines_refuse(spark, tmp_path):
    good, bad, blank = (tmp_path / n for n in ("g.jsonl", "b.jsonl", "e.jsonl"))
    good.write_text('{"node_id": "n", "text": "t"}\n\n')
    bad.write_text('{"node_id": "n", "text": \n')
    blank.write_text('{"node_id": "n", "text": "  "}\n')
    assert files.provisions(spark, str(good)).count() == 1
    for path in (bad, blank):
        with pytest.raises(ValueError):
            files.provisions(spark, str(path))
    with pytest.raises(ValueError):
        files.records(spark, str(tmp_path), years=[2015, 2016])


def test_statute_list(spark, tmp_path):
    rows = [{"no": "0", "t": "Preamble", "d": "x"}, {"no": "21", "t": "Protection of life", "d": "No person."}, {"no": "21a", "t": "Education", "d": "y"}, {"no": "21", "t": "Again", "d": "z"}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    got = files.statute_list(spark, str(tmp_path / "s.json"), "no", "t", "d").orderBy("pos").collect()
    assert [(r.section, r.kept) for r in got] == [("21", True), ("21A", True), ("21", False)]
    assert got[0].text == "21. Protection of life. No person."
    assert files.infer_act("bns_2023.pdf", {"bns": "bns", "ipc": "ipc"}) == "bns"
    with pytest.raises(ValueError):
        files.infer_act("bnss.pdf", {"bns": "bns", "bnss": "bnss"})


def test_log_steps(spark):
    lines = spark.createDataFrame([(1, "epoch 1 step 25/100 loss 1.5 elapsed 60"), (2, "noise")], "at int, line string")
    assert [tuple(r) for r in files.log_steps(lines).collect()] == [(1, 1, 25, 100, 1.5, 60)]


def test_runs_and_freezing(spark, tmp_path):
    for copy, evaluated in (("a", False), ("b", True)):
        (tmp_path / copy).mkdir()
        (tmp_path / copy / "run.manifest.json").write_text('{"experiment_id": "e"}')
        if evaluated:
            (tmp_path / copy / "test-evaluation.json").write_text("{}")
    row = files.discover_runs(spark, str(tmp_path)).first()
    assert row.path.endswith("/b") and row.evaluated
    frozen = spark.createDataFrame(sinks.file_hashes(spark, str(tmp_path)).collect())
    assert sinks.frozen_changes(frozen, sinks.file_hashes(spark, str(tmp_path))).count() == 0
    (tmp_path / "a" / "run.manifest.json").write_text("changed")
    (tmp_path / "new.json").write_text("x")
    assert {r.change for r in sinks.frozen_changes(frozen, sinks.file_hashes(spark, str(tmp_path))).collect()} == {"changed", "added"}


def test_sinks(spark, tmp_path):
    assert sinks.canonical_json({"b": "é", "a": [1]}) == b'{"a":[1],"b":"\\u00e9"}'
    df = spark.createDataFrame([(i, {"y": "1", "x": str(i)}) for i in range(20)], "id int, m map<string,string>")
    assert sinks.table_digest(df, "id") == sinks.table_digest(df.orderBy(F.desc("id")).repartition(3), "id") != sinks.table_digest(df.limit(19), "id")
    sinks.write_new(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    with pytest.raises(FileExistsError):
        sinks.write_new(df, str(tmp_path / "out"))
    a, b = (sinks.manifest("graph", "1", {"n": 1}, {}, ["s"]) for _ in "ab")
    assert sinks.same_manifests(a, b, ["content_id", "counts"]) == []
    assert sinks.markdown(df.select("id").orderBy("id"), 1) == "| id |\n| --- |\n| 0 |"


def test_registries(tmp_path):
    good = registries.Source("s", "a" * 64, "approved", ("train",))
    registries.validate_sources([good])
    for bad in (registries.Source("s", "x", "approved", ("u",)), registries.Source("s", "a" * 64, "approved"), registries.Source("s", "a" * 64, "excluded", (), True), registries.Source("s", "a" * 64, "odd")):
        with pytest.raises(registries.ConfigurationError):
            registries.validate_sources([bad])
    with pytest.raises(registries.ConfigurationError):
        registries.validate_sources([good, good])
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"schema_version": "1.0.0", "experiment_id": "e", "input_view": "body", "input_character_limit": 10}))
    assert registries.load_baseline(path).alpha == 1.0
    path.write_text(json.dumps({"schema_version": "2", "experiment_id": "e"}))
    with pytest.raises(registries.ConfigurationError):
        registries.load_baseline(path)
    assert registries.policy_differences({"a": "1", "b": "2"}, {"a": "1", "c": "3"}) == ["b", "c"]
    assert registries.preflight([tmp_path / "absent"], ["json", "no_such_package"], 0, tmp_path, [{"artifact": "g", "status": "draft"}]) == [f"missing path {tmp_path / 'absent'}", "missing package no_such_package", "manifest g is draft"]
