import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort import cli
from kohort.operators import ordering, validation, views
from kohort.plans import workflows
from kohort.sources import readers, writers
from kohort.streaming import incremental

Bad = validation.ContractError


def put(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_numbers_and_numeric_strings(spark):
    df = spark.createDataFrame([(str(i),) for i in range(1000, 0, -1)], "id string")
    rows = ordering.numbered(df, ordering.numeric_string("id"), "at").collect()
    assert sorted((r["at"], int(r["id"])) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_case_ids_and_bad_rows(spark, tmp_path):
    path = put(tmp_path / "c.jsonl", {"id": 5}, "", {"id": 0, "original_id": "x"}, {"id": "0"}, {"id": "", "original_id": None}, "no json", [1], {"id": "  "}, {"id": False, "original_id": 0.0}, {"id": 7.0})
    good, bad = readers.identified(readers.lines(spark, path))
    assert {r.line_no: r.id for r in good.collect()} == {0: "5", 2: "x", 3: "0", 4: "4", 8: "8", 9: "7.0"} or {r.line_no: r.id for r in good.collect()} == {0: "5", 2: "x", 3: "0", 4: "4", 8: "8", 9: "7"}
    assert {r.line_no: r.why for r in bad.collect()} == {5: "no JSON", 6: "no object", 7: "blank id"}
    rows, rest = readers.jsonl(spark, path, "id string")
    assert (rows.count(), rest.count(), readers.count_jsonl(spark, path)) == (7, 2, 9)
    df = spark.createDataFrame([(0, "a", 3), (None, None, 4), (2, "b", 5)], "id int, original_id string, n int")
    assert [r.x for r in df.select(readers.case_id(df, "n").alias("x")).collect()] == ["a", "4", "2"]
    files = spark.createDataFrame([(x,) for x in ("q", "r")], "v string").repartition(2)
    files.write.text(str(tmp_path / "many"))
    assert {r.line_no for r in readers.lines(spark, str(tmp_path / "many")).collect()} == {0}


def test_json_lists(spark, tmp_path):
    for name, value in (("list.json", [{"id": "1"}, {"id": "2"}]), ("object.json", {"cases": [{"id": "1"}, {"id": "2"}]})):
        assert sorted(r.id for r in readers.json_cases(spark, put(tmp_path / name, value)).collect()) == ["1", "2"]


def test_recall_files(spark, tmp_path):
    c = lambda i, **s: {"case_id": i, **s}
    path = put(
        tmp_path / "r.jsonl",
        {"query_case_id": " 1 ", "ground_truth": ["2"], "candidates": [c("2", score_text=0.5, score_event=None), c("3", score_fuse=0.9), c("4", score_text=0.5)]},
        {"query_id": "5", "candidates": []},
        {"case_id": "6", "ground_truth": []},
    )
    got = readers.recall_jsonl(spark, path, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.candidate_id, r["rank"], r.q_min, r.q_max) for r in got] == [("1", "3", 1, 0.5, 0.9), ("1", "2", 2, 0.5, 0.9), ("5", None, None, 0.0, 0.0), ("6", None, None, 0.0, 0.0)]
    assert (got[0].text_min, got[0].text_max) == (0.0, 0.5)
    for rows in ([{"query_case_id": "1", "candidates": [c("")]}], [{"query_case_id": None, "query_id": "1"}], [{"query_id": "1"}, {"query_id": " 1"}], [{"query_id": "1", "candidates": [c("2"), c("2 ")]}]):
        with pytest.raises(Bad):
            readers.recall_jsonl(spark, put(tmp_path / "bad.jsonl", *rows)).collect()
    twice = put(tmp_path / "t.jsonl", {"query_case_id": "1", "ground_truth": ["9"], "candidates": [c("2", score_fuse=0.1)]}, {"query_case_id": "1", "ground_truth": ["3", "3"], "candidates": [c("3", score_fuse=0.7), c("4")]}, {"query_case_id": "2"})
    kept, truth, ends = readers.recall_lenient(spark, twice, 1)
    assert [(r.query_id, r.candidate_id) for r in kept.collect()] == [("1", "3")] and [tuple(r) for r in truth.collect()] == [("1", "3")]
    assert [(r.query_id, r.fuse_min, r.fuse_max) for r in ends.collect()] == [("1", 0.7, 0.7)]


def test_arrays(spark, tmp_path):
    n = 9000
    x = np.random.default_rng(1).random((n, 4)).astype(np.float32)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "case_ids.txt").write_text("\n".join(f"c{i}" for i in range(n)))
    np.save(tmp_path / "deep" / "emb_text_full.npy", x)
    np.save(tmp_path / "valid_mask_text.npy", (np.arange(n) % 3 > 0).reshape(-1, 1).astype(np.float32))
    got = readers.embedding_directory(spark, str(tmp_path), "text").orderBy("position").collect()
    assert len(got) == n and all(got[i].id == f"c{i}" and got[i].valid == (i % 3 > 0) and np.allclose(got[i].vec, x[i]) for i in (0, 1, 4095, 4096, 8999))
    np.save(tmp_path / "valid_mask_text.npy", np.ones((n, 2)))
    with pytest.raises(Bad):
        readers.embedding_directory(spark, str(tmp_path), "text")
    np.savez(tmp_path / "s.npz", qc=np.array([["a", "b"], ["a", "b"], ["c", "c"], ["d", "e"]]), p=np.array([0.2, 0.6, 0.5, 1.5]), y=np.array([0, 1, 0, 0]))
    kept, dropped = readers.npz_scores(spark, str(tmp_path / "s.npz"), strict=False)
    assert [tuple(r) for r in kept.collect()] == [("a", "b", 0.6, 1)]
    assert {r.why: r.n for r in dropped.collect()} == {"self pair": 1, "out of range": 1, "repeated": 1}
    with pytest.raises(Bad):
        readers.npz_scores(spark, str(tmp_path / "s.npz"))
    writers.write_npy_atomic(str(tmp_path / "v.npy"), x[:3])
    assert np.array_equal(np.load(tmp_path / "v.npy"), x[:3])


def test_folds_scopes_and_config(spark, tmp_path, monkeypatch):
    for f in (1, 2):
        (tmp_path / f"fold_0{f}").mkdir()
        for split, ids in (("train", ["a"]), ("dev", ["b"]), ("test", ["c"])):
            put(tmp_path / f"fold_0{f}" / f"{split}_incidents.json", json.dumps(ids, indent=1))
    assert readers.fold_directory(spark, str(tmp_path)).count() == 6
    put(tmp_path / "fold_splits.json", {"n_folds": 2, "total_incidents": 4})
    with pytest.raises(Bad):
        readers.fold_directory(spark, str(tmp_path))
    put(tmp_path / "fold_splits.json", {"n_folds": 2, "total_incidents": 3})
    put(tmp_path / "fold_01" / "dev_incidents.json", {"a": 1})
    with pytest.raises(Bad):
        readers.fold_directory(spark, str(tmp_path)).count()
    assert readers.scope_months("full") is None and readers.scope_months("months", months_list=["2024-02", "2023-01", "2024-02"]) == [(2023, 1), (2024, 2)]
    assert readers.scope_months("range", first="2023-12", last="2024-01") == [(2023, 12), (2024, 1)]
    with pytest.raises(Bad):
        readers.scope_months("month")
    rows = spark.createDataFrame([("r", 2024, 1), ("r", 2024, 2), ("s", 2024, 1)], "classification_result string, archive_year int, archive_month int")
    assert readers.count_scope(rows, classification="r", scope=[(2024, 1)]) == 1
    ini = put(tmp_path / "c.ini", "[Database]", "host = h", "database = d", "user = u", "password_env = KOHORT_SECRET")
    with pytest.raises(Bad):
        readers.database_config(readers.load_config(ini))
    monkeypatch.setenv("KOHORT_SECRET", "s")
    assert readers.database_config(readers.load_config(ini))["port"] == 5432
    assert readers.split_list("a, ,b") == ["a", "b"] and readers.config_path("x", "/y") == "/y/x"


def test_inference_cases_and_assembly(spark):
    base = {f: None for f in readers.INFERENCE_FIELDS}
    rows = spark.createDataFrame([(" 1", '["a", "b"]', "", None), ("2", "[]", None, "x"), ("3", "plain", " ", "y"), ("4", None, "k", "z")], "news_id string, ai_system_type_list string, domain string, harm_type string")
    for f in base:
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast("string"))
    got = {r.id: r for r in readers.inference_cases(rows).collect()}
    assert [got[i].ai_system_type for i in "1234"] == ["a", "__MISSING__", "plain", "__MISSING__"]
    assert [got[i].domain for i in "1234"] == ["", "__MISSING__", " ", "k"] and got["1"].harm_type == "__MISSING__"
    with pytest.raises(Bad):
        readers.inference_cases(rows.limit(0))
    gold = spark.createDataFrame([("7", "e1")], "report_id string, event_id string")
    texts = spark.createDataFrame([("7 ", "t", "body"), ("8", "", "")], "report_id string, title string, text string")
    feats = spark.createDataFrame([("7", "", "{x,,y}", "dom")], "report_id string, actor_main string, ai_system_list string, domain string")
    r = readers.assemble_cases(gold, texts, feats).first()
    assert (r.id, r.title, r.event_annotation.actor_main, r.event_annotation.domain, r.ai_tech.ai_system_list, r.gold_event_id) == (7, "t", None, "dom", ["x", "y"], "e1")
    with pytest.raises(Bad):
        readers.assemble_cases(gold.union(gold.selectExpr("'9'", "'e'")), texts, feats)


def test_views(spark, tmp_path):
    rows = [
        {"id": "1", "title": " T ", "text": "body", "release_date": "2024-05-06T10", "event_annotation": {"actor_main": "who", "actor_list": ["p", " ", "q"], "ai_system": "sys", "event_type": "kind", "event_cause": "c" * 900}, "ai_risk": {"ai_risk_type": "rt", "ai_risk_description": "rd"}, "ai_tech": {"ai_system_list": ["s1"]}},
        {"id": "2", "title": None, "text": None, "_filter_metadata": {"ai_tech_elements": [], "ai_risk_elements": ["bias（x）", "two"], "incident_elements": {"Time": "2023-01-02 03:04", "Subject": "sub", "Cause": "cc"}}, "ai_tech": {"ai_system_list": ["s2", "s3"]}},
    ]
    df = spark.read.json(put(tmp_path / "c.jsonl", *rows))
    got = {r.id: r for r in views.case_views(df).collect()}
    assert got["1"].text_view == "Title: T\nBody: body" and got["2"].text_view == "Title: \nBody:"
    assert got["1"].event_view.split("\n") == ["Title: T", "Time: 2024-05-06", "EventType: kind", "Subject: who", "Actors: p, , q", "AITech: sys, s1", "AIRisk: rt | rd", "Cause: " + "c" * 400, "Process: ", "Result:"]
    assert got["2"].event_view.split("\n")[1:9] == ["Time: 2023-01-02", "EventType: bias", "Subject: sub", "Actors: sub", "AITech: s2, s3", "AIRisk: bias（x）, two", "Cause: cc", "Process: "]
    e = {r.id: r for r in views.element_views(df).collect()}
    assert e["1"].actor_list == ["p", "q"] and e["1"].event_cause == "c" * 500 and e["1"].actor_main_valid and not e["1"].domain_valid and not e["2"].actor_list_valid
    flat = spark.createDataFrame([("1", "t", "x", '["a", " ", "b", "c"]', "sys", "s" * 300, "2024-01-02 03", "d")], "id string, title string, content string, event_actor_list string, event_ai_system string, ai_risk_subtype string, event_time_start string, ai_risk_description string")
    r = views.database_views(flat).first()
    assert "Actors: a, , b, c\nAITech: sys\nAIRisk: d\n" in r.event_view and "Time: 2024-01-02\n" in r.event_view
    d = views.element_views(flat, database=True, most=2).first()
    assert d.actor_list == ["a", "b"] and d.ai_system == "sys" and len(d.ai_risk_subtype) == 150
    made = views.case_views(df).withColumn("event_view", F.when(F.col("id") == "1", F.col("event_view")))
    assert writers.write_views(made, str(tmp_path / "v")) == {"rows": 2, "written": 1, "failed": 1, "covered": False}
    assert spark.read.json(str(tmp_path / "v" / "failed")).first().why == "no view"


def test_scopes_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2024, 1), ("b", 2024, 1), ("c", 2024, 2)], "id string, archive_year int, archive_month int")
    calls = []

    def channel(df):
        calls.append(1)
        return df.select("id")

    target = str(tmp_path / "t")
    first = incremental.process_scopes(rows, [(2024, 1), (2024, 2)], {"text": channel}, target)
    again = incremental.process_scopes(rows, [(2024, 1), (2024, 2), (2024, 3)], {"text": channel}, target)
    assert [x["rows"] for x in first] == [2, 1] and [x["skipped"] for x in again] == [True, True, False] and len(calls) == 3
    new = spark.createDataFrame([("a", 1), ("z", 2)], "id string, v int")
    assert incremental.add_to_table(new.where("v = 1"), str(tmp_path / "i")) == {"added": 1, "count": 1}
    assert incremental.add_to_table(new, str(tmp_path / "i")) == {"added": 1, "count": 2}
    assert incremental.add_to_table(new.where("v = 2"), str(tmp_path / "i"), rebuild=True) == {"added": 1, "count": 1}
    make = lambda folder: new.write.mode("overwrite").parquet(f"{folder}/out")
    run = lambda config: incremental.resume(spark, str(tmp_path / "r"), config, ("out",), make)
    assert [run({"a": 1}), run({"a": 1}), run({"a": 2}), run({"a": 2})] == [False, True, False, True]


def test_contracts(spark):
    cases = spark.createDataFrame([(" a", "x", 1), ("b", "x", 0), ("a", "x", 2), ("c", "y", 0)], "id string, incident string, place int")
    own = spark.createDataFrame([("x",)], "incident string")
    assert sorted(r.id for r in validation.split_cases(cases, own).collect()) == ["a", "b"]
    assert validation.gold_clusters(cases, own, "place").first().members == ["b", "a"]
    routes = [spark.createDataFrame([(x, ok) for x, ok in zip("dcba", flags)], "id string, valid boolean") for flags in ((True, True, True, True), (True, False, True, True))]
    assert [r.id for r in validation.valid_queries(*routes, 1).orderBy("place").collect()] == ["b", "d"]
    nested = spark.createDataFrame([("a", [("b", 2.0, None, 0.1), ("a", 0.5, 0.5, 0.5), ("z", 0.5, 0.5, 0.5), ("c", 0.5, 0.5, 0.5)])], "query_id string, candidates array<struct<candidate_id string, score_fuse double, score_text double, score_event double>>")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [(r.candidate_id, r.score_fuse_norm, r.score_text_norm) for r in validation.filter_pairs(nested, known, top_m=3).collect()] == [("b", 1.0, 0.0)]
    fine = {k: 0.5 for k in validation.BOUNDED_METRICS} | {"metrics_version": validation.METRICS_VERSION}
    validation.require_metrics(fine)
    for broken in (fine | {"ari": float("nan")}, fine | {"nmi": 2}, {k: v for k, v in fine.items() if k != "ari"}, fine | {"metrics_version": "1"}):
        with pytest.raises(Bad):
            validation.require_metrics(broken)
    validation.consistent({"seed": 1}, {"seed": 1, "mode": "m"}, optional=("mode",))
    with pytest.raises(Bad):
        validation.consistent({"seed": 1}, {"seed": 2})
    gold = spark.createDataFrame([("r1", "zh_0001"), ("r2", "zh_0003"), ("r3", "zh_0003")], "report_id string, event_id string")
    assert [r.event_id for r in validation.contiguity(gold, "event_id", "zh_").collect()] == ["zh_0002"]
    assert tuple(validation.size_summary(gold, "event_id").first()) == (3, 2, 1, 2)
    assert [tuple(r) for r in readers.gold_partition(gold).orderBy("event_id").collect()] == [("zh_0001", 1, ["r1"]), ("zh_0003", 2, ["r2", "r3"])]


def test_sinks_and_command_line(spark, tmp_path):
    rows = spark.createDataFrame([("m", "d", 0.5), ("m", "d", 0.7), ("b", "d", 0.4)], "method string, dataset string, f1 double")
    r = writers.comparison(rows, ["f1"], "b", "m").first()
    assert (r.baseline, r.baseline_std, round(r.method, 9), round(r.method_std, 9), round(r.delta, 9)) == (0.4, 0.0, 0.6, round(0.02**0.5, 9), 0.2)
    files = spark.createDataFrame([("a/x", 5), ("a/y", 2), ("b/z", 1)], "path string, bytes long")
    assert {x.category: (x.files, x.bytes) for x in writers.manifest_by_category(files).collect()} == {"a": (2, 7), "b": (1, 1)}
    with pytest.raises(Bad):
        writers.freeze_manifest({}, str(tmp_path / "m.json"))
    assert writers.missing_assets(str(tmp_path), {"core": ["x"]}, "core") == ["x"]
    clusters = spark.createDataFrame([("b", "a"), ("a", "a"), ("c", "c")], "node string, cluster string")
    writers.write_clusters(clusters, str(tmp_path / "k"))
    assert {x.node: x.cluster_id for x in spark.read.json(str(tmp_path / "k" / "nodes")).collect()} == {"a": 0, "b": 0, "c": 1}
    script = put(tmp_path / "latest_test.py", "pass")
    assert cli.main(["prepare-train", "--script", script, "--splits", str(tmp_path), "--out", str(tmp_path / "h.json"), "--", "--epochs", "3"]) == 0
    assert json.loads((tmp_path / "h.json").read_text())["argv"][1:] == [os.path.realpath(script), "--epochs", "3"]
    for refused in ("--test-split=x", "--chinese-gold"):
        with pytest.raises(Bad):
            workflows.training_handoff(script, str(tmp_path), args=[refused])
    gold = put(tmp_path / "gold.csv", "report_id,gold_v2_event_id", "a,e1", "b,e1", "c,e2")
    scores = put(tmp_path / "s.jsonl", *[{"query_id": x, "candidate_id": y, "probability": 0.9} for x, y in ("ab", "ba")])
    assert cli.main(["select-dev", "--gold", gold, "--scores", scores, "--out", str(tmp_path / "scan.json")]) == 0
    scan = json.loads((tmp_path / "scan.json").read_text())
    assert len(scan["table"]) == 86 and scan["source"] == "dev_only" and scan["selected_theta"] == 0.9
    assert cli.main(["lock-thetas", "--scans", f"1={tmp_path}/scan.json", "--out", str(tmp_path / "lock.json")]) == 0
    for backend in ("sparse", "dense"):
        assert cli.main(["evaluate", "--gold", gold, "--scores", scores, "--theta", "0.5", "--backend", backend, "--out", str(tmp_path / "e.json")]) == 0
        assert json.loads((tmp_path / "e.json").read_text())["hungarian_g2p"] == 1.0
