import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.functions.scalars import clip, fuse_score, strip, theta_grid
from kohort.operators import graph, linkage, metrics, pairs, recall, validation
from kohort.operators.components import connected_components
from kohort.plans import workflows
from kohort.sources import readers, writers
from kohort.streaming import incremental


def clusters(spark, nodes, scores, theta, rule="mutual"):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    s = spark.createDataFrame(scores, "query_id string, candidate_id string, probability double")
    found = {}
    for r in linkage.cluster_events(n, s, theta, rule).collect():
        found.setdefault(r.cluster, []).append(r.node)
    return sorted(sorted(v) for v in found.values())


def test_edge_rules_and_cliques(spark):
    both = [("a", "b", 0.9), ("b", "a", 0.8)]
    assert clusters(spark, "abc", both, 0.7) == [["a", "b"], ["c"]]
    assert clusters(spark, "ab", both[:1], 0.7) == [["a"], ["b"]]
    assert clusters(spark, "ab", both[:1], 0.7, "either") == [["a", "b"]]
    chain = [(x, y, p) for a, b, p in (("a", "b", 0.91), ("b", "c", 0.89)) for x, y in ((a, b), (b, a))]
    assert sorted(map(len, clusters(spark, "abc", chain, 0.8))) == [1, 2]


def test_bad_scores_raise(spark):
    for bad in ([("a", "b", float("nan"))], [("a", "b", 1.5)], [("a", "x", 0.5)]):
        with pytest.raises(validation.ContractError):
            clusters(spark, "ab", bad, 0.5)
    with pytest.raises(ValueError):
        clusters(spark, "ab", [("a", "b", 0.5)], 0)


def brute_linkage(n, w, cut):
    groups = [[i] for i in range(n)]
    while True:
        best = None
        for a, b in itertools.combinations(range(len(groups)), 2):
            d = max(w.get((min(i, j), max(i, j)), 1.0) for i in groups[a] for j in groups[b])
            if d <= cut + 1e-12 and (best is None or d < best[0]):
                best = (d, a, b)
        if best is None:
            return sorted(sorted(g) for g in groups)
        groups[best[1]] += groups.pop(best[2])


def test_linkage_against_brute_force_and_history():
    rng = random.Random(5)
    for _ in range(100):
        w = {(i, j): 1 - rng.uniform(0.2, 0.98) for i, j in itertools.combinations(range(7), 2) if rng.random() < 0.6}
        whole = linkage.merge_history(7, [(i, j, d) for (i, j), d in w.items()], 0.9)
        for theta in (0.3, 0.55, 0.75, 0.9):
            kept = {k: d for k, d in w.items() if d <= 1 - theta + 1e-12}
            assert linkage.cut_history(7, linkage.merge_history(7, [(i, j, d) for (i, j), d in kept.items()], 1 - theta), 1 - theta) == brute_linkage(7, kept, 1 - theta)
            assert linkage.cut_history(7, whole, 1 - theta) == brute_linkage(7, kept, 1 - theta)


def evaluate(spark, gold, pred):
    df = lambda m, c: spark.createDataFrame(list(m.items()), f"report_id string, {c} string")
    return metrics.evaluate_partition(df(gold, "gold"), df(pred, "pred")).first()


def test_metrics_with_known_answers(spark):
    one = evaluate(spark, {"1": "x", "2": "x", "3": "y"}, {"1": "p", "2": "p", "3": "q"})
    assert (one.pair_f1, one.b_cubed_f1, one.ari, one.nmi, one.hungarian_symmetric) == (1, 1, 1, 1, 1)
    split = evaluate(spark, {"a": "x", "b": "x"}, {"a": "p", "b": "q"})
    assert (round(split.hungarian_g2p, 9), round(split.hungarian_p2g, 9), split.pair_recall, split.b_cubed_precision, split.b_cubed_recall) == (round(2 / 3, 9), round(1 / 3, 9), 0, 1, 0.5)
    counts = evaluate(spark, {"1": "x", "2": "x", "3": "x", "4": "y"}, {"1": "p", "2": "p", "3": "q", "4": "q"})
    assert (counts.pair_tp, counts.pair_fp, counts.pair_fn) == (1, 1, 2)
    with pytest.raises(validation.ContractError):
        evaluate(spark, {"a": "x"}, {"b": "p"})


def test_assignment_against_permutations():
    rng = np.random.default_rng(3)
    for _ in range(30):
        s = rng.random((4, 5))
        got = s[np.arange(4), metrics.assign(s)].sum()
        assert np.isclose(got, max(sum(s[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4)))


@pytest.mark.parametrize("finish", [0, 40, 1 << 14])
def test_components_chain_and_hub(spark, finish):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), finish=finish).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(" 　 x\x1c ", 0.4, None), (None, 0.4, 0.2)], "s string, a double, b double")
    rows = df.select(strip("s").alias("s"), clip("s", 1).alias("c"), fuse_score("a", "b", "maxmin").alias("f")).collect()
    assert [(r.s, r.c) for r in rows] == [("x", "x"), (None, "")] and [round(r.f, 9) for r in rows] == [0.4, 0.44]
    assert len(theta_grid()) == 86 and theta_grid()[-1] == 0.95


def test_readers_and_manifest(spark, tmp_path):
    gold = tmp_path / "gold.csv"
    gold.write_text("﻿report_id,gold_v2_event_id\na,e1\nb,e1\nc,e2\n", encoding="utf-8")
    assert readers.gold_csv(spark, str(gold)).count() == 3
    gold.write_text("report_id,gold_v2_event_id\na,e1\na,e2\n")
    with pytest.raises(validation.ContractError):
        readers.gold_csv(spark, str(gold))
    rec = tmp_path / "r.jsonl"
    rec.write_text(json.dumps({"query_case_id": "1", "ground_truth": ["2"], "candidates": [{"case_id": "2", "score_text": 0.5, "score_event": 0.2, "score_fuse": 0.8}, {"case_id": "3", "score_fuse": 0.4}]}) + "\n")
    row = readers.recall_jsonl(spark, str(rec), 1).collect()
    assert [(r.candidate_id, r.q_min, r.q_max) for r in row] == [("2", 0.8, 0.8)]
    scores = tmp_path / "s.jsonl"
    scores.write_text('{"query_id": "a", "candidate_id": "b", "probability": 0.4}\n\n{"query_id": "a", "candidate_id": "b", "probability": 0.9}\n')
    assert [r.probability for r in readers.scored_pairs(spark, str(scores)).collect()] == [0.9]
    writers.freeze_manifest({"s": str(scores)}, str(tmp_path / "m.json"))
    writers.verify_manifest(str(tmp_path / "m.json"))
    scores.write_text("changed")
    with pytest.raises(validation.ContractError):
        writers.verify_manifest(str(tmp_path / "m.json"))
    assert readers.months("2023-11", "2024-02") == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]


def test_workflow(spark):
    gold = spark.createDataFrame([("a", "e1"), ("b", "e1"), ("c", "e2")], "report_id string, gold string")
    s = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9)], "query_id string, candidate_id string, probability double")
    best = workflows.select_dev(gold, s, 0.5, 0.9, 0.2)
    assert best["table"][0]["hungarian_f1_g2p"] == 1.0
    lock = workflows.lock_thresholds({1: best})
    rows, summary = workflows.evaluate_folds({1: gold}, {1: s}, lock)
    assert rows.first().pair_f1 == 1.0 and summary.where("metric = 'ari'").first()["std"] == 0
    with pytest.raises(validation.ContractError):
        workflows.lock_thresholds({1: {"source": "test"}})


def test_incremental(spark, tmp_path):
    old = spark.createDataFrame([(1, "x")], "id int, v string")
    new = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a")], "id int, v string")
    assert [tuple(r) for r in incremental.add_first_wins(old, new).collect()] == [(2, "a")]
    src = str(tmp_path / "src")
    new.write.parquet(src)
    q = incremental.stream_first_wins(spark.readStream.schema("id int, v string").parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_fallback_negatives(spark):
    pool = spark.createDataFrame([(str(i),) for i in range(30)], "id string")
    have = spark.createDataFrame([("0", "1")], "query_id string, candidate_id string")
    rows = pairs.fallback_negatives(pool, have, 10).groupBy("query_id").agg(F.countDistinct("candidate_id").alias("n"), F.count_if(F.col("query_id") == F.col("candidate_id")).alias("own")).collect()
    assert len(rows) == 29 and all(r.n == 10 and r.own == 0 for r in rows)
    assert graph.EPS == 1e-12


def test_approximate_recall(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 32))
    df = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "id string, vec array<double>")
    pairs_of = lambda d: {(r.query_id, r.candidate_id) for r in d.select("query_id", "candidate_id").collect()}
    exact, near = pairs_of(recall.knn(df, df, 20)), pairs_of(recall.knn_approximate(df, df, 20))
    assert len(exact & near) >= 0.9 * len(exact)


def test_theta_table_against_single_thresholds(spark):
    rng = random.Random(5)
    ids = [f"r{i}" for i in range(14)]
    gold = spark.createDataFrame([(x, f"e{i % 4}") for i, x in enumerate(ids)], "report_id string, gold string")
    s = spark.createDataFrame([(a, b, rng.random()) for a in ids for b in ids if a != b], "query_id string, candidate_id string, probability double")
    got = {r.theta: r for r in workflows.theta_table(gold, s, [0.2, 0.4, 0.6]).collect()}
    for r in workflows.select_dev(gold, s, 0.2, 0.6, 0.2)["table"]:
        g = got[r["theta"]]
        assert (g.n_pred, round(g.hungarian_f1_g2p, 9), round(g.hungarian_f1_symmetric, 9), round(g.b_cubed_f1, 9)) == (r["num_pred_clusters"], round(r["hungarian_f1_g2p"], 9), round(r["hungarian_f1_symmetric"], 9), round(r["b_cubed_f1"], 9))
