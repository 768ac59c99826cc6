import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kohort.functions.scalars import choose2, integer_grid, text_of
from kohort.operators import graph, linkage, metrics, models, pairs, recall, validation
from kohort.plans import catalog, workflows

Bad = validation.ContractError


def rows_of(spark, rng, n, folds=2):
    out = []
    for i in range(n):
        u, v = rng.normal(size=3), rng.normal(size=3)
        good = i % 3 == 0
        out.append((i % folds, str(i), f"c{i}", int(good), float(good) + 0.3 * rng.normal(), [float(x) for x in u], [float(x) for x in (u + 0.1 * v if good else v)]))
    return spark.createDataFrame(out, "fold int, query_id string, candidate_id string, label int, sim double, q_report array<double>, c_report array<double>")


def test_training_and_inference(spark):
    rng = np.random.default_rng(2)
    train, dev = rows_of(spark, rng, 400), rows_of(spark, rng, 200)
    runs = models.train_folds(train, dev, ["sim"], ("q_report", "c_report"), epochs=6, rate=0.02, hidden=(16, 8), batch=32).collect()
    assert len(runs) == 12 and sorted(r.fold for r in runs if r.best) == [0, 1]
    for r in (r for r in runs if r.best):
        own = [x for x in runs if x.fold == r.fold]
        assert r.dev_f1 == max(x.dev_f1 for x in own) and r.epoch == min(x.epoch for x in own if x.dev_f1 == r.dev_f1) and r.dev_f1 > 0.8
        w = models.weights_of(r.weights)
        held = dev.where(F.col("fold") == r.fold)
        p = models.predict(held, w, ["sim"], vectors=("q_report", "c_report")).join(held, ["query_id", "candidate_id"])
        tp, fp, fn = p.selectExpr("count_if(prediction = 1 and label = 1)", "count_if(prediction = 1 and label = 0)", "count_if(prediction = 0 and label = 1)").first()
        assert abs(2 * tp / (2 * tp + fp + fn) - r.dev_f1) < 1e-9
    with pytest.raises(Bad):
        models.predict(dev, w, ["sim"])
    with pytest.raises(Bad):
        models.predict(dev, models.initial_weights(1), ["sim"], vectors=("q_report", "c_report"))
    with pytest.raises(Bad):
        models.predict(dev, models.initial_weights(2), ["sim"])
    logistic = models.train_folds(train, dev, ["sim"], epochs=4, rate=0.1).where("best").collect()
    assert all(r.dev_f1 > 0.7 for r in logistic)
    spark_w = models.fit_logistic(train, ["sim"])
    assert spark_w["wide_w"][0] > 1 and models.predict(dev, spark_w, ["sim"]).count() == 200
    assert tuple(models.pos_weight(train).first())[:2] == (134, 266)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    w = models.initial_weights(2, 8, (5, 4), 1)
    w["wide_w"] = rng.normal(size=2)
    wide, deep, y = rng.normal(size=(7, 2)), rng.normal(size=(7, 8)), (rng.random(7) < 0.5).astype(float)
    weight = np.where(y == 1, 3.0, 1.0)
    g, _ = models._gradients(w, wide, deep, y, weight)
    for k in w:
        flat = w[k].reshape(-1) if w[k].ndim else None
        for i in range(min(5, w[k].size)):
            moved = {**w, k: w[k].astype(float).copy()}
            losses = []
            for step in (1e-6, -1e-6):
                x = w[k].astype(float).copy().reshape(-1)
                x[i] += step
                moved[k] = x.reshape(w[k].shape)
                losses.append(models._gradients(moved, wide, deep, y, weight)[1])
            assert abs((losses[0] - losses[1]) / 2e-6 - np.asarray(g[k]).reshape(-1)[i]) < 1e-5, (k, i, flat is None)


def test_reports_checkpoints_and_encoder(spark, tmp_path):
    cases = spark.createDataFrame([("a", [1.0, 2.0], True, [3.0]), ("b", [1.0, 1.0], False, None)], "id string, x array<double>, x_valid boolean, y array<double>")
    reports = models.report_vectors(cases, ["x", "y"], {"x": 2, "y": 1})
    assert {r.id: r.report for r in reports.collect()} == {"a": [1, 2, 3], "b": [0, 0, 0]}
    two = spark.createDataFrame([("a", "b", 0.5), ("a", "z", 0.25)], "query_id string, candidate_id string, sim double")
    w = {"wide_w": np.array([2.0]), "wide_b": np.asarray(-1.0), "w0": np.eye(12, 1), "b0": np.zeros(1)}
    got = {r.candidate_id: r.probability for r in models.predict(models.with_reports(two, reports), w, ["sim"], vectors=("q_report", "c_report")).collect()}
    assert np.isclose(got["b"], 1 / (1 + np.exp(-1.0))) and np.isclose(got["z"], 1 / (1 + np.exp(-0.5)))
    path = str(tmp_path / "c.npz")
    models.save_checkpoint(path, w, {"epoch": 2})
    assert models.load_checkpoint(path)[1] == {"framework": "numpy", "epoch": 2, "wide_dim": 1, "layers": [1]}
    models.save_checkpoint(path, w, {"layers": [2]})
    with pytest.raises(Bad):
        models.load_checkpoint(path)
    models.save_checkpoint(path, w, {"framework": "other"})
    with pytest.raises(Bad):
        models.load_checkpoint(path)

    def make():
        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("bad")
            return np.array([[len(t), 1.0] for t in texts])

        return run

    texts = spark.createDataFrame([("1", "abc"), ("2", "bad"), ("3", " "), ("4", None)], "id string, text string").coalesce(1)
    got = {r.id: (r.valid, r.vec) for r in models.encode_texts(texts, make, 2).collect()}
    assert [got[i][0] for i in "1234"] == [True, False, False, False] and np.isclose(np.linalg.norm(got["1"][1]), 1) and got["2"][1] == [0, 0]


def test_pairs_and_folds(spark):
    candidates = spark.createDataFrame([("a", "b", 0.9, None, 0.9, 1), ("a", "c", 0.1, 0.2, 0.2, 2), ("b", "a", 0.5, 0.5, 0.5, 1)], "query_id string, candidate_id string, score_text double, score_event double, score_fuse double, rank int")
    cases = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "id string, incident string")
    truth = spark.createDataFrame([("a", "c")], "query_id string, candidate_id string")
    label = lambda df: {(r.query_id, r.candidate_id): r.label for r in df.collect()}
    assert label(pairs.build_pairs(candidates, cases)) == {("a", "b"): 1, ("a", "c"): 0, ("b", "a"): 1}
    assert label(pairs.build_pairs(candidates, cases, truth=truth)) == {("a", "b"): 0, ("a", "c"): 1, ("b", "a"): 0}
    splits = spark.createDataFrame([(1, "train", "x"), (1, "train", "y"), (2, "dev", "x"), (2, "train", "y")], "fold int, split string, incident string")
    rows = pairs.prepare_folds(candidates, cases, splits, empty=2).collect()
    assert {(r.query_id, r.candidate_id) for r in rows if r.fold == 2 and r.split == "dev"} == {("a", "b"), ("b", "a")}
    lone = [r for r in rows if r.fold == 1 and r.query_id == "d"]
    assert len(lone) == 2 and all(r.label == 0 and r.score_fuse == r.score_text_norm == 0 and r.q_inc == "y" and r.c_inc for r in lone)
    two = [r for r in rows if r.fold == 2 and r.split == "train"]
    assert {(r.query_id, r.candidate_id) for r in two} == {("c", "d"), ("d", "c")}
    empty = pairs.build_pairs(candidates, cases).withColumn("label", F.lit(0))
    assert {r.query_id for r in pairs.sample_training(empty, max_empty=1).collect()} < {"a", "b"} and pairs.sample_training(empty, max_empty=0).count() == 0
    ids = spark.createDataFrame([(f"i{i}", i % 4 + 1) for i in range(50)], "incident string, n int")
    split = {r.incident: r.split for r in pairs.split_incidents(ids).collect()}
    assert [sum(v == s for v in split.values()) for s in ("train", "dev", "test")] == [35, 5, 10]
    assert split == {r.incident: r.split for r in pairs.split_incidents(ids.orderBy(F.desc("incident")).repartition(5)).collect()}
    assert pairs.random_repeats(ids, 3).groupBy("repeat", "split").count().where("count = 30").count() == 3
    folds = pairs.make_folds(ids, 5)
    assert folds.collect() == pairs.make_folds(ids.orderBy(F.desc("incident")), 5).collect()
    assert validation.split_violations(folds, ids.select("incident"), incident="incident").count() == 0
    load = [r.s for r in folds.where("split = 'test'").join(ids, "incident").groupBy("fold").agg(F.sum("n").alias("s")).collect()]
    assert max(load) - min(load) <= 4
    with pytest.raises(Bad):
        pairs.make_folds(ids, most=10)
    voc = pairs.vocabulary(spark.createDataFrame([("b",), ("a",)], "f string"), ["f"])
    assert [(r.token, r.code) for r in voc.orderBy("code").collect()] == [("__MISSING__", 0), ("a", 1), ("b", 2)]


def test_ranking_counts_every_query(spark):
    found = spark.createDataFrame([("q1", "a", 1)], "query_id string, candidate_id string, rank int")
    truth = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, candidate_id string")
    asked = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "query_id string")
    assert tuple(recall.ranking_metrics(found, truth, [5]).first()) == (5, 0.5, 0.5, 0.5)
    assert tuple(recall.ranking_metrics(found, truth, [5], asked).first()) == (5, 0.25, 0.25, 0.25)


def test_searches(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    for metric, score in (("ip", x @ x.T), ("l2", -((x[:, None] - x[None]) ** 2).sum(2))):
        got = recall.VectorIndex(df, metric=metric, block=40).search(df, 5).collect()
        want = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :5]
        assert {(r.query_id, r["rank"], r.candidate_id) for r in got} == {(f"{i:03}", j + 1, f"{c:03}") for i, row in enumerate(want) for j, c in enumerate(row)}
    with pytest.raises(ValueError):
        recall.VectorIndex(df, "ivf", "l2")
    with pytest.raises(ValueError):
        recall.VectorIndex(df).search(df, 0)
    ties = np.array([[1.0, 2.0, 2.0, 0.0, 2.0, 1.0, 1.0, 0.0, 0.0, 2.0], [0.0] * 10])
    assert recall._greatest(ties, 2)[0].tolist() == [[1, 2], [0, 1]]
    odd = df.union(spark.createDataFrame([("zero", [0.0] * 6), ("none", None)], "id string, vec array<double>"))
    for found in (recall.knn(odd, odd, 5, block=40), recall.knn_approximate(odd, odd, 5, block=7)):
        assert not {"zero", "none"} & {x for r in found.collect() for x in (r.query_id, r.candidate_id)}
    known, unknown = recall.lookup_queries(spark.createDataFrame([(" 001",), ("zz",)], "id string"), df)
    assert [r.id for r in known.collect()] == ["001"] and [r.id for r in unknown.collect()] == ["zz"]


def test_backends_agree_and_ids_are_stripped(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        ids = [f"n{i}" for i in range(9)]
        s = [(a, b, float(rng.uniform(0.2, 0.98))) for a in ids for b in ids if a < b and rng.random() < 0.6]
        nodes = spark.createDataFrame([(x,) for x in ids], "node string")
        scores = spark.createDataFrame(s, "query_id string, candidate_id string, probability double")
        one, two = (sorted(map(tuple, linkage.cluster_events(nodes, scores, 0.4, "either", backend=b).collect())) for b in ("sparse", "dense"))
        assert one == two
    nodes = spark.createDataFrame([("a ",), (" b",), ("c",)], "node string")
    scores = spark.createDataFrame([("a", " b", 0.9), ("b ", "a", 0.9)], "query_id string, candidate_id string, probability double")
    out = linkage.cluster_events(nodes, scores, 0.5)
    assert {r.node: r.cluster for r in out.collect()} == {"a": "a", "b": "a", "c": "c"}
    assert tuple(linkage.size_statistics(out).first()) == (2, 3, 1, 2, [2, 1])
    edges = spark.createDataFrame([("a", "b", 0.9)], "u string, v string, w double")
    forced = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "node string, cluster string")
    assert linkage.clique_violations(forced, edges, 0.5).first().violations == 2


def test_empty_ids_raise(spark):
    for pair in (("", "b", 0.5), (None, "b", 0.5), ("a", "  ", 0.5)):
        with pytest.raises(Bad):
            graph.directed_scores(spark.createDataFrame([pair], "query_id string, candidate_id string, probability double"))
        assert graph.directed_scores(spark.createDataFrame([pair], "query_id string, candidate_id string, probability double"), lenient=True).count() == 0


def test_large_counts(spark):
    n = [0, 1, 2, 3, 300_000_002, 5_000_000_000]
    got = [int(r.c) for r in spark.createDataFrame([(x,) for x in n], "n long").select(choose2("n").alias("c")).collect()]
    assert got == [x * (x - 1) // 2 for x in n]
    table = spark.createDataFrame([("g", "p", 5_000_000_000), ("g", "q", 1)], "gold string, pred string, n long")
    r = metrics.pairwise(table).first()
    assert int(r.tp) == 5_000_000_000 * 4_999_999_999 // 2 and int(r.fn) == 5_000_000_000 and r.precision == 1.0
    assert integer_grid(0.5, 0.54, 0.02) == [0.5, 0.52, 0.54]
    with pytest.raises(ValueError):
        integer_grid(0.5, 0.5)
    df = spark.createDataFrame([([1, 2], None)], "a array<int>, b string")
    assert tuple(df.select(text_of(df, "a"), text_of(df, "b")).first()) == ("[1,2]", "")


def test_matching_by_components_and_whole(spark):
    rng = np.random.default_rng(9)
    cells = {(int(t), int(g), int(p)): int(n) for t, g, p, n in zip(rng.integers(0, 3, 120), rng.integers(0, 12, 120), rng.integers(0, 15, 120), rng.integers(1, 9, 120))}
    table = spark.createDataFrame([(t, f"g{g}", f"p{p}", n) for (t, g, p), n in cells.items()], "theta int, gold string, pred string, n long")
    rounded = lambda df: sorted([x if not isinstance(x, float) else round(x, 9) for x in r] for r in df.collect())
    assert rounded(metrics.hungarian(table, by="theta")) == rounded(metrics.hungarian(table, by="theta", cells=0))
    one = table.where("theta = 1").drop("theta")
    assert rounded(metrics.hungarian(one)) == rounded(metrics.hungarian(one, cells=0)) == [r[1:] for r in rounded(metrics.hungarian(table, by="theta")) if r[0] == 1]


def test_thresholds(spark):
    table = spark.createDataFrame([(0.1, 0.5, 0.5, 0.5), (0.2, 0.7, 0.6, 0.1), (0.3, 0.7, 0.6, 0.2), (0.4, 0.7, 0.5, 0.9), (0.5, 0.7 - 1e-15, 0.6, 0.2)], "theta double, hungarian_f1_g2p double, hungarian_f1_symmetric double, b_cubed_f1 double")
    assert workflows.best_threshold(table).first().theta == 0.3
    assert workflows.midpoint_threshold(table).first().theta == 0.4
    runs = spark.createDataFrame([(1, 2, 0.5, 0.4), (2, 1, 0.5, 0.4), (3, 1, 0.4, 0.9)], "repeat int, epoch int, dev double, test double")
    assert models.best_overall(runs, "dev", "test", "-repeat", "-epoch").first().repeat == 1


def test_ranking_by_incidents_counts_unlisted_truth(spark):
    """truth that is all others of an incident is counted, not listed."""
    own = [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 3), ("g", None), ("a", 1)]
    incidents = spark.createDataFrame(own, "id string, incident int")
    found = spark.createDataFrame([("a", "d", 1), ("a", "b", 2), ("b", "b", 1), ("b", "c", 3), ("d", "e", 1), ("g", "g", 1)], "query_id string, candidate_id string, rank int")
    listed = sorted({(x, y) for x, i in own for y, j in own if x != y and i is not None and i == j})
    truth = spark.createDataFrame(listed, "query_id string, candidate_id string")
    asked = spark.createDataFrame([(x,) for x in "abcdefg"], "query_id string")
    for queries in (None, asked):
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(recall.ranking_metrics(found, None, [1, 2, 5], queries, incidents)) == rows(recall.ranking_metrics(found, truth, [1, 2, 5], queries))
    with pytest.raises(Bad):
        recall.ranking_metrics(found, None, [1], incidents=incidents.union(spark.createDataFrame([("a", 2)], "id string, incident int")))


def test_exact_search_streams_the_base(spark, monkeypatch):
    """F2 to F21: a query is shuffled once and its block goes past a base of any length; ties, copies and forgotten ids."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 8)).round(1)
    x[200:] = x[rng.integers(0, 40, 100)]  # copies, more than k of some
    x[150:190] = x[0]
    ids = [f"{i:03}" for i in rng.permutation(300)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>")
    by = np.argsort(ids)
    x = x[by].astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-np.round(u @ u.T, 12), axis=1, kind="stable")[:, :7]
    monkeypatch.setattr(recall, "TASK_QUERIES", 64)
    found = recall.knn(df, df, 7, block=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Generate ") == 1 and "Window" not in plan
    assert {(r.query_id, r["rank"], r.candidate_id) for r in found.collect()} == {(f"{i:03}", j + 1, f"{c:03}") for i, row in enumerate(want) for j, c in enumerate(row)}
    monkeypatch.setattr(recall, "HELD", 50)
    monkeypatch.setattr(recall, "BLOCK", 9)
    near = recall._Nearest(pa.array(sorted(ids)[:3]), x[:3], 7, "cosine", 2)
    for i in range(0, 300, 20):
        near.add(pa.array(sorted(ids)[i : i + 20]), x[i : i + 20])
    assert near.seen < 150
    got = pa.Table.from_batches(near.results())
    assert got["candidate_id"].to_pylist() == [f"{c:03}" for row in want[:3] for c in row] and got["rank"].to_pylist() == [*range(1, 8)] * 3


def test_wide_features_keep_reports(spark):
    """reports come along with the features, as a later join would give them."""
    rows = [("a", [1.0, 0.0], True), ("b", [0.5, 2.0], False), ("c", None, True)]
    cases = spark.createDataFrame(rows, "id string, head array<float>, head_valid boolean")
    asked = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "none")], "query_id string, candidate_id string")
    later = models.with_reports(pairs.wide_features(asked, cases, (), ("head",)), models.report_vectors(cases, ["head"], {"head": 2}))
    kept = pairs.wide_features(asked, cases.withColumn("report", models.report_vector(cases, ["head"], {"head": 2})), (), ("head",), keep=("report",))
    assert sorted(map(str, kept.select(*sorted(kept.columns)).collect())) == sorted(map(str, later.select(*sorted(later.columns)).collect())) and set(kept.columns) == set(later.columns)


def test_scan_sends_runs_of_thresholds(spark):
    """a task sends a node's runs, not a row for each threshold, and holds edges in arrays; ties as one cut at a time."""
    rng = np.random.default_rng(3)
    thetas = [i / 100 for i in range(10, 96)]
    e = [(f"n{i:02}", f"n{j:02}", float(rng.integers(1, 21)) / 20) for i in range(24) for j in range(i + 1, 24) if rng.random() < 0.8 and i // 8 == j // 8]
    found = linkage._runs(pa.table({c: [x[i] for x in e] for i, c in enumerate("uvw")}), np.array([1.0 - t + graph.EPS for t in thetas[::-1]]))
    assert found.num_rows < 24 * 20
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(25)], "node string")
    edges = spark.createDataFrame(e, "u string, v string, w double")
    got = {}
    for r in linkage.linkage_at(nodes, edges, thetas).collect():
        got.setdefault(r.theta, {}).setdefault(r.cluster, []).append(r.node)
    for t in thetas:
        history = linkage.merge_history(25, [(int(u[1:]), int(v[1:]), 1.0 - w) for u, v, w in e], 1.0 - t)
        want = [[f"n{i:02}" for i in g] for g in linkage.cut_history(25, history, 1.0 - t)]
        assert sorted(sorted(g) for g in got[t].values()) == want and all(c == min(g) for c, g in got[t].items())


def _shuffled(spark, run) -> int:
    """Rows that shuffles write while run works."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    run()
    return sum(n for stage, n in stages().items() if stage > before)


@pytest.mark.parametrize("name", ["pair_scores", "wide_features"])
def test_pair_features_shuffle_as_the_input_grows(spark, tmp_path, name):
    """twice the vectors, one block of the former search and then two, are twice the shuffled rows, with no table broadcast."""
    rng = np.random.default_rng(4)
    rows = {}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (2048, 4096):
            x = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 64).astype(np.float32)), 64).cast(pa.list_(pa.float32()))
            (tmp_path / str(n)).mkdir()
            pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": x, "label": pa.array([i % 10 for i in range(n)], pa.int32())}), tmp_path / str(n) / "embeddings.parquet")
            rows[n] = _shuffled(spark, lambda: catalog.queries()[name](spark, str(tmp_path / str(n))).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < rows[4096] < 2.2 * rows[2048], rows
