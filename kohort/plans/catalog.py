"""Queries over the driver's tables, one for each operator family, and the same in DuckDB's SQL.

Vectors: embeddings, with the first half of a vector as the text route and the second as the event route; label is the
gold event. Cases: documents with their labels. Large partitions: orders. Directed scores: lineitem.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.functions import scalars as S
from kohort.operators import graph, linkage, metrics, models, ordering, pairs, recall, validation, views
from kohort.plans import workflows
from kohort.session import cut, table
from kohort.sources import readers, writers
from kohort.streaming import incremental

K, THETA, HALF = 20, 0.5, 32
KS = [1, 5, 10, 20]
WEIGHTS = np.array([1.0, 2.0, -1.5])
#: A small deep part over 4 * HALF inputs: two hidden units, sums of u, v, |u - v| and u * v by these factors.
_UNITS = ((0.0, 0.0, 0.5, 0.0), (0.1, -0.1, 0.0, 2.0))
DEEP = {"w0": np.repeat(np.array(_UNITS).T, HALF, axis=0), "b0": np.array([-1.0, 0.2]), "w1": np.array([[-0.7], [1.1]]), "b1": np.array([0.05])}


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return e.select("id", F.slice("embedding", 1, HALF).alias("vec")), e.select("id", F.slice("embedding", HALF + 1, HALF).alias("vec"))


def _knn(spark, d, event=False):
    v = _routes(spark, d)[event]
    return recall.knn(v, v, K)


def _merged(spark, d, mode="max"):
    return recall.merge_routes(_knn(spark, d), _knn(spark, d, True), mode)


def _gold(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("report_id"), F.col("label").cast("string").alias("gold"))


def _directed(spark, d):
    m = _merged(spark, d)
    return graph.directed_scores(m.select("query_id", "candidate_id", F.col("score_fuse").alias("probability")), lenient=True)


def _edges(spark, d, rule="mutual"):
    return graph.undirected_edges(_directed(spark, d), rule)


def _nodes(spark, d):
    return _routes(spark, d)[0].select(F.col("id").alias("node"))


def _clusters(spark, d):
    return linkage.complete_linkage(_nodes(spark, d), cut(_edges(spark, d)), THETA)


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _big(spark, d):
    """A partition of orders by customer against one by customer group and priority."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("gold")), o.select(F.col("o_orderkey").alias("report_id"), F.expr("o_custkey div 3 * 10 + cast(substring(o_orderpriority, 1, 1) as int)").alias("pred"))


def _table(spark, d):
    return metrics.contingency(*_big(spark, d), strict=False)


def _cases(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", *[S.category(c).alias(c) for c in ("lang", "source", "quality", "toxic")])


def _pairs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("incident"))
    return pairs.build_pairs(_merged(spark, d), e, e.where("incident < 6").select("incident"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall on two routes, fusion, mutual edges, complete linkage, and B-cubed against the labels."""
    pred = _clusters(spark, sf_dir).select(F.col("node").alias("report_id"), F.col("cluster").alias("pred"))
    return metrics.b_cubed(metrics.contingency(_gold(spark, sf_dir), pred))


def q_wide(spark, d, keep=()):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("kind"), F.slice("embedding", 1, HALF).alias("head"), F.slice("embedding", HALF + 1, HALF).alias("tail"), (F.col("label") != 3).alias("head_valid"))
    if keep:
        e = e.withColumn("report", models.report_vector(e, ["head"], {"head": HALF}))
    p = _merged(spark, d).select("query_id", "candidate_id")
    return pairs.wide_features(p, e, ("kind",), ("head", "tail"), dim=HALF, keep=keep)


def q_scored(spark, d):
    out = models.predict(q_wide(spark, d), {"wide_w": WEIGHTS, "wide_b": -0.5}, ["eq_kind", "sim_head", "sim_tail"])
    return _r(out, "probability").drop("prediction")


def q_views(spark, d):
    c = table(spark, d, "documents")
    lines = {"Title": "source", "Time": "n_chars", "EventType": "lang", "Subject": "lang", "AIRisk": "source", "Cause": "text", "Process": "text", "Result": "text"}
    view = views.event_view({k: F.col(v).cast("string") for k, v in lines.items()})
    return c.select("doc_id", S.clip("text", 100).alias("clipped"), views.text_view(F.col("source"), F.col("text")).alias("text_view"), view.alias("event_view"), F.coalesce(S.strip(F.col("text")), F.lit("")).alias("whole"))


def q_database_views(spark, d):
    """Documents as database rows: lists as JSON texts, a list that holds the main system and one that lacks it."""
    c = table(spark, d, "documents")
    listed = F.to_json(F.array("lang", F.lit(" "), "source"))
    rows = c.select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("event_type"), F.col("n_chars").cast("string").alias("event_time_start"), listed.alias("event_actor_list"), F.col("source").alias("event_ai_system"), F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.col("lang")).alias("ai_system_list"), F.col("lang").alias("ai_risk_type"), F.col("text").alias("ai_risk_description"), F.col("text").alias("event_cause"))
    return views.database_views(rows).select("doc_id", "text_view", "event_view")


def q_elements(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"), F.col("text").alias("event_cause"), F.col("source").alias("ai_system"), F.to_json(F.array("lang", F.lit(" "), "source", F.col("text"))).alias("actor_list"))
    out = views.element_views(c, database=True, most=2, flat=True)
    return out.select("doc_id", "domain", "event_cause", "ai_system", "ai_system_valid", "harm_type", "harm_type_valid", F.array_join("actor_list", "|").alias("actors"))


def q_inference(spark, d):
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    named = {f: x for f, x in zip(readers.INFERENCE_FIELDS, ("lang", "source", "quality", "toxic", "text") * 3)}
    out = readers.inference_cases(c.withColumn("systems", F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("lang", "source"))).when(F.col("doc_id") % 3 == 1, F.lit("[]")).otherwise(F.col("source"))), "doc_id", "systems", named)
    return out.select("id", "ai_system_type", "actor_main_type", "domain", "event_type", "event_cause", "event_process", "risk_stage")


def q_linkage_check(spark, d):
    e = cut(_edges(spark, d))
    return linkage.clique_violations(graph.components(_nodes(spark, d), graph.threshold_edges(e, THETA)).withColumnRenamed("component", "cluster"), e, THETA)


def q_sizes(spark, d):
    """Sizes of the components, the ten greatest among them."""
    clusters = graph.components(_nodes(spark, d), graph.threshold_edges(_edges(spark, d), THETA)).withColumnRenamed("component", "cluster")
    return linkage.size_statistics(clusters).withColumn("top_sizes", F.array_join(F.col("top_sizes").cast("array<string>"), ","))


def q_numbers(spark, d):
    return linkage.cluster_numbers(table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("cluster"))).select("cluster", "cluster_id", "size")


def q_scored_deep(spark, d):
    out = models.predict(_deep_pairs(spark, d), {"wide_w": WEIGHTS, "wide_b": np.asarray(-0.5), **DEEP}, ["eq_kind", "sim_head", "sim_tail"], vectors=("q_report", "c_report"))
    return _r(out, "probability").drop("prediction")


def _deep_pairs(spark, d):
    return q_wide(spark, d, ("report",))


def _splits(spark, d):
    """Five folds of the labels as incidents."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("incident")).distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    place = F.pmod(F.col("incident") - F.col("fold"), F.lit(5))
    return e.select("fold", F.when(place == 0, "test").when(place == 1, "dev").otherwise("train").alias("split"), "incident")


def q_fold_pairs(spark, d):
    cases = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("incident"))
    out = pairs.prepare_folds(_merged(spark, d), cases, _splits(spark, d), empty=0)
    return _r(out.select("fold", "split", "query_id", "candidate_id", "label", "score_fuse_norm"), "score_fuse_norm")


def q_balance(spark, d):
    return _r(models.pos_weight(_pairs(spark, d)), "weight")


def q_silent(spark, d):
    """Ranking over all queries, of which those of one label find nothing."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    found = _merged(spark, d).join(e.where("label <> 3").select(F.col("id").alias("query_id")), "query_id", "left_semi")
    own = e.select("id", F.col("label").alias("incident"))
    return _r(recall.ranking_metrics(found, None, KS, e.select(F.col("id").alias("query_id")), own), "recall", "hit", "mrr")


def q_valid(spark, d):
    """Queries with a valid vector on both routes, a slice of them in order."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    return validation.valid_queries(e.select("id", (F.col("label") != 1).alias("valid")), e.select("id", (F.col("label") != 2).alias("valid")), 10, 200)


def q_members(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_custkey").alias("incident"), F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    own = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("incident"))
    return validation.gold_clusters(cases.union(cases), own, "o_orderkey").select("incident", F.array_join("members", ",").alias("members"))


def q_filtered(spark, d):
    """Nested candidates as stored, of which both ids must be cases with a vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    entry = F.struct("rank", "candidate_id", (F.col("score_fuse") * 1.5).alias("score_fuse"), "score_text", "score_event")
    nested = _merged(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    out = validation.filter_pairs(nested, e.where("label < 8"), e.where("label > 0"), 15)
    return _r(out.withColumn("place", F.col("place").cast("long")), "score_fuse_norm", "score_text_norm", "score_event_norm")


def q_near_recall(spark, d):
    """How many of the exact neighbours the approximate search finds."""
    v = _routes(spark, d)[0]
    on = ["query_id", "candidate_id"]
    exact = recall.knn(v, v, K).select(*on)
    found = recall.knn_approximate(v, v, K).select(*on, F.lit(1).alias("hit"))
    out = exact.join(found, on, "left").agg(F.count("*").alias("n_exact"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return out.select("n_exact", (F.col("share") >= 0.9).alias("reached"))


def q_numeric(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return ordering.numbered(rows, ordering.numeric_string("id"), "place").select("id", "place")


def q_sizes_of_gold(spark, d):
    return validation.size_summary(table(spark, d, "orders").select(F.col("o_custkey").alias("event_id")), "event_id")


def q_manifests(spark, d):
    """Two states of a list of files: orders at two times, the file being the key and its checksum that of the row."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderstatus", "o_orderkey", "o_orderdate")
    old = o.where("o_orderkey % 7 <> 0").select("path", F.sha2("o_orderstatus", 256).alias("sha256"))
    new = o.where("o_orderkey % 5 <> 0").select("path", F.sha2(F.when(F.col("o_orderkey") % 11 == 0, F.lit("x")).otherwise(F.col("o_orderstatus")), 256).alias("sha256"))
    return writers.manifest_difference(old, new)


def q_components(spark, d):
    return graph.components(_nodes(spark, d), graph.threshold_edges(_edges(spark, d), THETA))


def q_ranking(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    m = cut(_merged(spark, d))
    same = m.join(e.select(F.col("id").alias("query_id"), F.col("label").alias("lq")), "query_id").join(e.select(F.col("id").alias("candidate_id"), "label"), "candidate_id").where("lq = label")
    return _r(recall.ranking_metrics(m, same.select("query_id", "candidate_id"), KS), "recall", "hit", "mrr")


def q_summary(spark, d):
    return _r(metrics.partition_summary(_table(spark, d)), "singleton_ratio", "max_cluster_frac")


def q_hungarian(spark, d):
    return _r(metrics.hungarian(_table(spark, d)).select("g2p", "p2g", "symmetric"), "g2p", "p2g", "symmetric")


def q_classify(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("probability"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return _r(metrics.pair_classification(p), "accuracy", "precision_pos", "recall_pos", "f1_pos", "macro_f1")


def q_folds(spark, d):
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    return _r(metrics.fold_summary(rows, ["price", "orders"]), "mean", "std")


def q_first_wins(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus")
    return incremental.add_first_wins(o.where("o_orderstatus = 'P'").select("id"), o.where("o_orderstatus <> 'P'").select("id", "o_orderkey"))


def q_last_wins(spark, d):
    return incremental.upsert_last_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def q_dedupe(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("candidate_id"), (F.col("l_tax") + F.col("l_discount")).alias("probability"))
    return _r(graph.directed_scores(rows), "score")


def q_vocab(spark, d):
    return pairs.vocabulary(_cases(spark, d), ["lang", "source", "quality", "toxic"])


def q_sample(spark, d):
    return _r(pairs.sample_training(_pairs(spark, d)).select("query_id", "candidate_id", "label", "score_fuse"), "score_fuse")


def q_pairs(spark, d):
    return _r(_pairs(spark, d).select("query_id", "candidate_id", "label", "score_fuse", "score_text_norm", "score_event_norm", "score_fuse_norm"), "score_fuse", "score_text_norm", "score_event_norm", "score_fuse_norm")


def q_domain(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    b = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return validation.domain_difference(a, b, "id")


def q_duplicates(spark, d):
    return validation.duplicate_ids(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id")), "id")


def q_canonical(spark, d):
    return validation.canonical_partition(table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("cluster_id")))


def q_splits(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("incident_id"))
    s = c.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("not (incident_id % 100 = 7 and fold = 2)")
    s = s.withColumn("split", F.expr("case when incident_id % 5 = fold then 'test' when incident_id % 5 = (fold + 1) % 5 then 'dev' else 'train' end"))
    return validation.split_violations(s)


def q_subset(spark, d):
    keep = table(spark, d, "embeddings").where("label < 3").select(F.col("vec_id").cast("string").alias("id"))
    m = _merged(spark, d).where("rank <= 10")
    out = m.join(keep.select(F.col("id").alias("query_id")), "query_id", "left_semi").join(keep.select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi")
    return out.select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"))


def q_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.coalesce(*[F.get_json_object("props", f"$.{k}") for k in ("query_id", "k", "page", "id")]).alias("first"))


def q_theta(spark, d):
    scores = cut(_merged(spark, d)).select("query_id", "candidate_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score_fuse"))).alias("probability"))
    return _r(workflows.theta_table(_gold(spark, d), scores, S.theta_grid()), "hungarian_f1_g2p", "hungarian_f1_symmetric", "pair_f1", "b_cubed_f1")


def q_setops(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("k"))
    tag = lambda df, x: df.select("k", F.lit(x).alias("op"))
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.exceptAll(b).distinct(), "except all"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    score = lambda df: _r(df.select("query_id", "candidate_id", "score", F.col("rank").cast("long").alias("rank")), "score")
    fused = lambda m: lambda s, d: _r(_merged(s, d, m).select("query_id", "candidate_id", "score_fuse", "in_text", "in_event"), "score_fuse")
    edges = lambda rule: lambda s, d: _r(_edges(s, d, rule), "w")
    return {
        "flagship_bcubed": lambda s, d: _r(flagship(s, d), "precision", "recall", "f1"),
        "knn_text": lambda s, d: score(_knn(s, d)),
        "knn_event": lambda s, d: score(_knn(s, d, True)),
        "knn_approximate": lambda s, d: recall.knn_approximate(_routes(s, d)[0], _routes(s, d)[0], K),
        **{f"recall_fused_{m}": fused(m) for m in ("max", "mean", "wavg", "maxmin")},
        "ranking_metrics": q_ranking,
        "directed_dedupe": q_dedupe,
        "edges_mutual": edges("mutual"),
        "edges_either": edges("either"),
        "components": q_components,
        "complete_linkage": _clusters,
        "clique_violations": q_linkage_check,
        "theta_scan": q_theta,
        "contingency": _table,
        "pairwise_metrics": lambda s, d: _r(metrics.pairwise(_table(s, d)).withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn")}), "precision", "recall", "f1"),
        "b_cubed": lambda s, d: _r(metrics.b_cubed(_table(s, d)), "precision", "recall", "f1"),
        "adjusted_rand": lambda s, d: _r(metrics.adjusted_rand(_table(s, d)), "ari"),
        "mutual_information": lambda s, d: _r(metrics.mutual_information(_table(s, d)), "nmi"),
        "hungarian": q_hungarian,
        "partition_summary": q_summary,
        "pair_classification": q_classify,
        "fold_summary": q_folds,
        "pair_table": q_pairs,
        "hard_negatives": q_sample,
        "wide_features": lambda s, d: _r(q_wide(s, d), "sim_head", "sim_tail"),
        "pair_scores": q_scored,
        "category_vocabulary": q_vocab,
        "category_tokens": lambda s, d: _cases(s, d).drop("text"),
        "case_views": q_views,
        "gold_partition": lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"), F.concat_ws(",", F.array_sort(F.collect_list("o_orderkey")).cast("array<string>")).alias("members")),
        "domain_difference": q_domain,
        "duplicate_ids": q_duplicates,
        "canonical_partition": q_canonical,
        "split_violations": q_splits,
        "fold_subset": q_subset,
        "set_operations": q_setops,
        "json_alias_scan": q_json,
        "incremental_first_wins": q_first_wins,
        "upsert_last_wins": q_last_wins,
        "knn_approximate_recall": q_near_recall,
        "ranking_all_queries": q_silent,
        "component_sizes": q_sizes,
        "cluster_numbers": q_numbers,
        "pair_scores_deep": q_scored_deep,
        "fold_pairs": q_fold_pairs,
        "pair_balance": q_balance,
        "valid_queries": q_valid,
        "gold_members": q_members,
        "filtered_pairs": q_filtered,
        "database_views": q_database_views,
        "element_views": q_elements,
        "inference_tokens": q_inference,
        "numeric_order": q_numeric,
        "gold_sizes": q_sizes_of_gold,
        "manifest_difference": q_manifests,
    }


# SQL ------------------------------------------------------------------------------------------------------------------

_V = f"v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding[1:{HALF}] AS DOUBLE[]) AS t, CAST(embedding[{HALF + 1}:] AS DOUBLE[]) AS e, label FROM embeddings)"


def _sql_knn(col: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, candidate_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM (SELECT a.id AS query_id, b.id AS candidate_id, round(list_cosine_similarity(a.{col}, b.{col}), 12) AS score FROM v a, v b)) WHERE rank <= {K})"


def _sql_merged(mode: str = "max") -> str:
    a, b = "x.score", "y.score"
    fuse = {"max": f"greatest({a}, {b})", "mean": f"({a} + {b}) / 2", "wavg": f"{a} * 0.5 + {b} * 0.5", "maxmin": f"greatest({a}, {b}) + 0.2 * least({a}, {b})"}[mode]
    fuse = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {fuse} ELSE coalesce({a}, {b}) END"
    inner = f"SELECT query_id, candidate_id, x.score AS st, y.score AS se, x.rank AS rt, y.rank AS re, {fuse} AS f FROM kt x FULL JOIN ke y USING (query_id, candidate_id) WHERE query_id <> candidate_id"
    return f"{_V}, {_sql_knn('t', 'kt')}, {_sql_knn('e', 'ke')}, mg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, rt ASC NULLS LAST, re ASC NULLS LAST, candidate_id) AS rank FROM ({inner}))"


_EDGES = _sql_merged() + ", ds AS (SELECT query_id AS src, candidate_id AS dst, greatest(0, least(1, f)) AS s FROM mg), ug AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(s) AS lo, max(s) AS hi, count(*) AS n FROM ds GROUP BY 1, 2)"
_PAIRS = _sql_merged() + """, pr AS (SELECT m.*, CAST(q.label = c.label AS INT) AS label, min(coalesce(st, 0)) OVER w AS t0, max(coalesce(st, 0)) OVER w AS t1, min(coalesce(se, 0)) OVER w AS e0, max(coalesce(se, 0)) OVER w AS e1, min(f) OVER w AS f0, max(f) OVER w AS f1, q.label AS ql, c.label AS cl
 FROM mg m JOIN v q ON q.id = query_id JOIN v c ON c.id = candidate_id WHERE rank <= 200 WINDOW w AS (PARTITION BY query_id)), ok AS (SELECT * FROM pr WHERE ql < 6 AND cl < 6)"""
_WIDE = _sql_merged() + ", wf AS (SELECT query_id, candidate_id, CAST(q.label = c.label AS DOUBLE) AS eq_kind, list_cosine_similarity(q.t, c.t) AS sim_head, list_cosine_similarity(q.e, c.e) AS sim_tail FROM mg JOIN v q ON q.id = query_id JOIN v c ON c.id = candidate_id)"
_T = "t AS (SELECT o_custkey AS gold, o_custkey // 3 * 10 + CAST(left(o_orderpriority, 1) AS INT) AS pred, count(*) AS n FROM orders GROUP BY 1, 2), a AS (SELECT gold, sum(n) AS a FROM t GROUP BY 1), b AS (SELECT pred, sum(n) AS b FROM t GROUP BY 1), tp AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS tp FROM t), ga AS (SELECT CAST(sum(a * (a - 1) // 2) AS BIGINT) AS ga FROM a), pb AS (SELECT CAST(sum(b * (b - 1) // 2) AS BIGINT) AS pb FROM b)"
_CAT = "coalesce(nullif(trim({0}), ''), '__MISSING__')"
_CASES = "c AS (SELECT doc_id, " + ", ".join(_CAT.format(f"CAST({x} AS VARCHAR)") + f" AS {x}" for x in ("lang", "source", "quality", "toxic")) + " FROM documents LEFT JOIN labels USING (doc_id))"


def _sql_hungarian() -> str:
    """Predicted clusters belong to one block of three customers: in each block all ways to give its customers different clusters, or none."""
    return f"""WITH {_T}, s AS (SELECT gold // 3 AS blk, gold % 3 AS i, pred, 2.0 * n / (a + b) AS f FROM t JOIN a USING (gold) JOIN b USING (pred)),
o AS (SELECT blk, i, pred, f FROM s UNION ALL SELECT DISTINCT blk, k, -1 - k, 0.0 FROM s, (SELECT unnest([0, 1, 2]) AS k)),
m AS (SELECT x.blk, max(x.f + y.f + z.f) AS f FROM o x JOIN o y ON y.blk = x.blk AND y.i = 1 AND y.pred <> x.pred JOIN o z ON z.blk = x.blk AND z.i = 2 AND z.pred <> x.pred AND z.pred <> y.pred WHERE x.i = 0 GROUP BY 1),
r AS (SELECT (SELECT sum(f) FROM m) / (SELECT count(*) FROM a) AS g, (SELECT sum(f) FROM m) / (SELECT count(*) FROM b) AS p)
SELECT round(g, 6) AS g2p, round(p, 6) AS p2g, round((g + p) / 2, 6) AS symmetric FROM r"""


_REACH = f"{_EDGES}, kept AS (SELECT u, v FROM ug WHERE n = 2 AND lo > 0 AND 1 - lo <= 1 - {THETA} + 1e-12), sym AS (SELECT u AS a, v AS b FROM kept UNION ALL SELECT v, u FROM kept), reach(a, b) AS (SELECT id, id FROM v UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)"


#: Complete linkage step by step: the nearest pair of all (its lower, then its higher number first) becomes the next number,
#: with the greater distance to whatever both parts are near to.
_LINKAGE = f"""{_REACH}, num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v), total AS (SELECT count(*) AS n FROM num),
r(step, kind, a, b, d) AS (
  SELECT CAST(0 AS BIGINT), 0, least(x.k, y.k), greatest(x.k, y.k), 1 - lo FROM ug JOIN num x ON x.id = u JOIN num y ON y.id = v WHERE n = 2 AND lo > 0 AND 1 - lo <= 1 - {THETA} + 1e-12
  UNION ALL
  (WITH m AS (SELECT step, a, b, d FROM r WHERE kind = 0 ORDER BY d, a, b LIMIT 1),
   near AS (SELECT CASE WHEN r.a = m.a OR r.a = m.b THEN r.b ELSE r.a END AS x, r.d FROM r, m WHERE kind = 0 AND (r.a = m.a OR r.a = m.b) <> (r.b = m.a OR r.b = m.b))
   SELECT m.step + 1, 0, r.a, r.b, r.d FROM r, m WHERE kind = 0 AND r.a <> m.a AND r.a <> m.b AND r.b <> m.a AND r.b <> m.b
   UNION ALL SELECT m.step + 1, 0, near.x, total.n + m.step, near.d FROM (SELECT x, max(d) AS d FROM near GROUP BY x HAVING count(*) = 2) near, m, total
   UNION ALL SELECT m.step + 1, 1, m.a, m.b, m.d FROM m)),
up AS (SELECT a AS child, n + step - 1 AS parent FROM r, total WHERE kind = 1 UNION ALL SELECT b, n + step - 1 FROM r, total WHERE kind = 1),
anc(id, here) AS (SELECT id, k FROM num UNION ALL SELECT id, parent FROM anc JOIN up ON child = here),
linked AS (SELECT id AS node, min(id) OVER (PARTITION BY root) AS cluster FROM (SELECT id, max(here) AS root FROM anc GROUP BY 1))"""


def _sql_view(title: str, body: str, s, most: int | None = None) -> str:
    whole = s(f"'Title: ' || left({s(title)}, 200) || chr(10) || 'Body: ' || left({s(body)}, 6000)")
    return whole if most is None else f"left({whole}, {most})"


def _sql_lines(fields: dict[str, str], s, most: int) -> str:
    """fields: label to an expression that is clipped already."""
    return f"left({s(' || chr(10) || '.join(f"'{n}: '" + (f' || {fields[n]}' if n in fields else '') for n, _ in views.EVENT_LINES))}, {most})"


def oracle_sql() -> dict[str, str]:
    f1 = "round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1"
    strip = r"regexp_replace(regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\x{{a0}}]+', ''), '[\s\x1c-\x1f\x{{85}}\x{{a0}}]+$', '')"
    s = strip.format
    knn = lambda c: f"WITH {_V}, {_sql_knn(c, 'k')} SELECT query_id, candidate_id, round(score, 6) AS score, rank FROM k"
    out = {
        "knn_text": knn("t"),
        "knn_event": knn("e"),
        "ranking_metrics": f"WITH {_sql_merged()}, g AS (SELECT m.*, q.label = c.label AS good FROM mg m JOIN v q ON q.id = query_id JOIN v c ON c.id = candidate_id), ks AS (SELECT unnest({KS}) AS k), p AS (SELECT query_id, k, count(*) FILTER (good AND rank <= k) AS h, count(*) FILTER (good) AS n, min(rank) FILTER (good) AS first FROM g, ks GROUP BY 1, 2) SELECT k, round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 6) AS recall, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(CASE WHEN first <= k THEN 1.0 / first ELSE 0.0 END), 6) AS mrr FROM p GROUP BY 1",
        "directed_dedupe": "SELECT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, round(max(l_tax + l_discount), 6) AS score FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1, 2",
        "edges_mutual": f"WITH {_EDGES} SELECT u, v, round(lo, 6) AS w FROM ug WHERE n = 2 AND lo > 0",
        "edges_either": f"WITH {_EDGES} SELECT u, v, round(hi, 6) AS w FROM ug WHERE hi > 0",
        "components": f"WITH RECURSIVE {_REACH} SELECT node, component FROM comp",
        "clique_violations": f"WITH RECURSIVE {_REACH}, p AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM comp GROUP BY component)), e AS (SELECT count(*) AS edges FROM kept) SELECT pairs, edges, pairs - edges AS violations FROM p, e",
        "complete_linkage": f"WITH RECURSIVE {_LINKAGE} SELECT node, cluster FROM linked",
        "flagship_bcubed": f"WITH RECURSIVE {_LINKAGE}, t AS (SELECT label AS g, cluster AS p, count(*) AS n FROM linked JOIN v ON id = node GROUP BY 1, 2), x AS (SELECT sum(n * n / b) / sum(n) AS p, sum(n * n / a) / sum(n) AS r FROM (SELECT n, sum(n) OVER (PARTITION BY g) AS a, sum(n) OVER (PARTITION BY p) AS b FROM t)) SELECT round(p, 6) AS precision, round(r, 6) AS recall, {f1} FROM x",
        "component_sizes": f"WITH RECURSIVE {_REACH}, z AS (SELECT count(*) AS n FROM comp GROUP BY component) SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS nodes, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) FROM (SELECT n FROM z ORDER BY n DESC LIMIT 10)) AS top_sizes FROM z",
        "cluster_numbers": "SELECT o_custkey AS cluster, row_number() OVER (ORDER BY o_custkey) - 1 AS cluster_id, count(*) AS size FROM orders GROUP BY 1",
        "knn_approximate_recall": f"WITH {_V}, {_sql_knn('t', 'k')} SELECT count(*) AS n_exact, true AS reached FROM k",
        "ranking_all_queries": f"WITH {_sql_merged()}, fnd AS (SELECT m.query_id, m.candidate_id, m.rank, q.label = c.label AS good FROM mg m JOIN v q ON q.id = query_id JOIN v c ON c.id = candidate_id WHERE q.label <> 3), ks AS (SELECT unnest({KS}) AS k), n AS (SELECT id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM v), p AS (SELECT n.query_id, k, n, count(*) FILTER (good AND rank <= k) AS h, min(rank) FILTER (good) AS first FROM n CROSS JOIN ks LEFT JOIN fnd USING (query_id) GROUP BY 1, 2, 3) SELECT k, round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 6) AS recall, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(CASE WHEN first <= k THEN 1.0 / first ELSE 0.0 END), 6) AS mrr FROM p GROUP BY 1",
        "pair_scores_deep": f"""WITH {_WIDE}, rp AS (SELECT id, CASE WHEN label <> 3 THEN t ELSE list_transform(t, lambda x: 0.0) END AS r FROM v),
x AS (SELECT wf.*, q.r AS qr, c.r AS cr FROM wf JOIN rp q ON q.id = query_id JOIN rp c ON c.id = candidate_id),
y AS (SELECT *, greatest(0, 0.5 * list_sum(list_transform(list_zip(qr, cr), lambda z: abs(z[1] - z[2]))) - 1.0) AS h1, greatest(0, 0.1 * list_sum(qr) - 0.1 * list_sum(cr) + 2.0 * list_dot_product(qr, cr) + 0.2) AS h2 FROM x)
SELECT query_id, candidate_id, round(1 / (1 + exp(-(eq_kind + 2 * sim_head - 1.5 * sim_tail - 0.5 - 0.7 * h1 + 1.1 * h2 + 0.05))), 6) AS probability FROM y""",
        "fold_pairs": f"""WITH {_PAIRS}, fd AS (SELECT DISTINCT label AS incident, fold, CASE (label - fold + 5) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM v, (SELECT unnest([0, 1, 2, 3, 4]) AS fold)),
f AS (SELECT x.fold, x.split, pr.* FROM pr JOIN fd x ON x.incident = ql JOIN fd y ON y.incident = cl AND y.fold = x.fold AND y.split = x.split),
z AS (SELECT *, sum(label) OVER (PARTITION BY fold, query_id) AS np, row_number() OVER (PARTITION BY fold, query_id, label ORDER BY f DESC, candidate_id) AS r FROM f WHERE split = 'train'),
u AS (SELECT fold, split, query_id, candidate_id, label, f, f0, f1 FROM f WHERE split <> 'train' UNION ALL SELECT fold, split, query_id, candidate_id, label, f, f0, f1 FROM z WHERE label = 1 OR r <= 4 * np)
SELECT fold, split, query_id, candidate_id, label, round(CASE WHEN f1 <= f0 THEN 0 ELSE (f - f0) / (f1 - f0) END, 6) AS score_fuse_norm FROM u""",
        "pair_balance": f"WITH {_PAIRS} SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS weight FROM ok",
        "valid_queries": "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE label NOT IN (1, 2))) WHERE place >= 10 AND place < 200",
        "gold_members": "SELECT o_custkey AS incident, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
        "filtered_pairs": f"WITH {_sql_merged()}, w AS (SELECT id FROM v WHERE label > 0 AND label < 8) SELECT query_id, candidate_id, rank - 1 AS place, round(least(1, greatest(0, 1.5 * f)), 6) AS score_fuse_norm, round(least(1, greatest(0, coalesce(st, 0))), 6) AS score_text_norm, round(least(1, greatest(0, coalesce(se, 0))), 6) AS score_event_norm FROM mg WHERE rank <= 15 AND query_id IN (SELECT id FROM w) AND candidate_id IN (SELECT id FROM w)",
        "numeric_order": "SELECT CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part",
        "gold_sizes": 'SELECT CAST(sum(n) AS BIGINT) AS "rows", count(*) AS groups, count(*) FILTER (n = 1) AS singletons, max(n) AS largest FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)',
        "manifest_difference": "SELECT 'o/' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0) OR (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) OR (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0)",
        "database_views": f"SELECT doc_id, {_sql_view('source', 'text', s, 7000)} AS text_view, " + _sql_lines({"Title": f"left({s('source')}, 200)", "Time": "left(CAST(n_chars AS VARCHAR), 10)", "EventType": f"left({s('lang')}, 100)", "Actors": f"left({s('lang')}, 100) || ', , ' || left({s('source')}, 100)", "AITech": f"CASE WHEN doc_id % 2 = 0 THEN left({s('lang')}, 100) || ', , ' || left({s('source')}, 100) ELSE left({s('source')}, 100) || ', ' || left({s('lang')}, 100) END", "AIRisk": f"left({s('lang')}, 100) || CASE WHEN {s('text')} <> '' THEN ' | ' || left({s('text')}, 200) ELSE '' END", "Cause": f"left({s('text')}, 400)"}, s, 7000) + " AS event_view FROM documents",
        "element_views": f"SELECT doc_id, left({s('lang')}, 80) AS domain, left({s('text')}, 800) AS event_cause, left({s('source')}, 150) AS ai_system, {s('source')} <> '' AS ai_system_valid, '' AS harm_type, false AS harm_type_valid, left({s('lang')}, 100) || '|' || left({s('source')}, 100) AS actors FROM documents",
        "inference_tokens": "WITH c AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '__MISSING__' ELSE source END AS ai_system_type, coalesce(lang, '__MISSING__') AS actor_main_type, coalesce(source, '__MISSING__') AS domain, coalesce(CAST(quality AS VARCHAR), '__MISSING__') AS event_type, coalesce(CAST(toxic AS VARCHAR), '__MISSING__') AS event_cause, coalesce(text, '__MISSING__') AS event_process, coalesce(text, '__MISSING__') AS risk_stage FROM c",
        "contingency": f"WITH {_T} SELECT gold, pred, n FROM t",
        "pairwise_metrics": f"WITH {_T}, x AS (SELECT tp, pb - tp AS fp, ga - tp AS fn, coalesce(tp / nullif(pb, 0), 0) AS p, coalesce(tp / nullif(ga, 0), 0) AS r FROM tp, ga, pb) SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, {f1} FROM x",
        "b_cubed": f"WITH {_T}, x AS (SELECT sum(n * n / b) / sum(n) AS p, sum(n * n / a) / sum(n) AS r FROM t JOIN a USING (gold) JOIN b USING (pred)) SELECT round(p, 6) AS precision, round(r, 6) AS recall, {f1} FROM x",
        "adjusted_rand": f"WITH {_T}, n AS (SELECT sum(n) AS n FROM t), x AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(ga AS DOUBLE) AS ga, CAST(pb AS DOUBLE) AS pb, n * (n - 1) / 2.0 AS c FROM tp, ga, pb, n) SELECT round((tp - ga * pb / c) / ((ga + pb) / 2 - ga * pb / c), 6) AS ari FROM x",
        "mutual_information": f"WITH {_T}, n AS (SELECT CAST(sum(n) AS DOUBLE) AS s FROM t), m AS (SELECT sum(n / s * ln(n * s / (a * b))) AS mi FROM t JOIN a USING (gold) JOIN b USING (pred), n), ha AS (SELECT -sum(a / s * ln(a / s)) AS ha FROM a, n), hb AS (SELECT -sum(b / s * ln(b / s)) AS hb FROM b, n) SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM m, ha, hb",
        "hungarian": _sql_hungarian(),
        "partition_summary": f"WITH {_T} SELECT CAST(sum(b) AS BIGINT) AS n_reports, (SELECT count(*) FROM a) AS n_gold, count(*) AS n_pred, count(*) FILTER (b = 1) AS singletons, round(count(*) FILTER (b = 1) / count(*), 6) AS singleton_ratio, round(max(b) / sum(b), 6) AS max_cluster_frac, CAST(1.0 AS DOUBLE) AS coverage FROM b",
        "pair_classification": "WITH x AS (SELECT l_discount * 10 >= 0.5 AS h, l_returnflag = 'R' AS y FROM lineitem), c AS (SELECT count(*) FILTER (h AND y) AS tp, count(*) FILTER (h AND NOT y) AS fp, count(*) FILTER (NOT h AND y) AS fn, count(*) FILTER (NOT h AND NOT y) AS tn FROM x) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_pos, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_pos, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_pos, round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 6) AS macro_f1 FROM c",
        "fold_summary": "WITH x AS (SELECT o_orderpriority, avg(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1), l AS (SELECT 'price' AS metric, price AS v FROM x UNION ALL SELECT 'orders', orders FROM x) SELECT metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, count(*) AS n FROM l GROUP BY 1",
        "pair_table": f"WITH {_PAIRS} SELECT query_id, candidate_id, label, round(f, 6) AS score_fuse, round(CASE WHEN t1 <= t0 THEN 0 ELSE (coalesce(st, 0) - t0) / (t1 - t0) END, 6) AS score_text_norm, round(CASE WHEN e1 <= e0 THEN 0 ELSE (coalesce(se, 0) - e0) / (e1 - e0) END, 6) AS score_event_norm, round(CASE WHEN f1 <= f0 THEN 0 ELSE (f - f0) / (f1 - f0) END, 6) AS score_fuse_norm FROM ok",
        "hard_negatives": f"WITH {_PAIRS}, z AS (SELECT *, sum(label) OVER (PARTITION BY query_id) AS np, row_number() OVER (PARTITION BY query_id, label ORDER BY f DESC, candidate_id) AS r FROM ok) SELECT query_id, candidate_id, label, round(f, 6) AS score_fuse FROM z WHERE label = 1 OR r <= CASE WHEN np > 0 THEN 4 * np ELSE 10 END",
        "wide_features": f"WITH {_WIDE} SELECT query_id, candidate_id, eq_kind, round(sim_head, 6) AS sim_head, round(sim_tail, 6) AS sim_tail FROM wf",
        "pair_scores": f"WITH {_WIDE} SELECT query_id, candidate_id, round(1 / (1 + exp(-(eq_kind + 2 * sim_head - 1.5 * sim_tail - 0.5))), 6) AS probability FROM wf",
        "category_vocabulary": f"WITH {_CASES}, l AS (SELECT DISTINCT 'lang' AS field, lang AS token FROM c UNION SELECT 'source', source FROM c UNION SELECT 'quality', quality FROM c UNION SELECT 'toxic', toxic FROM c UNION SELECT unnest(['lang', 'source', 'quality', 'toxic']), '__MISSING__') SELECT field, token, CAST(row_number() OVER (PARTITION BY field ORDER BY token) - 1 AS INT) AS code FROM l",
        "category_tokens": f"WITH {_CASES} SELECT * FROM c",
        "case_views": f"SELECT doc_id, left({s('text')}, 100) AS clipped, {_sql_view('source', 'text', s)} AS text_view, " + _sql_lines({k: f"left({s(v)}, {n})" for (k, n), v in {("Title", 200): "source", ("Time", 10): "CAST(n_chars AS VARCHAR)", ("EventType", 100): "lang", ("Subject", 200): "lang", ("AIRisk", 200): "source", ("Cause", 400): "text", ("Process", 400): "text", ("Result", 200): "text"}.items()}, s, 6000) + f" AS event_view, {s('text')} AS whole FROM documents",
        "gold_partition": "SELECT o_custkey, count(*) AS size, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1",
        "domain_difference": "WITH a AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer), b AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part) SELECT id, 'left' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'right' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)",
        "duplicate_ids": "SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
        "canonical_partition": "SELECT o_orderkey AS report_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster_id FROM orders",
        "split_violations": "SELECT c_custkey AS incident_id, 'missing from a fold' AS why FROM customer WHERE c_custkey % 100 = 7 UNION ALL SELECT c_custkey, 'not tested once' FROM customer WHERE c_custkey % 100 = 7 AND c_custkey % 5 = 2",
        "fold_subset": f"WITH {_sql_merged()} SELECT query_id, candidate_id, rank FROM mg WHERE rank <= 10 AND query_id IN (SELECT id FROM v WHERE label < 3) AND candidate_id IN (SELECT id FROM v WHERE label < 3)",
        "set_operations": "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT CAST(k AS INT) AS k, 'union' AS op FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT CAST(k AS INT), 'intersect' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT CAST(k AS INT), 'except all' FROM (SELECT DISTINCT k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b))",
        "json_alias_scan": "SELECT event_id, coalesce(json_extract_string(props, '$.query_id'), json_extract_string(props, '$.k'), json_extract_string(props, '$.page'), json_extract_string(props, '$.id')) AS first FROM events",
        "incremental_first_wins": "SELECT o_custkey AS id, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
        "upsert_last_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    }
    for m in ("max", "mean", "wavg", "maxmin"):
        out[f"recall_fused_{m}"] = f"WITH {_sql_merged(m)} SELECT query_id, candidate_id, round(f, 6) AS score_fuse, rt IS NOT NULL AS in_text, re IS NOT NULL AS in_event FROM mg"
    return out
