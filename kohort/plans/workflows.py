"""Threshold selection, locking and evaluation."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions.scalars import theta_grid
from kohort.operators import metrics
from kohort.operators.graph import directed_scores, undirected_edges
from kohort.operators.linkage import cluster_events, linkage_at
from kohort.operators.validation import ContractError
from kohort.session import cut
from kohort.sources.writers import sha256_of


def theta_table(gold: DataFrame, scores: DataFrame, thetas: list[float], rule: str = "mutual") -> DataFrame:
    """``theta, n_pred, hungarian_f1_g2p, hungarian_f1_symmetric, pair_f1, b_cubed_f1`` for all thresholds in one job: theta is a grouping column.

    gold: report_id, gold.
    """
    nodes = gold.select(F.col("report_id").alias("node"))
    pred = linkage_at(nodes, undirected_edges(directed_scores(scores), rule), thetas)
    t = cut(gold.join(pred.withColumnRenamed("node", "report_id"), "report_id").groupBy("theta", "gold", "cluster").agg(F.count("*").alias("n")))
    a = t.groupBy("theta", "gold").agg(F.sum("n").alias("a"))
    b = t.groupBy("theta", "cluster").agg(F.sum("n").alias("b"))
    full = t.join(a, ["theta", "gold"]).join(b, ["theta", "cluster"])
    c2 = metrics.choose2
    sums = full.groupBy("theta").agg(F.sum(c2("n")).alias("tp"), F.sum(F.col("n") * F.col("n") / F.col("b")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("a")).alias("r"), F.sum("n").alias("total"))
    sums = sums.join(a.groupBy("theta").agg(F.sum(c2("a")).alias("ga")), "theta").join(b.groupBy("theta").agg(F.sum(c2("b")).alias("pb"), F.count("*").alias("n_pred")), "theta")
    f1 = lambda p, r: F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))
    pair_p, pair_r = (F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col(c).cast("double")), F.lit(0.0)) for c in ("pb", "ga"))
    matched = metrics.hungarian(t.withColumnRenamed("cluster", "pred"), by="theta").select("theta", F.col("g2p").alias("hungarian_f1_g2p"), F.col("symmetric").alias("hungarian_f1_symmetric"))
    return sums.join(matched, "theta").select("theta", "n_pred", "hungarian_f1_g2p", "hungarian_f1_symmetric", f1(pair_p, pair_r).alias("pair_f1"), f1(F.col("p") / F.col("total"), F.col("r") / F.col("total")).alias("b_cubed_f1"))


def best_threshold(table: DataFrame) -> DataFrame:
    """The row of a theta_table with the greatest matching F1 (gold side), symmetric F1, B-cubed F1, then threshold."""
    return table.orderBy(F.desc("hungarian_f1_g2p"), F.desc("hungarian_f1_symmetric"), F.desc("b_cubed_f1"), F.desc("theta")).limit(1)


def midpoint_threshold(table: DataFrame, score: str = "hungarian_f1_g2p", within: float = 1e-12) -> DataFrame:
    """The middle (of an even number the upper) of all thresholds whose score is the greatest, but for a rounding error."""
    most = table.agg(F.max(score).alias("most"))
    tied = table.crossJoin(F.broadcast(most)).where(F.col("most") - F.col(score) <= within)
    return tied.agg(F.sort_array(F.collect_list("theta")).alias("t")).select(F.element_at("t", F.expr("cast(size(t) div 2 + 1 as int)")).alias("theta"))


def select_dev(gold: DataFrame, scores: DataFrame, low: float = 0.10, high: float = 0.95, step: float = 0.01, rule: str = "mutual") -> dict:
    """The best threshold of a grid, all thresholds in one plan; equal scores are told apart as by best_threshold."""
    found = cut(theta_table(gold, scores, theta_grid(low, high, step), rule).drop("pair_f1").withColumnRenamed("n_pred", "num_pred_clusters"))
    rows = [r.asDict() for r in found.orderBy("theta").collect()]  # as many as the grid has
    return {"selected_theta": best_threshold(found).first().theta, "source": "dev_only", "table": rows}


def lock_thresholds(selections: dict[int, dict]) -> dict:
    if bad := [k for k, s in selections.items() if s.get("source") != "dev_only"]:
        raise ContractError(f"folds {bad} were not selected on dev")
    return {"source": "dev_only", "locked_thetas": {str(k): s["selected_theta"] for k, s in sorted(selections.items())}}


def evaluate_locked(gold: DataFrame, scores: DataFrame, theta: float, rule: str = "mutual", backend: str = "sparse") -> DataFrame:
    """All metrics of one fold at a locked threshold, in one row."""
    clusters = cluster_events(gold.select(F.col("report_id").alias("node")), scores, theta, rule, backend=backend)
    return metrics.evaluate_partition(gold, clusters.select(F.col("node").alias("report_id"), F.col("cluster").alias("pred")))


def evaluate_folds(gold: dict[int, DataFrame], scores: dict[int, DataFrame], lock: dict, rule: str = "mutual", backend: str = "sparse") -> tuple[DataFrame, DataFrame]:
    """A row for each fold, and mean and deviation of its metrics."""
    thetas = {int(k): v for k, v in lock["locked_thetas"].items()}
    if lock.get("source") != "dev_only" or not set(gold) == set(scores) == set(thetas):
        raise ContractError("folds of gold, scores and thresholds must agree")
    rows = None
    for fold in sorted(gold):
        one = evaluate_locked(gold[fold], scores[fold], thetas[fold], rule, backend).withColumn("fold", F.lit(fold))
        rows = one if rows is None else rows.unionByName(one)
    rows = cut(rows)
    return rows, metrics.fold_summary(rows, [c for c in rows.columns if c != "fold"])


def training_handoff(script: str, splits: str, interpreter: str = "python", args: list[str] | tuple[str, ...] = ()) -> dict:
    """What to run for a training, with the script's checksum; nothing is run here.

    Arguments that name test or Chinese gold data (``--test...``, ``--chinese...``) have no place in a training and raise.
    """
    if not os.path.isfile(script) or not os.path.isdir(splits):
        raise ContractError("a training needs a script and a folder of splits")
    if refused := [x for x in args if x.startswith(("--test", "--chinese"))]:
        raise ContractError(f"not for training: {refused}")
    script, splits = os.path.realpath(script), os.path.realpath(splits)
    return {"status": "requires_explicit_execution", "adapter": "legacy_five_fold", "script": script, "script_sha256": sha256_of(script), "split_root": splits, "argv": [interpreter, script, *args]}
