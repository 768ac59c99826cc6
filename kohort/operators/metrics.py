"""Partition metrics from the contingency table; no pair of reports is ever listed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions.scalars import choose2
from kohort.operators.components import connected_components
from kohort.operators.validation import ContractError, domain_difference, require
from kohort.session import cut, ship, shuffle_partitions

CELLS = 1 << 20  # of a table of scores that one task solves without looking for components


def contingency(gold: DataFrame, pred: DataFrame, report: str = "report_id", strict: bool = True) -> DataFrame:
    """``gold, pred, n``. gold: report, gold; pred: report, pred. Strict: equal, not empty domains."""
    if strict:
        require(domain_difference(gold, pred, report), "reports of one side only")
        if gold.isEmpty():
            raise ContractError("no reports")
    return gold.join(pred, report).groupBy("gold", "pred").agg(F.count("*").alias("n"))


def sizes(table: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    return table.groupBy(*by, "gold").agg(F.sum("n").alias("a")), table.groupBy(*by, "pred").agg(F.sum("n").alias("b"))


def _ratio(x, y):
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


def _f1(p: str, r: str):
    return _ratio(2.0 * F.col(p) * F.col(r), F.col(p) + F.col(r))


def pairwise(table: DataFrame) -> DataFrame:
    """One row: ``tp, fp, fn, precision, recall, f1`` of induced pairs, counted as decimal(38,0); 0.0 for an empty denominator."""
    a, b = sizes(table)
    out = table.agg(F.sum(choose2("n")).alias("tp")).crossJoin(a.agg(F.sum(choose2("a")).alias("ga"))).crossJoin(b.agg(F.sum(choose2("b")).alias("pb")))
    out = out.select("tp", (F.col("pb") - F.col("tp")).alias("fp"), (F.col("ga") - F.col("tp")).alias("fn"))
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", _f1("precision", "recall"))


def b_cubed(table: DataFrame) -> DataFrame:
    a, b = sizes(table)
    full = table.join(a, "gold").join(b, "pred")
    out = full.agg(F.sum(F.col("n") * F.col("n") / F.col("b")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("a")).alias("r"), F.sum("n").alias("total"))
    return out.select((F.col("p") / F.col("total")).alias("precision"), (F.col("r") / F.col("total")).alias("recall")).withColumn("f1", _f1("precision", "recall"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row ``ari``; 1.0 where neither side has a pair the other lacks."""
    out = pairwise(table).select("tp", "fp", "fn").crossJoin(table.agg(F.sum("n").alias("total")))
    tp, ga, pb = F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    expected = ga * pb / choose2("total")
    value = F.try_divide(tp - expected, (ga + pb) / 2.0 - expected)
    return out.select(F.when((F.col("fp") == 0) & (F.col("fn") == 0), F.lit(1.0)).otherwise(F.coalesce(value, F.lit(0.0))).alias("ari"))


def mutual_information(table: DataFrame) -> DataFrame:
    """One row ``nmi``: mutual information over the mean of the entropies; 1.0 for one cluster on both sides."""
    a, b = sizes(table)
    total = table.agg(F.sum("n").cast("double").alias("t"))
    h = lambda df, c: df.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col(c) / F.col("t")) * F.log(F.col(c) / F.col("t"))).alias(f"h{c}"), F.count("*").alias(f"k{c}"))
    full = table.join(a, "gold").join(b, "pred").crossJoin(F.broadcast(total))
    mi = full.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    out = mi.crossJoin(h(a, "a")).crossJoin(h(b, "b"))
    one = (F.col("ka") == 1) & (F.col("kb") == 1)
    return out.select(F.when(one, F.lit(1.0)).when(F.abs("mi") < 1e-15, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2.0), F.lit(0.0))).alias("nmi"))


def assign(score: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of greatest sum (rows <= columns): shortest augmenting paths with potentials."""
    cost = -score
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better] = reduced[better]
            way[1:][better] = j
            free = np.where(used[1:], np.inf, low[1:])
            nxt = int(free.argmin()) + 1
            delta = free[nxt - 1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def hungarian(table: DataFrame, by: str | None = None, cells: int = CELLS) -> DataFrame:
    """One row: ``g2p, p2g, symmetric, matched, unmatched_gold, unmatched_pred`` of the best one-to-one matching by F1.

    Clusters without a common report can't match, so the overlap graph is cut into components and each solved in one task,
    unless all clusters of both sides make a table of at most ``cells``, which is solved as it is.
    by: a column that parts table into tables of their own; then its values stand first, with a row for each.
    """
    ship(table.sparkSession)
    keys = [by] if by else []
    a, b = sizes(table, *keys)
    ng, np_ = a.groupBy(*keys).agg(F.count("*").alias("ng")), b.groupBy(*keys).agg(F.count("*").alias("np"))
    counts = cut(ng.join(np_, keys) if keys else ng.crossJoin(np_))  # a row for each value of by
    full = table.join(a, [*keys, "gold"]).join(b, [*keys, "pred"]).select(*keys, "gold", "pred", (2.0 * F.col("n") / (F.col("a") + F.col("b"))).alias("f"))
    if (counts.agg(F.max(F.col("ng") * F.col("np"))).first()[0] or 0) <= cells:
        parted = full.withColumn("component", F.xxhash64(*keys) if keys else F.lit(0))
    else:
        # Nodes are hashes: if two fall together, so do their components, which are then solved as one.
        node = lambda c: F.xxhash64(F.lit(c), *keys, c)
        full = full.withColumns({"_g": node("gold"), "_p": node("pred")})
        parts = connected_components(full, "_g", "_p").select(F.col("node").alias("_g"), "component")
        parted = full.join(parts, "_g").drop("_g", "_p")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for _, one in pdf.groupby(["component", *keys], sort=False):
            rows, cols = pd.factorize(one["gold"])[0], pd.factorize(one["pred"])[0]
            grid = np.zeros((rows.max() + 1, cols.max() + 1))
            grid[rows, cols] = one["f"].to_numpy()
            grid = grid if grid.shape[0] <= grid.shape[1] else grid.T
            found = grid[np.arange(len(grid)), assign(grid)]
            got.append({**{x: one[x].iloc[0] for x in keys}, "total": float(found.sum()), "matched": int((found > 0).sum())})
        return pd.DataFrame(got)

    kind = "".join(f"{x} {table.schema[x].dataType.simpleString()}, " for x in keys) + "total double, matched long"
    done = parted.withColumn("_task", F.pmod(F.xxhash64("component"), F.lit(4 * shuffle_partitions(table.sparkSession)))).groupBy("_task").applyInPandas(solve, kind).groupBy(*keys).agg(F.sum("total").alias("s"), F.sum("matched").alias("matched"))
    out = done.join(counts, keys) if keys else done.crossJoin(counts)  # one row each
    out = out.withColumn("g2p", F.col("s") / F.col("ng")).withColumn("p2g", F.col("s") / F.col("np"))
    return out.select(*keys, "g2p", "p2g", ((F.col("g2p") + F.col("p2g")) / 2).alias("symmetric"), "matched", (F.col("ng") - F.col("matched")).alias("unmatched_gold"), (F.col("np") - F.col("matched")).alias("unmatched_pred"))


def partition_summary(table: DataFrame) -> DataFrame:
    a, b = sizes(table)
    out = b.agg(F.count("*").alias("n_pred"), F.sum("b").alias("n_reports"), F.count_if(F.col("b") == 1).alias("singletons"), F.max("b").alias("largest")).crossJoin(a.agg(F.count("*").alias("n_gold")))
    return out.select("n_reports", "n_gold", "n_pred", "singletons", (F.col("singletons") / F.col("n_pred")).alias("singleton_ratio"), (F.col("largest") / F.col("n_reports")).alias("max_cluster_frac"), F.lit(1.0).alias("coverage"))


def evaluate_partition(gold: DataFrame, pred: DataFrame, report: str = "report_id") -> DataFrame:
    """All metrics in one row."""
    t = cut(contingency(gold, pred, report))
    rename = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    out = partition_summary(t)
    for piece in (rename(pairwise(t), "pair"), rename(b_cubed(t), "b_cubed"), adjusted_rand(t), mutual_information(t), rename(hungarian(t), "hungarian")):
        out = out.crossJoin(piece)  # one row each
    return out


def pair_classification(scores: DataFrame, theta: float = 0.5, prob: str = "probability", label: str = "label") -> DataFrame:
    """One row: accuracy, F1 of both classes and their mean, at a threshold."""
    hit, pos = F.col(prob) >= theta, F.col(label) == 1
    n = scores.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    f = lambda tp, fp, fn: _ratio(2.0 * F.col(tp), 2.0 * F.col(tp) + F.col(fp) + F.col(fn))
    out = n.withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).withColumn("precision_pos", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall_pos", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1_pos", f("tp", "fp", "fn")).withColumn("macro_f1", (f("tp", "fp", "fn") + f("tn", "fn", "fp")) / 2)


def fold_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, mean, std, n`` over folds; the deviation of a single fold is 0."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    return long.where("value is not null").groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
