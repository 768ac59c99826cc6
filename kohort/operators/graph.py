"""Directed scores, undirected edges, thresholds and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions.scalars import norm_id
from kohort.operators.components import connected_components, with_singletons
from kohort.operators.validation import require

EPS = 1e-12


def directed_scores(pairs: DataFrame, query: str = "query_id", candidate: str = "candidate_id", score: str = "probability", lenient: bool = False) -> DataFrame:
    """``src, dst, score``: the best of repeated pairs, without self pairs.

    Strict: a score that is null, no number or out of [0, 1] raises, and so does a null or empty id. Lenient: rows without
    two ids or a finite score go, other scores are clamped.
    """
    s = F.col(score).cast("double")
    rows = pairs.select(norm_id(query).alias("src"), norm_id(candidate).alias("dst"), s.alias("score"))
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    named = (F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")
    if lenient:
        rows = rows.where(fine & named).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    else:
        require(rows.where(~F.coalesce(fine & F.col("score").between(0, 1), F.lit(False))), "scores must be in [0, 1]")
        require(rows.where(~named), "ids must not be empty")
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.max("score").alias("score"))


def undirected_edges(directed: DataFrame, rule: str = "mutual") -> DataFrame:
    """``u < v, w``. mutual: both directions exist, the lesser counts; either: the greater of those that exist. Zero weights go.

    One shuffle by the unordered pair in place of a self join.
    """
    if rule not in ("mutual", "either"):
        raise ValueError(f"unknown edge rule {rule!r}")
    grouped = directed.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"))
    if rule == "mutual":
        return grouped.where("n = 2 and lo > 0").select("u", "v", F.col("lo").alias("w"))
    return grouped.where("hi > 0").select("u", "v", F.col("hi").alias("w"))


def threshold_edges(edges: DataFrame, theta: float) -> DataFrame:
    """Edges within the cut, in the distance form with its tolerance."""
    if not 0 < theta <= 1:
        raise ValueError("a threshold is in (0, 1]")
    return edges.where((1.0 - F.col("w")) <= (1.0 - theta) + EPS)


def prefilter_directed(directed: DataFrame, theta: float) -> DataFrame:
    """Scores that can matter at a threshold: mutual needs both directions above, either one; sound before the edges are built."""
    return directed.where((1.0 - F.col("score")) <= (1.0 - theta) + EPS)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``node, component`` for all nodes, those without edges included."""
    return with_singletons(nodes, connected_components(edges, "u", "v"), node)
