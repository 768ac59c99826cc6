"""Sinks: Spark's commit protocol for tables, a temporary name and a rename for small files."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import datetime, timezone
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.functions.scalars import norm_id
from kohort.operators.validation import ContractError, require


def _number(value: object) -> int:
    if isinstance(value, Decimal) and value == int(value):  # counts beyond 64 bits
        return int(value)
    raise TypeError(f"{type(value).__name__} has no JSON form")


def write_json_atomic(path: str, value: object) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, default=_number)
    os.replace(tmp, path)


def write_npy_atomic(path: str, values: np.ndarray) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "wb") as f:
        np.save(f, values)
    os.replace(tmp, path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, in as many files as df has partitions; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_views(cases: DataFrame, path: str, coverage: float = 0.95) -> dict:
    """Text and event views (``id, text_view, event_view``) as JSON lines, and rows without them as a failure log.

    cases: id, text_view, event_view. Returns counts; ``covered`` is false where fewer than the wanted share have both.
    """
    from kohort.session import cut

    rows = cut(cases.select("id", "text_view", "event_view"))
    good = (F.coalesce("text_view", F.lit("")) != "") & (F.coalesce("event_view", F.lit("")) != "") & (F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
    write_jsonl(rows.where(good), f"{path}/views")
    why = F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "no id").otherwise("no view")
    write_jsonl(rows.where(~good).select("id", why.alias("why")), f"{path}/failed")
    n = rows.agg(F.count("*").alias("rows"), F.count_if(good).alias("written")).first()
    return {"rows": n.rows, "written": n.written, "failed": n.rows - n.written, "covered": n.rows > 0 and n.written >= coverage * n.rows}


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Clusters (``cluster_id, size, members``) and the map of nodes to their numbers, as JSON lines."""
    from kohort.operators.linkage import materialise

    groups, inverse = materialise(clusters)
    write_jsonl(groups, f"{path}/clusters")
    write_jsonl(inverse, f"{path}/nodes")


def write_scores(df: DataFrame, path: str) -> None:
    out = df.select(norm_id("query_id").alias("query_id"), norm_id("candidate_id").alias("candidate_id"), "probability")
    require(out.where("probability is null or probability < 0 or probability > 1"), "scores must be in [0, 1]")
    out.write.mode("overwrite").json(path)


def nested_recall(candidates: DataFrame) -> DataFrame:
    """``query_case_id, candidates``: best first."""
    fields = [c for c in candidates.columns if c not in ("query_id", "rank", "candidate_id")]
    entry = F.struct("rank", F.col("candidate_id").alias("case_id"), *fields)
    return candidates.groupBy(F.col("query_id").alias("query_case_id")).agg(F.array_sort(F.collect_list(entry)).alias("candidates"))


def sha256_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def _digest(path: str) -> tuple[str, int]:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest(), os.path.getsize(path)


def sha256_of(path: str) -> str:
    return _digest(path)[0]


def freeze_manifest(assets: dict[str, str], path: str, metadata: dict | None = None, version: str | int = 1) -> dict:
    if not assets:
        raise ContractError("no assets")
    made = {k: dict(zip(("sha256", "bytes"), _digest(p)), path=p) for k, p in assets.items()}
    manifest = {"version": version, "created_utc": datetime.now(timezone.utc).isoformat(), "assets": made, "metadata": metadata or {}}
    write_json_atomic(path, manifest)
    return manifest


def verify_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    for label, a in manifest["assets"].items():
        if _digest(a["path"])[0] != a["sha256"].lower():
            raise ContractError(f"{label} has changed")
    return manifest


def manifest_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: added, removed or changed."""
    both = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change is not null")


def manifest_by_category(entries: DataFrame, category: str = "category") -> DataFrame:
    """``category, files, bytes`` of path, bytes and a category (without one: the folder that a path begins with)."""
    name = F.col(category) if category in entries.columns else F.substring_index("path", "/", 1)
    return entries.groupBy(name.alias("category")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def missing_assets(folder: str, needed: dict[str, list[str]], profile: str) -> list[str]:
    """Files of a profile that a folder lacks."""
    if profile not in needed:
        raise ContractError(f"unknown profile {profile!r}")
    return [x for x in needed[profile] if not os.path.exists(os.path.join(folder, x))]


def comparison(rows: DataFrame, metrics: list[str], baseline: str, method: str) -> DataFrame:
    """``dataset, metric, baseline, baseline_std, method, method_std, delta`` of two methods: mean and deviation over their rows."""
    long = rows.select("method", "dataset", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("method", "dataset", "x.*")
    wide = long.groupBy("dataset", "metric").pivot("method", [baseline, method]).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    one = lambda m, x: F.col(f"`{m}_{x}`")
    return wide.select("dataset", "metric", one(baseline, "mean").alias("baseline"), one(baseline, "std").alias("baseline_std"), one(method, "mean").alias("method"), one(method, "std").alias("method_std"), (one(method, "mean") - one(baseline, "mean")).alias("delta"))
