"""Incremental adds: first write wins, last write wins, and their streaming forms."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohort.operators.validation import ContractError
from kohort.session import cut


def add_first_wins(existing: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the batch that are new; of a key that repeats in it, the first in order of its other columns."""
    new = batch.join(existing.select(key).distinct(), key, "left_anti")
    w = Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    return new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, pre-aggregated map-side."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*rows.columns)


def add_to_table(batch: DataFrame, target: str, key: str = "id", rebuild: bool = False) -> dict:
    """Append the new keys of a batch to a Parquet table (or write it anew): ``added`` and ``count``, as read back."""
    spark = batch.sparkSession
    known = None if rebuild else existing_table(spark, target)
    new = cut(add_first_wins(known if known is not None else batch.limit(0), batch, key))
    new.write.mode("overwrite" if rebuild else "append").parquet(target)
    return {"added": new.count(), "count": spark.read.parquet(target).count()}


def existing_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where none is."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to a folder has ended: its success marker is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def process_scopes(rows: DataFrame, scopes: list[tuple[int, int]], channels: dict[str, Callable[[DataFrame], DataFrame]], target: str, year: str = "archive_year", month: str = "archive_month", rebuild: bool = False) -> list[dict]:
    """Each month's rows through each channel, written to ``target/channel/year=/month=``; what is complete is kept.

    A channel turns the rows of a month into its own rows (a view, its vectors, an index part). Months are batches of
    their own, so that an interrupted run goes on where it ended. Returns month, channel, whether it was skipped, and rows.
    """
    spark, out = rows.sparkSession, []
    for y, m in scopes:
        own = rows.where((F.col(year) == y) & (F.col(month) == m))
        for name, make in channels.items():
            folder = f"{target}/{name}/year={y}/month={m:02d}"
            skipped = not rebuild and complete(spark, folder)
            if not skipped:
                make(own).write.mode("overwrite").parquet(folder)
            out.append({"month": f"{y}-{m:02d}", "channel": name, "skipped": skipped, "rows": spark.read.parquet(folder).count()})
    return out


def resume(spark: SparkSession, folder: str, config: dict, outputs: tuple[str, ...], make: Callable[[str], None]) -> bool:
    """Run make(folder) unless all its outputs are complete and were made with the same config; True if it was skipped.

    The config is written last, as one row of JSON, so that an interrupted run is not taken for a whole one.
    """
    wanted = json.dumps(config, sort_keys=True)
    if complete(spark, f"{folder}/_config") and all(complete(spark, f"{folder}/{x}") for x in outputs) and spark.read.text(f"{folder}/_config").first().value == wanted:
        return True
    make(folder)
    if missing := [x for x in outputs if not complete(spark, f"{folder}/{x}")]:
        raise ContractError(f"outputs not written: {missing}")
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_config")
    return False


def stream_first_wins(source: DataFrame, target: str, checkpoint: str, key: str = "id"):
    """Append new keys of each micro-batch to a Parquet table; a batch that is run again adds nothing twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        existing = existing_table(batch.sparkSession, target)
        add_first_wins(existing if existing is not None else batch.limit(0), batch, key).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(source: DataFrame, key: str = "id") -> DataFrame:
    """First of each key with state in the stream."""
    return source.dropDuplicates([key])
