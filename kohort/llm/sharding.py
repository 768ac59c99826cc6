"""Contiguous shards of near-equal bytes from global prefix sums. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.session import cut, shuffle_partitions

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: cuts of the doc_id order at equal byte targets.

    A document goes to shard ``start * n_shards div total``, start being the bytes before it, so that a shard differs
    from the target by one document at most. A null text has no bytes and the checksum 0; a null doc_id comes first;
    rows with the same doc_id keep the order in which they are read and may meet in one shard. Groups (equal texts) are not
    held together, as the cuts of the order decide alone; text_crc32 tells them. An empty table gives no rows.

    Plan: rows without text are dealt by range (ties spread by a running number) and checkpointed, so that range
    numbers are fixed; totals of each range, one row each, are prefix-summed and broadcast (bounded by the number of
    partitions); running sums stay within a range.
    """
    text = F.col("text")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    n = shuffle_partitions(docs.sparkSession)
    ranged = cut(slim.repartitionByRange(n, "doc_id", "_tie").withColumn("_range", F.spark_partition_id()))
    every = Window.partitionBy()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select(
        "_range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("total"),
    )
    within = Window.partitionBy("_range").orderBy("doc_id", "_tie")
    placed = ranged.withColumn("_start", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("_row", F.row_number().over(within) - 1)
    placed = placed.join(F.broadcast(totals), "_range").select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast(least({n_shards - 1}, (bytes_before + _start) * {n_shards} div total) as int)").alias("shard"),
        (F.col("rows_before") + F.col("_row")).alias("_row"),
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows at most
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
