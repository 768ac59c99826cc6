"""Global numbers of rows without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohort.session import cut, shuffle_partitions


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_no") -> DataFrame:
    """df with a number from 0 in the given order (its columns must tell all rows apart for a stable result).

    Rows are dealt by range and checkpointed, so that ranges are fixed; counts of the ranges, one row each, are
    prefix-summed and broadcast; numbers inside a range come from a window on it.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order)})
    ranged = cut(keyed.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return ranged.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before", *keys)


def numeric_string(c: Column | str) -> list[Column]:
    """Order keys that put decimal strings in the order of their numbers: shorter ones first."""
    c = F.col(c) if isinstance(c, str) else c
    return [F.length(c), c]
