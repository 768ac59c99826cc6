"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kohort.session import cut, ship

FINISH = 1 << 16  # edges that one task may take


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(lows, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    lows = edges.groupBy("u").agg(F.min("v").alias("low"))
    rest = edges.join(lows, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return rest.union(lows.select("u", F.col("low").alias("v"))).distinct()


def _finish(edges: DataFrame) -> DataFrame:
    """``u, v`` with v the least node reachable from u, by union-find in one task; for a checked number of edges only."""
    kind = edges.schema["u"].dataType
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        parted = [(x, find(x)) for x in list(up)]
        rows = [(x, y) for x, y in parted if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to_arrow_type(kind)) for i in (0, 1)], names=["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, finish: int = FINISH) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another; component is the smallest node reachable.

    Null endpoints and self loops are dropped, direction and repeats don't matter. A round costs two shuffles on the
    node; hub nodes are pre-aggregated map-side, and the joins are left to adaptive skew handling. The number of
    rounds grows with the logarithm of the longest chain. Each round is checkpointed. What is left of a graph once it has
    FINISH edges or fewer, a number that each round counts, goes through one task. An empty input gives no rows.
    """
    a, b = F.col(src), F.col(dst)
    canon = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    canon = cut(canon)
    sign = _signature(canon)
    for _ in range(max_rounds):
        if sign[0] <= finish:
            canon = cut(_finish(canon))
            break
        canon = cut(_small_star(_large_star(canon)))
        now = _signature(canon)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return canon.select(F.col("u").alias("node"), F.col("v").alias("component")).union(canon.select("v", "v").distinct())


def with_singletons(nodes: DataFrame, components: DataFrame, node: str = "node") -> DataFrame:
    """Every node with its component; a node without edges is its own."""
    found = components.select(F.col("node").alias("_n"), "component")
    own: Column = F.coalesce("component", F.col(node))
    return nodes.select(node).distinct().join(found, F.col(node) == F.col("_n"), "left").select(node, own.alias("component"))
