"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.operators.components import connected_components
from kohort.session import cut, ship

THRESHOLD = 0.98
TABLES, PROJECTIONS, WIDTH = 24, 10, 1.0
BLOCK = 1024  # vectors of a bucket that meet in one matrix product
SEED = 7


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def hash_keys(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int = SEED) -> np.ndarray:
    """A 64-bit key for each vector (row) and table from floor((a.x + b) / width) of its projections."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    a = rng.standard_normal((vectors.shape[1], tables * projections))
    b = rng.random(tables * projections) * width
    cell = np.floor((unit(vectors) @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, projections)
    key = np.zeros((len(vectors), tables), np.uint64)
    for j in range(projections):
        key = (key ^ cell[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links those that join two parts."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _check(threshold: float):
    """For a task (two blocks of a bucket): links of each vector that no earlier table shows, and links that span them."""

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        x = unit(np.asarray(group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rep), -1))
        keys = np.asarray(group.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(rep), -1)
        table = group.column("tab")[0].as_py()
        one, two = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        same = bool(side.max() == 0)  # a block with itself; else one side of a pair of blocks may be empty
        two = one if same else two
        links = np.zeros(len(rep), np.int64)
        edges: list[tuple[int, int]] = []
        for at in range(0, len(one), 256):
            rows = one[at : at + 256]
            i, j = np.nonzero(x[rows] @ x[two].T >= threshold)
            i, j = rows[i], two[j]
            if same:
                i, j = i[i < j], j[i < j]
            if table and len(i):
                seen = np.zeros(len(i), bool)
                for t in range(table):
                    seen |= keys[i, t] == keys[j, t]
                i, j = i[~seen], j[~seen]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges += _spanning(len(rep), i, j)
        if edges:
            a, b = np.array(edges).T
            edges = _spanning(len(rep), a, b)
        some = np.flatnonzero(links)
        a, b = (np.array(edges).T if edges else (np.empty(0, int),) * 2)
        return pa.table({"rep": pa.array(np.concatenate([rep[some], rep[a]]), pa.int64()), "links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]), pa.int64()), "other": pa.array([None] * len(some) + rep[b].tolist(), pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of vectors (``vec_id, embedding, label``).

    Two vectors are compared if their labels are equal and not null and their lengths agree; they link at a cosine of
    threshold or more in double precision. n_links counts other rows linked directly, component_id is the least vec_id
    reachable, kept says that it is the row's own. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null vec_id, link with nothing. Equal vectors of a label are one class: copies are
    counted, never compared. At the defaults a pair at cosine 0.98 meets in some table with probability 0.99, a nearer
    one more often; nothing below the threshold is linked.

    Plan: a class goes by the 128-bit hash of label and vector. Hash keys without vectors are shuffled first; buckets of two
    and more with the same members in several tables (by count and two sums of hashes) count as one, the first, so that a
    close group is compared once; only then vectors follow, one for each such bucket. A bucket of more than BLOCK is dealt by
    hash into blocks, and pairs of blocks are tasks: all its pairs are still compared. Links found in several tables count
    in the first. A task returns sums and a spanning forest, not pairs; answers go back by the class's hash.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select("vec_id", "label", "embedding", F.monotonically_increasing_id().alias("_row"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    base = base.withColumn("good", good).withColumns({"_a": F.xxhash64("label", "embedding"), "_b": F.xxhash64(F.lit(SEED), "embedding", "label")})
    sound = base.where("good")
    classes = sound.groupBy("_a", "_b").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("_row").alias("rep"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))

    def hashed(batches):
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
            ends = np.cumsum(sizes)
            out = np.empty((len(sizes), tables), np.int64)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                out[rows] = hash_keys(flat[(ends[rows] - d)[:, None] + np.arange(d)], tables, projections, width)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["embedding", "_in", "_a", "_b", "rep", "copies", "least", "keys"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    plain = classes.select("embedding", F.xxhash64("label", F.size("embedding")).alias("_in"), "_a", "_b", "rep", "copies", "least")
    classes = cut(plain.mapInArrow(hashed, f"embedding {kind}, _in long, _a long, _b long, rep long, copies long, least long, keys array<long>"))
    light = classes.select("rep", "_in", F.posexplode("keys").alias("tab", "key")).select("rep", "tab", F.xxhash64("_in", "tab", "key").alias("bucket"))
    total = lambda seed: F.sum(F.xxhash64("rep", F.lit(seed)).cast("decimal(38,0)"))
    full = light.groupBy("bucket").agg(F.count("*").alias("n"), F.min("tab").alias("tab"), total(1).alias("s1"), total(2).alias("s2")).where("n > 1")
    full = full.groupBy("n", "s1", "s2").agg(F.min(F.struct("tab", "bucket")).alias("x")).select(F.col("x.bucket").alias("bucket"), "n")
    met = light.join(full, "bucket").select("rep", "tab", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("nb")).cast("int")
    met = met.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = met.select("rep", "tab", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    tasks = met.join(classes.select("rep", "copies", "embedding", "keys"), "rep")
    found = cut(tasks.groupBy("task").applyInArrow(_check(threshold), "rep long, links long, other long"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null"), "rep", "other").select(F.col("node").alias("rep"), "component")
    slim = classes.select("_a", "_b", "rep", "copies", "least")
    names = parts.join(slim, "rep")
    parts = names.join(names.groupBy("component").agg(F.min("least").alias("low")), "component").select("rep", F.col("low").alias("component"))
    known = slim.join(sums, "rep", "left").join(parts, "rep", "left")
    known = known.select("_a", "_b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    linked = sound.select("vec_id", "_a", "_b").join(known, ["_a", "_b"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
