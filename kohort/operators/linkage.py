"""Complete linkage on sparse scores, inside each connected component."""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions.scalars import norm_id
from kohort.operators.graph import EPS, components, threshold_edges
from kohort.operators.ordering import numbered
from kohort.operators.validation import require
from kohort.session import cut, ship, shuffle_partitions


def _merges(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> list[tuple[int, int, int, float]]:
    """merge_history of distinct pairs in arrays.

    Edges come by distance and are counted by pairs of clusters: two are complete, at that distance, with the last edge
    between their members. Two nodes are so with their one edge, and a pair that lacks an edge (a member outside the common
    neighbours of the other side) is never counted, so that little is held besides the arrays.
    """
    u, v = u.astype(np.int32), v.astype(np.int32)
    both = np.lexsort((np.concatenate([v, u]), ends := np.concatenate([u, v])))
    begin = np.searchsorted(ends[both], np.arange(n + 1)).tolist()
    around = array("i", np.concatenate([v, u])[both].astype(np.intc).tobytes())
    del both, ends
    order = np.argsort(d, kind="stable")
    u, v, d = u[order], v[order], d[order]
    up, made = array("i", range(n)), n
    common: dict[int, array] = {}  # of clusters of two and more: nodes that all members are near to, in order
    members: dict[int, array] = {}
    count: dict[int, dict[int, int]] = {}  # edges so far between clusters that may become complete
    out = []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def own(a: int) -> array:
        return members.get(a) or array("i", [a])

    def near(a: int, x: int) -> bool:
        where, lo, hi = (common[a], 0, len(common[a])) if a >= n else (around, begin[a], begin[a + 1])
        i = bisect_left(where, x, lo, hi)
        return i < hi and where[i] == x

    def may(a: int, b: int) -> bool:
        if len(own(a)) < len(own(b)):
            a, b = b, a
        return all(near(a, x) for x in own(b))

    def add(a: int, b: int, k: int) -> None:
        one, two = count.setdefault(a, {}), count.setdefault(b, {})
        one[b] = two[a] = k = one.get(b, 0) + k
        if k == len(own(a)) * len(own(b)):
            heapq.heappush(ready, (min(a, b), max(a, b)))

    step = 1 << 16
    ready: list[tuple[int, int]] = []
    at = 0
    while at < len(d):
        end = int(np.searchsorted(d, d[min(at + step, len(d)) - 1], "right"))  # whole groups of equal distances
        rows = zip(u[at:end].tolist(), v[at:end].tolist(), d[at:end].tolist(), [*(d[at + 1 : end] != d[at : end - 1]).tolist(), True])
        for x, y, w, last in rows:
            a, b = find(x), find(y)
            if b in count.get(a, ()) or may(a, b):
                add(a, b, 1)
            while last and ready:
                a, b = heapq.heappop(ready)
                if up[a] != a or up[b] != b:
                    continue
                c, made = made, made + 1
                up.append(c)
                up[a] = up[b] = c
                few, many = sorted((a, b), key=lambda i: len(common[i]) if i >= n else begin[i + 1] - begin[i])
                common[c] = array("i", [i for i in (common[few] if few >= n else around[begin[few] : begin[few + 1]]) if near(many, i)])
                members[c] = own(a) + own(b)
                left = count.pop(a)
                for i, k in count.pop(b).items():
                    left[i] = left.get(i, 0) + k
                for gone in (a, b):
                    left.pop(gone, None)
                    common.pop(gone, None)
                    members.pop(gone, None)
                for i, k in left.items():
                    count[i].pop(a, None)
                    count[i].pop(b, None)
                    if may(c, i):
                        add(c, i, k)
                count.setdefault(c, {})
                out.append((a, b, c, w))
        at = end
    return out


def merge_history(n: int, edges: list[tuple[int, int, float]], cut: float) -> list[tuple[int, int, int, float]]:
    """Merges ``(a, b, new, distance)`` in order. Nodes are 0..n-1, edges ``(u, v, distance)``; a missing edge is too far.

    Of equal distances the pair with the lower, then the higher number merges first.
    """
    kept = {(min(u, v), max(u, v)): d for u, v, d in edges if d <= cut + EPS}
    u, v = (np.array([x[i] for x in kept], np.int32) for i in (0, 1))
    return _merges(n, u, v, np.array(list(kept.values()), float))


def cut_history(n: int, history: list[tuple[int, int, int, float]], cut: float) -> list[list[int]]:
    """Clusters at a cut: one history serves all lower cuts, as complete linkage has no inversions."""
    groups = {i: [i] for i in range(n)}
    for a, b, c, d in history:
        if d <= cut + EPS:
            groups[c] = groups.pop(a) + groups.pop(b)
    return sorted(sorted(g) for g in groups.values())


def _runs(t: pa.Table, limits: np.ndarray) -> pa.Table:
    """``node, cluster, lo, hi``: the cluster of a node at limits[lo:hi], distances in rising order; edges are ``u, v, w``.

    All components of a task are one graph, as they do not touch; a node's runs cover the limits without a gap.
    """
    ends = pa.chunked_array([*t["u"].chunks, *t["v"].chunks], pa.string())
    names = np.array(pc.unique(ends).to_pylist(), object)
    names.sort()  # by code points, as Spark's order of bytes
    found, n = pa.array(names, pa.string()), len(names)
    u, v = (pc.index_in(t[c], found).to_numpy().astype(np.int32) for c in ("u", "v"))
    history = _merges(n, u, v, 1.0 - t["w"].to_numpy())
    left = np.searchsorted(limits, [d for *_, d in history])  # the first limit that a merge is within
    parts: dict[int, tuple[array, int]] = {}
    node, cluster, lo, hi = (array("i") for _ in range(4))

    def close(x: int, end: int) -> array:
        ids, begin = parts.pop(x, None) or (array("i", [x]), 0)
        if begin < end:
            node.extend(ids)
            for to, value in ((cluster, min(ids)), (lo, begin), (hi, end)):
                to.extend(array("i", [value]) * len(ids))
        return ids

    for (a, b, c, _), i in zip(history, left.tolist()):
        parts[c] = (close(a, i) + close(b, i), i)
    alive = {*range(n)} - {x for a, b, *_ in history for x in (a, b)}
    for x in [*alive, *parts]:
        close(x, len(limits))
    take = lambda x: found.take(pa.array(np.frombuffer(x, np.intc)))
    return pa.table({"node": take(node), "cluster": take(cluster), "lo": pa.array(np.frombuffer(lo, np.intc)), "hi": pa.array(np.frombuffer(hi, np.intc))})


def _by_component(edges: DataFrame, run, schema: str) -> DataFrame:
    """run on the edges of each component; many small components share a call, as each call has its cost."""

    def every(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([run(one) for _, one in pdf.groupby("component", sort=False)], ignore_index=True)

    task = F.pmod(F.xxhash64("component"), F.lit(4 * shuffle_partitions(edges.sparkSession)))
    return edges.withColumn("_task", task).groupBy("_task").applyInPandas(every, schema)


def complete_linkage(nodes: DataFrame, edges: DataFrame, theta: float, node: str = "node") -> DataFrame:
    """``node, cluster``: cluster is its least node. A component is one group; its kept edges must fit one task."""
    return linkage_at(nodes, edges, [theta], node).select("node", "cluster")


def linkage_at(nodes: DataFrame, edges: DataFrame, thetas: list[float], node: str = "node") -> DataFrame:
    """``theta, node, cluster`` for many thresholds from one merge history for each component.

    What leaves a task are a node's runs of thresholds in the same cluster; a row for each threshold is made from them after
    the join with the nodes.
    """
    ship(nodes.sparkSession)
    falling = sorted(set(thetas), reverse=True)
    limits = np.array([1.0 - t + EPS for t in falling])
    kept = threshold_edges(edges, falling[-1])
    comp = components(nodes, kept, node)
    task = F.pmod(F.xxhash64("component"), F.lit(4 * shuffle_partitions(edges.sparkSession))).alias("_task")
    own = kept.join(comp.select(F.col(node).alias("u"), "component"), "u").select(task, F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "w")
    runs = own.groupBy("_task").applyInArrow(lambda t: _runs(t, limits), "node string, cluster string, lo int, hi int")
    all_of = nodes.select(F.col(node).alias("node")).distinct().join(runs, "node", "left")
    lo, hi = F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(len(falling)))
    at = F.explode(F.slice(F.array(*map(F.lit, falling)), lo + 1, hi - lo))
    return all_of.select(at.alias("theta"), "node", F.coalesce("cluster", "node").alias("cluster"))


def clique_violations(clusters: DataFrame, edges: DataFrame, theta: float) -> DataFrame:
    """One row: pairs inside clusters, kept edges inside clusters, and their difference (0 for complete linkage)."""
    pairs = clusters.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))
    a, b = clusters.select(F.col("node").alias("u"), F.col("cluster").alias("cu")), clusters.select(F.col("node").alias("v"), F.col("cluster").alias("cv"))
    inside = threshold_edges(edges, theta).join(a, "u").join(b, "v").where("cu = cv").agg(F.count("*").alias("edges"))
    return pairs.crossJoin(inside).select("pairs", "edges", (F.col("pairs") - F.col("edges")).alias("violations"))


def dense_merges(distance: np.ndarray, cut: float) -> list[list[int]]:
    """Complete linkage on a full matrix, in which pairs without a score are 1 apart: nearest pair, greatest distances, again."""
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(d))}
    while len(groups) > 1:
        a, b = sorted(divmod(int(d.argmin()), len(d)))
        if d[a, b] > cut + EPS:
            break
        groups[a] += groups.pop(b)
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[b] = d[:, b] = d[a, a] = np.inf
    return sorted(sorted(g) for g in groups.values())


def dense_linkage(nodes: DataFrame, edges: DataFrame, theta: float, node: str = "node", most: int = 5000) -> DataFrame:
    """complete_linkage by full matrices: a second opinion for components of at most ``most`` nodes (others raise).

    Equal where no two distances tie; of tied pairs another may merge first.
    """
    ship(nodes.sparkSession)
    kept = threshold_edges(edges, theta)
    comp = components(nodes, kept, node)
    require(comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most), "components too large for full matrices")
    own = kept.join(comp.select(F.col(node).alias("u"), "component"), "u").select("component", "u", "v", "w")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["u"], *pdf["v"]})
        at = {x: i for i, x in enumerate(names)}
        d = np.ones((len(names), len(names)))
        for u, v, w in zip(pdf["u"], pdf["v"], pdf["w"]):
            d[at[u], at[v]] = d[at[v], at[u]] = 1.0 - w
        return pd.DataFrame([(names[i], names[g[0]]) for g in dense_merges(d, 1.0 - theta) for i in g], columns=["node", "cluster"])

    linked = _by_component(own, link, "node string, cluster string")
    return nodes.select(F.col(node).alias("node")).distinct().join(linked, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def cluster_events(nodes: DataFrame, pairs: DataFrame, theta: float, rule: str = "mutual", node: str = "node", backend: str = "sparse") -> DataFrame:
    """Scores to clusters in one call: best of repeats, undirected edges, threshold, components, linkage.

    Ids are stripped on both sides; what comes out is a partition of the nodes, each once, or an error.
    """
    from kohort.operators.graph import directed_scores, undirected_edges
    from kohort.operators.validation import candidate_violations, duplicate_ids, partition_violations

    if backend not in ("sparse", "dense"):
        raise ValueError(f"unknown backend {backend!r}")
    require(duplicate_ids(nodes, node), "nodes must be unique and not empty")
    nodes = nodes.select(norm_id(node).alias(node))
    bad = candidate_violations(pairs, nodes, node=node).where("why <> 'no query' and why <> 'self'")
    require(bad, "scores outside the nodes")
    out = cut((complete_linkage if backend == "sparse" else dense_linkage)(nodes, undirected_edges(directed_scores(pairs), rule), theta, node))
    require(partition_violations(out, nodes.withColumnRenamed(node, "node"), "node", "cluster"), "the clusters are no partition")
    return out


def cluster_numbers(clusters: DataFrame) -> DataFrame:
    """``cluster, cluster_id, size``: numbers from 0 in the order of least members, whatever the number of clusters."""
    return numbered(clusters.groupBy("cluster").agg(F.count("*").alias("size")), ["cluster"], "cluster_id")


def materialise(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cluster_id, size, members`` for export, and the inverse map ``node, cluster_id``.

    A cluster's members stand in one row; a cluster of more than some ten million ids should be exported from the map.
    """
    ids = cut(cluster_numbers(clusters))
    inverse = clusters.join(ids, "cluster").select("node", "cluster_id", "size")
    groups = inverse.groupBy("cluster_id", "size").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return groups, inverse.select("node", "cluster_id")


def size_statistics(clusters: DataFrame, top: int = 10) -> DataFrame:
    """One row: clusters, nodes, singletons, the greatest size, and the ``top`` greatest sizes in order."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    most = sizes.orderBy(F.desc("size")).limit(top).agg(F.sort_array(F.collect_list("size"), asc=False).alias("top_sizes"))
    return sizes.agg(F.count("*").alias("clusters"), F.sum("size").alias("nodes"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest")).crossJoin(most)
