"""Vector top-k joins, fusion of two routes and ranking metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from kohort.functions.scalars import fuse_score, norm_id
from kohort.operators.validation import require
from kohort.session import cut, ship

BLOCK = 2048  # vectors of either side in one matrix product
PRODUCT = 256  # queries of an exact search in one product: its scores stay in a core's cache
TASK_QUERIES = 1 << 15  # of an exact search, at most
MIN_TASKS = 24  # of an exact search with queries enough, so that a cluster is busy that has not all its executors yet
HELD = 1 << 20  # ids of the base that a task of an exact search holds besides those it needs
PROBE_QUERIES = 256  # queries that measure the probes of an approximate search


def _greatest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k greatest of each row, and those scores; of equal ones the lesser columns. Only the ends are sorted."""
    n = scores.shape[1]
    if n > 4 * k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]  # all that may be among the k, ties included
        rows, cols = np.nonzero(scores >= least)
        order = np.lexsort((cols, -scores[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        begin = np.searchsorted(rows, np.arange(len(scores)))
        top = cols[begin[:, None] + np.arange(k)]
    else:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return top, np.take_along_axis(scores, top, 1)


_FOUND = "query_id string, candidate_id string, score double"


def _best(k: int):
    """The k greatest scores of each query of a block (left) among a block of the base (right)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
            t = t.sort_by("id")
            x = np.asarray(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(t.num_rows, -1)
            return t.column("id").combine_chunks(), x / np.linalg.norm(x, axis=1, keepdims=True)

        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "candidate_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        (qi, qv), (ci, cv) = side(left), side(right)
        top, s = _greatest(np.round(qv @ cv.T, 12), k)
        return pa.table({"query_id": qi.take(pa.array(np.repeat(np.arange(len(qi)), top.shape[1]))), "candidate_id": ci.take(pa.array(top.ravel())), "score": pa.array(s.ravel())})

    return run


_RANKED = "query_id string, candidate_id string, score double, rank int"


class _Nearest:
    """The k greatest scores of a block of queries among a base that streams by in the order of its ids.

    Cosines are looked for in single precision, with a margin over its error, and what is found is scored in double.
    """

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int, metric: str, step: int):
        self.ids, self.k, self.metric, self.step = ids, k, metric, step
        self.x = self._unit(x)
        self.fast = self.x.astype(np.float32) if metric == "cosine" else self.x
        self.margin = 1.2e-7 * (x.shape[1] + 8) if metric == "cosine" else 0.0  # twice the greatest error
        self.score, self.at = np.full((len(x), k), -np.inf), np.full((len(x), k), -1, np.int64)
        self.new: dict[int, list] = {}  # by block of queries: rows, places and scores that may be among the k
        self.seen, self.held = 0, []  # ids of the base: those still held, then those that came since

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True) if self.metric == "cosine" else x

    def add(self, ids: pa.Array, base: np.ndarray) -> None:
        base = self._unit(base)
        fast = base.astype(self.fast.dtype)
        for j in range(0, len(base), BLOCK):
            for i in range(0, len(self.x), self.step):
                self._product(i, base[j : j + BLOCK], fast[j : j + BLOCK], self.seen + j)
        self.held.append(ids)
        self.seen += len(ids)
        if self.seen > HELD + 2 * self.at.size:
            self._forget()

    def _scores(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        s = x @ base.T
        return 2 * s - (x * x).sum(1)[:, None] - (base * base).sum(1)[None, :] if self.metric == "l2" else s

    def _product(self, i: int, base: np.ndarray, fast: np.ndarray, first: int) -> None:
        rows, k = slice(i, i + self.step), self.k
        x, least = self.x[rows], self.score[rows, -1]
        s = self._scores(self.fast[rows], fast)
        at = np.flatnonzero(s > (least - self.margin).astype(s.dtype)[:, None])
        if len(at) > 4 * k * len(x):
            s = self._scores(x, base)
            c, v = _greatest(np.round(np.where(np.isnan(s), -np.inf, s), 12), min(k, len(base)))
            r, c, v = np.repeat(np.arange(len(x)), c.shape[1]), c.ravel(), v.ravel()
        else:
            r, c = np.divmod(at, len(base))
            v = np.round(np.einsum("ij,ij->i", x[r], base[c]) if self.metric == "cosine" else s[r, c], 12)
        more = v > least[r]  # of equal scores the earlier, lesser id stays
        if more.any():
            new = self.new.setdefault(i, [])
            new.append((r[more], c[more] + first, v[more]))
            if sum(len(v) for *_, v in new) >= k * len(x):
                self._merge(i)

    def _merge(self, i: int) -> None:
        r, c, v = map(np.concatenate, zip(*self.new.pop(i)))
        score, at, k = self.score[i : i + self.step], self.at[i : i + self.step], self.k
        hit, r = np.unique(r, return_inverse=True)
        r, v, c = np.concatenate([np.repeat(np.arange(len(hit)), k), r]), np.concatenate([score[hit].ravel(), v]), np.concatenate([at[hit].ravel(), c])
        order = np.lexsort((c, -v, r))
        best = order[np.searchsorted(r[order], np.arange(len(hit)))[:, None] + np.arange(k)]
        score[hit], at[hit] = v[best], c[best]

    def _merge_all(self) -> None:
        for i in list(self.new):
            self._merge(i)

    def _forget(self) -> None:
        """Only the ids of candidates that are kept now stay; they are numbered anew, in the same order."""
        self._merge_all()
        used, at = np.unique(self.at, return_inverse=True)
        gap = int(len(used) and used[0] < 0)
        self.held = [pa.concat_arrays(self.held).take(pa.array(used[gap:]))]
        self.at, self.seen = at.reshape(self.at.shape) - gap, len(used) - gap

    def results(self):
        """Batches by _RANKED; queries of one id share their k."""
        self._merge_all()
        names = pa.concat_arrays(self.held) if self.held else pa.array([], pa.string())
        ids = np.asarray(self.ids.to_pylist(), object)
        group = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]).astype(int)) if len(ids) else np.empty(0, int)
        g, s, c = np.repeat(group, self.k), self.score.ravel(), self.at.ravel()
        found = np.flatnonzero(s > -np.inf)
        order = found[np.lexsort((c[found], -s[found], g[found]))]
        rank = np.arange(len(order)) - np.searchsorted(g[order], g[order]) + 1
        order, rank = order[rank <= self.k], rank[rank <= self.k]
        for i in range(0, len(order), 1 << 16):
            o = order[i : i + (1 << 16)]
            yield pa.record_batch({"query_id": self.ids.take(pa.array(o // self.k)), "candidate_id": names.take(pa.array(c[o])), "score": pa.array(s[o]), "rank": pa.array(rank[i : i + (1 << 16)], pa.int32())})


def _stream(k: int, metric: str, step: int):
    """Batches of ``slot, side, id, v`` of one task, the queries (side 0) first, both in the order of their ids."""

    def run(batches):
        ids, rows, near = [], [], None
        for b in batches:
            n = int(np.searchsorted(np.asarray(b.column(1)), 1))  # queries in this batch
            x = np.asarray(b.column(3).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            if n:
                ids.append(b.column(2).slice(0, n))
                rows.append(x[:n])
            if n < b.num_rows and rows:
                near = near or _Nearest(pa.concat_arrays(ids), np.concatenate(rows), k, metric, step)
                near.add(b.column(2).slice(n), x[n:])
        if near:
            yield from near.results()

    return run


def knn(queries: DataFrame, base: DataFrame, k: int, vector: str = "vec", key: str = "id", block: int = PRODUCT, metric: str = "cosine") -> DataFrame:
    """Exact ``query_id, candidate_id, score, rank``: the k greatest cosines, the query itself included if it is in base.

    metric: ``cosine``, ``ip`` (inner products) or ``l2`` (negative squared distances). block: queries in one product.

    Queries are dealt by hash, each once, to tasks; the base goes to every task and streams past its queries, so that a
    task holds its queries and k rows for each, and nothing but the answers is shuffled on. As many tasks as keep the
    cores busy, whatever the number of rows, until a task would have more than TASK_QUERIES queries. Ties go to the lesser
    id. Null and zero vectors neither ask nor answer.
    """
    spark = queries.sparkSession
    ship(spark)

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector) if df.schema[vector].dataType == ArrayType(FloatType()) else F.col(vector).cast("array<double>")  # floats are widened in the task
        return df.select(F.col(key).cast("string").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))

    q = sound(queries)
    asked = q.count()
    n = max(math.ceil(asked / TASK_QUERIES), min(max(MIN_TASKS, 2 * spark.sparkContext.defaultParallelism), math.ceil(asked / 64)), 1)
    q = q.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("slot"), F.lit(0).alias("side"), "id", "v")
    c = sound(base).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"), F.lit(1).alias("side"), "id", "v")
    kind = q.schema["v"].dataType if q.schema["v"].dataType == c.schema["v"].dataType else ArrayType(DoubleType())
    both = q.withColumn("v", F.col("v").cast(kind)).union(c.withColumn("v", F.col("v").cast(kind)))
    return both.repartitionById(n, F.col("slot")).sortWithinPartitions("side", "id").mapInArrow(_stream(k, metric, block), _RANKED)


def _probes(asked: np.ndarray, x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of nearest cells that hold a share of recall of the queries' k nearest among x."""
    if not len(asked) or not len(x):
        return max(1, len(centres))
    at = (x @ centres.T).argmax(1)
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    found = np.take_along_axis(place, at[near], 1)  # how many cells come before a neighbour's
    return next(n for n in range(1, len(centres) + 1) if n == len(centres) or (found < n).mean() >= recall)


def knn_approximate(queries: DataFrame, base: DataFrame, k: int, cells: int | None = None, probes: int | None = None, sample: int = 20_000, seed: int = 42, vector: str = "vec", key: str = "id", recall: float = 0.95, block: int = BLOCK) -> DataFrame:
    """IVF: spherical k-means cells from a bounded sample, an equi-join on the nearest cells, then exact cosines.

    cells: None for the root of the base's size (4,096 at most). probes: nearest cells that a query visits; None for as
    many as reach recall at k, measured for a few hundred queries against the sample: true neighbours in a larger base are
    nearer than those, and so more often in the first cells. Every vector is in a cell; null and zero vectors neither ask
    nor answer. A cell is dealt into blocks on either side, and a task multiplies two blocks and keeps k for each query.
    """
    ship(queries.sparkSession)
    sound = lambda df: df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    asked, known = sound(queries), sound(base)

    def picked(df: DataFrame, n: int, seed: int) -> np.ndarray:
        rows = df.select("v", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(n).toArrow()
        x = np.array(rows.column("v").to_pylist(), float)
        return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, 1))

    x = picked(known, sample, seed)
    cells = cells or min(4096, max(1, math.isqrt(known.count())))
    centres = x[: min(cells, len(x))].copy()
    for _ in range(10):
        near = (x @ centres.T).argmax(1) if len(x) else np.empty(0, int)
        for i in np.unique(near):
            centres[i] = x[near == i].mean(0)
            centres[i] /= max(np.linalg.norm(centres[i]), 1e-12)
    if probes is None:
        probes = _probes(picked(asked, PROBE_QUERIES, seed + 1), x, centres, k, recall)

    def cell(n: int):
        def run(batches):
            for b in batches:
                v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                near = v / np.linalg.norm(v, axis=1, keepdims=True) @ centres.T
                top = np.argpartition(-near, min(n, near.shape[1]) - 1, axis=1)[:, :n]
                rep = pa.array(np.repeat(np.arange(b.num_rows), top.shape[1]))
                yield pa.record_batch({"id": b.column(0).take(rep), "v": b.column(1).take(rep), "cell": pa.array(top.ravel(), pa.int32())})

        return run if len(centres) else lambda batches: iter(())

    kind = "id string, v array<double>, cell int"
    q, c = cut(asked.mapInArrow(cell(probes), kind)), cut(known.mapInArrow(cell(1), kind))
    blocks = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    plan = F.broadcast(blocks(q, "nq").join(blocks(c, "nc"), "cell"))  # a row for each cell
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(plan, "cell").select("cell", own("nq").alias("qb"), every("nc").alias("cb"), "id", "v")
    c = c.join(plan, "cell").select("cell", every("nq").alias("qb"), own("nc").alias("cb"), "id", "v")
    on = ["cell", "qb", "cb"]
    scored = q.groupBy(*on).cogroup(c.groupBy(*on)).applyInArrow(_best(k), _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lookup_queries(ids: DataFrame, vectors: DataFrame, key: str = "id", vector: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Vectors of the asked ids, and the ids that have none or an invalid one (``valid`` false, where vectors say so)."""
    asked = ids.select(norm_id(key).alias(key)).distinct()
    known = vectors.where(F.col(vector).isNotNull() & (F.col("valid") if "valid" in vectors.columns else F.lit(True))).select(norm_id(key).alias(key), vector)
    return asked.join(known, key), asked.join(known, key, "left_anti")


class VectorIndex:
    """One interface over the searches: kind ``flat`` is exact, ``ivf`` approximate; metric ``ip`` takes vectors as they are.

    A flat index answers with cosines, or with inner products if metric is ``ip``; for ``l2`` scores are negative squared
    distances. All three order unit vectors alike.
    """

    def __init__(self, base: DataFrame, kind: str = "flat", metric: str = "cosine", key: str = "id", vector: str = "vec", **options):
        if kind not in ("flat", "ivf") or metric not in ("cosine", "ip", "l2") or (kind == "ivf" and metric != "cosine"):
            raise ValueError(f"no {kind} index for {metric}")
        self.base, self.kind, self.metric, self.key, self.vector, self.options = base, kind, metric, key, vector, options

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if k <= 0:
            raise ValueError("k must be positive")
        names = {"key": self.key, "vector": self.vector}
        if self.kind == "ivf":
            return knn_approximate(queries, self.base, k, **names, **self.options)
        return knn(queries, self.base, k, metric=self.metric, **names, **self.options)


def merge_routes(text: DataFrame, event: DataFrame, mode: str = "max", w_text: float = 0.5, lambda_min: float = 0.2, top_n: int | None = None) -> DataFrame:
    """Full outer merge of two knn results; the query itself goes after ranking, so that ranks keep its gap.

    ``query_id, candidate_id, score_text, rank_text, score_event, rank_event, in_text, in_event, score_fuse, rank``.
    Equal fused scores are ordered by text rank, event-only rows last by event rank.
    """
    a = text.select("query_id", "candidate_id", F.col("score").alias("score_text"), F.col("rank").alias("rank_text"))
    b = event.select("query_id", "candidate_id", F.col("score").alias("score_event"), F.col("rank").alias("rank_event"))
    both = a.join(b, ["query_id", "candidate_id"], "full_outer").where("query_id <> candidate_id")
    both = both.withColumn("in_text", F.col("rank_text").isNotNull()).withColumn("in_event", F.col("rank_event").isNotNull())
    both = both.withColumn("score_fuse", fuse_score("score_text", "score_event", mode, w_text, lambda_min))
    w = Window.partitionBy("query_id").orderBy(F.desc("score_fuse"), F.asc_nulls_last("rank_text"), F.asc_nulls_last("rank_event"), "candidate_id")
    out = both.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top_n) if top_n else out


def ranking_metrics(candidates: DataFrame, truth: DataFrame | None, ks: list[int], queries: DataFrame | None = None, incidents: DataFrame | None = None) -> DataFrame:
    """``k, recall, hit, mrr`` over all queries; one without truth or without candidates counts 0.

    candidates: query_id, candidate_id, rank; truth: query_id, candidate_id; queries: query_id of every query that was
    asked. Without it those of candidates and truth are taken. incidents (id, incident, with each id once) in place of
    truth: all others of a query's incident are its truth, whose pairs are counted and never listed; null is no incident.
    """
    if (truth is None) == (incidents is None):
        raise ValueError("either truth or incidents")
    if incidents is None:
        truth = truth.select("query_id", "candidate_id").distinct()
        size = truth.groupBy("query_id").agg(F.count("*").alias("n_truth"))
        marked = candidates.join(truth.withColumn("good", F.lit(1)), ["query_id", "candidate_id"], "left")
    else:
        own = incidents.select("id", "incident").where("incident is not null").distinct()
        require(own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "an id has one incident")
        size = own.join(own.groupBy("incident").agg((F.count("*") - 1).alias("n_truth")), "incident").select(F.col("id").alias("query_id"), "n_truth")
        q, c = own.select(F.col("id").alias("query_id"), F.col("incident").alias("_q")), own.select(F.col("id").alias("candidate_id"), F.col("incident").alias("_c"))
        good = F.when((F.col("_q") == F.col("_c")) & (F.col("query_id") != F.col("candidate_id")), 1)
        marked = candidates.join(q, "query_id", "left").join(c, "candidate_id", "left").withColumn("good", good)
    if queries is None:
        queries = candidates.select("query_id").union(size.where("n_truth > 0").select("query_id"))
    per = marked.groupBy("query_id").agg(*[F.count_if((F.col("good") == 1) & (F.col("rank") <= k)).alias(f"h{k}") for k in ks], F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    per = queries.select("query_id").distinct().join(per, "query_id", "left").join(size, "query_id", "left").fillna(0, [f"h{k}" for k in ks])
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.coalesce(F.try_divide(F.col(f"h{k}").cast("double"), F.col("n_truth").cast("double")), F.lit(0.0)).alias("recall"),
                (F.col(f"h{k}") > 0).cast("double").alias("hit"),
                F.coalesce(F.when(F.col("first") <= k, 1.0 / F.col("first")), F.lit(0.0)).alias("rr"),
            )
            for k in ks
        ]
    )
    return per.select(F.explode(rows).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.avg("x.recall").alias("recall"), F.avg("x.hit").alias("hit"), F.avg("x.rr").alias("mrr"))
