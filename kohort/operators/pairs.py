"""Pair tables, negatives, folds and pair features."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohort.functions.scalars import MISSING, category_equal, cosine, minmax_norm
from kohort.operators.ordering import numbered
from kohort.operators.validation import ContractError
from kohort.session import cut

# Order of the wide features.
EQUAL_FIELDS = ("actor_main_type", "ai_risk_type", "harm_type", "harm_severity", "affected_actor_type", "realized_or_potential", "risk_stage")
SIMILAR_FIELDS = ("actor_main", "ai_system", "domain", "event_type", "event_cause", "event_process", "event_result", "ai_risk_description", "ai_risk_subtype", "affected_actor_subtype")


SCORES = ("score_text", "score_event", "score_fuse")
# Seeds of the sampling for the three splits of fold 0; fold n adds n.
SPLIT_SEEDS = {"train": 42, "dev": 1042, "test": 2042}


def _scaled(candidates: DataFrame, top_m: int) -> DataFrame:
    """The kept candidates with null scores as 0 and each score scaled by the least and greatest of its query."""
    w = Window.partitionBy("query_id")
    kept = candidates.where(F.col("rank") <= top_m)
    for s in SCORES:
        kept = kept.withColumn(s, F.coalesce(s, F.lit(0.0)))
        kept = kept.withColumn(f"{s}_norm", minmax_norm(s, F.min(s).over(w), F.max(s).over(w)))
    return kept


def _label(pairs: DataFrame, truth: DataFrame | None) -> DataFrame:
    """Adds ``label``: 1 for a pair of truth (query_id, candidate_id), or without truth for one incident on both sides."""
    if truth is None:
        return pairs.withColumn("label", (F.col("q_inc") == F.col("c_inc")).cast("int"))
    marked = pairs.join(truth.select("query_id", "candidate_id").distinct().withColumn("_good", F.lit(1)), ["query_id", "candidate_id"], "left")
    return marked.withColumn("label", F.coalesce("_good", F.lit(0))).drop("_good")


_PAIR = ("query_id", "candidate_id", "label", *SCORES, *(f"{s}_norm" for s in SCORES), "q_inc", "c_inc")


def build_pairs(candidates: DataFrame, incidents: DataFrame, allowed: DataFrame | None = None, top_m: int = 200, truth: DataFrame | None = None) -> DataFrame:
    """Recalled pairs whose both sides have an incident of the split, labelled and scaled.

    candidates: query_id, candidate_id, score_text, score_event, score_fuse, rank; incidents: id, incident; allowed: incident.
    Label 1 means a pair of truth (query_id, candidate_id) or, where that is not given, the same incident. Scaling is by the
    least and greatest score of a query's kept top_m candidates.
    """
    if allowed is not None:
        incidents = incidents.join(allowed.select("incident").distinct(), "incident", "left_semi")
    kept = _scaled(candidates, top_m)
    q, c = incidents.select(F.col("id").alias("query_id"), F.col("incident").alias("q_inc")), incidents.select(F.col("id").alias("candidate_id"), F.col("incident").alias("c_inc"))
    return _label(kept.join(q, "query_id").join(c, "candidate_id"), truth).select(*_PAIR)


def sample_training(pairs: DataFrame, ratio: int = 4, empty: int = 10, max_empty: int | None = None, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """All positives; of negatives, by fused score, ratio for each positive of the query, or empty where it has none.

    max_empty: queries without a positive that take part at most, the first in seeded hash order. by: columns (a fold)
    inside which queries stand apart.
    """
    w = Window.partitionBy(*by, "query_id")
    n = pairs.withColumn("n_pos", F.sum("label").over(w))
    if max_empty is not None:
        none = n.where("n_pos = 0").select(*by, "query_id").distinct().withColumn("_h", F.xxhash64("query_id", F.lit(seed)))
        if by:
            some = none.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "query_id"))).where(F.col("_r") <= max_empty)
        else:
            some = none.orderBy("_h", "query_id").limit(max_empty)
        n = n.where("n_pos > 0").unionByName(n.where("n_pos = 0").join(some.select(*by, "query_id"), [*by, "query_id"], "left_semi"))
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy(*by, "query_id", "label").orderBy(F.desc("score_fuse"), "candidate_id")))
    return ranked.where((F.col("label") == 1) | (F.col("r") <= F.when(F.col("n_pos") > 0, F.col("n_pos") * ratio).otherwise(empty))).drop("n_pos", "r")


def fallback_negatives(pool: DataFrame, pairs: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """k pool members, all scores 0, for each pool member without a pair; rows are like those of build_pairs.

    pool: id and, for q_inc and c_inc, incident. Members stand in a ring in hash order and a query takes the k after it:
    chosen by seed, without listing all pairs. Hash order stands in for a seeded shuffle.
    """
    inc = F.col("incident") if "incident" in pool.columns else F.lit(None).cast("string")
    ring = cut(numbered(pool.select("id", inc.alias("incident")).dropDuplicates(["id"]), [F.xxhash64("id", F.lit(seed)), "id"], "at"))
    total = ring.count()
    alone = ring.join(pairs.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
    steps = F.sequence(F.lit(1), F.lit(min(k, total - 1))) if min(k, total - 1) > 0 else F.array().cast("array<int>")
    asks = alone.select(F.col("id").alias("query_id"), F.col("incident").alias("q_inc"), "at", F.explode(steps).alias("step"))
    asks = asks.select("query_id", "q_inc", F.pmod(F.col("at") + F.col("step"), F.lit(max(1, total))).alias("at"))
    found = asks.join(ring.select("at", F.col("id").alias("candidate_id"), F.col("incident").alias("c_inc")), "at")
    zeros = [F.lit(0.0).alias(c) for s in SCORES for c in (s, f"{s}_norm")]
    return found.select("query_id", "candidate_id", F.lit(0).alias("label"), *zeros, "q_inc", "c_inc").select(*_PAIR)


def prepare_folds(candidates: DataFrame, cases: DataFrame, splits: DataFrame, truth: DataFrame | None = None, top_m: int = 200, ratio: int = 4, empty: int = 10) -> DataFrame:
    """``fold, split`` and the columns of build_pairs: pairs of every fold and split in one plan, the fold being a column.

    cases: id, incident; splits: fold, split, incident. Both sides of a pair are in the split. Train is sampled as by
    sample_training, and its cases without a pair get fallback negatives; dev and test are whole.
    """
    kept = _scaled(candidates, top_m)
    q, c = cases.select(F.col("id").alias("query_id"), F.col("incident").alias("q_inc")), cases.select(F.col("id").alias("candidate_id"), F.col("incident").alias("c_inc"))
    placed = kept.join(q, "query_id").join(c, "candidate_id")
    own = splits.select("fold", "split", "incident")
    placed = placed.join(own.withColumnRenamed("incident", "q_inc"), "q_inc").join(own.withColumnRenamed("incident", "c_inc"), ["fold", "split", "c_inc"])
    labelled = cut(_label(placed, truth).select("fold", "split", *_PAIR))
    train = labelled.where("split = 'train'")
    out = sample_training(train, ratio, empty, by=("fold",)).unionByName(labelled.where("split <> 'train'"))
    for fold in sorted(r.fold for r in own.select("fold").distinct().collect()):  # a handful
        pool = cases.join(own.where((F.col("fold") == fold) & (F.col("split") == "train")).select("incident"), "incident", "left_semi")
        more = fallback_negatives(pool, train.where(F.col("fold") == fold), empty, SPLIT_SEEDS["train"] + int(fold))
        out = out.unionByName(more.select(F.lit(fold).alias("fold"), F.lit("train").alias("split"), *_PAIR))
    return out


def split_incidents(ids: DataFrame, seed: int = 42, shares: tuple[float, float] = (0.7, 0.1), key: str = "incident") -> DataFrame:
    """``incident, split``: train, dev and test by place in seeded hash order; each share is rounded down, test takes the rest."""
    placed = cut(numbered(ids.select(key).distinct(), [F.xxhash64(key, F.lit(seed)), key], "at"))
    n = placed.count()
    a, b = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    return placed.select(key, F.when(F.col("at") < a, "train").when(F.col("at") < b, "dev").otherwise("test").alias("split"))


def random_repeats(ids: DataFrame, repeats: int = 5, seed: int = 42, shares: tuple[float, float] = (0.6, 0.2), key: str = "incident") -> DataFrame:
    """``repeat, incident, split`` for several seeds, a thousand apart."""
    out = None
    for r in range(1, repeats + 1):
        one = split_incidents(ids, seed + 1000 * (r - 1), shares, key).withColumn("repeat", F.lit(r))
        out = one if out is None else out.union(one)
    return out.select("repeat", key, "split")


def make_folds(sizes: DataFrame, n_folds: int = 5, seed: int = 42, most: int = 1_000_000, key: str = "incident") -> DataFrame:
    """``fold, split, incident``: incidents (with ``n`` cases) go, in seeded order, each to the fold with the fewest cases.

    Fold i is tested, the next one is dev, the rest train. The dealing is a sequence by nature and runs on the driver over
    sorted ids, so that it depends on nothing but them and the seed; more than ``most`` incidents raise.
    """
    rows = sorted(tuple(r) for r in sizes.select(key, "n").limit(most + 1).collect())
    if len(rows) > most:
        raise ContractError(f"more than {most} incidents")
    random.Random(seed).shuffle(rows)
    load = [(0, i) for i in range(n_folds)]
    where = []
    for incident, n in rows:
        fewest, fold = heapq.heappop(load)
        heapq.heappush(load, (fewest + n, fold))
        where.append((incident, fold))
    kind = sizes.schema[key].dataType.simpleString()
    placed = sizes.sparkSession.createDataFrame(where, f"{key} {kind}, _home int").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    step = F.pmod(F.col("_home") - F.col("fold"), F.lit(n_folds))
    return placed.select("fold", F.when(step == 0, "test").when(step == 1, "dev").otherwise("train").alias("split"), key)


def vocabulary(df: DataFrame, fields: list[str], missing: bool = True) -> DataFrame:
    """``field, token, code``: tokens of each field in order, from 0; MISSING is among them if missing is set."""
    each: list[Column] = [F.struct(F.lit(f).alias("field"), F.col(f).alias("token")) for f in fields]
    long = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("token is not null").distinct()
    if missing:
        always = df.sparkSession.createDataFrame([(f, MISSING) for f in fields], "field string, token string")
        long = long.union(always).distinct()
    return long.withColumn("code", F.row_number().over(Window.partitionBy("field").orderBy("token")) - 1)


def wide_features(pairs: DataFrame, cases: DataFrame, equal: tuple[str, ...] = EQUAL_FIELDS, similar: tuple[str, ...] = SIMILAR_FIELDS, key: str = "id", dim: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """eq_<field> for categories, then sim_<field>: cosine where both vectors are there, else 0.

    keep: fields of cases that come out as they are, as q_<field> and c_<field>, so that a later step need not join again.
    """
    sides = [cases.select(F.col(key).alias(side), *[F.col(f).alias(f"{p}{f}") for f in dict.fromkeys([*equal, *similar, *keep])]) for side, p in (("query_id", "q_"), ("candidate_id", "c_"))]
    out = pairs.join(sides[0], "query_id", "left").join(sides[1], "candidate_id", "left")
    return out.select(*pairs.columns, *[category_equal(f"q_{f}", f"c_{f}").alias(f"eq_{f}") for f in equal], *[cosine(f"q_{f}", f"c_{f}", dim).alias(f"sim_{f}") for f in similar], *[F.col(f"{p}{f}") for p in ("q_", "c_") for f in keep])
