"""Contracts of ids, domains, partitions and splits: each returns offending rows, or raises with ``require``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions.scalars import norm_id


class ContractError(ValueError):
    """Input that breaks a contract."""


def require(bad: DataFrame, what: str) -> None:
    """Raise with a few of the offending rows, if there are any."""
    if some := bad.limit(10).collect():
        raise ContractError(f"{what}: {[tuple(r) for r in some]}")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(norm_id(key).alias(key)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull() | (F.col(key) == ""))


def domain_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(norm_id(key).alias(key)).distinct(), right.select(norm_id(key).alias(key)).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def candidate_violations(pairs: DataFrame, nodes: DataFrame, query: str = "query_id", candidate: str = "candidate_id", node: str = "node") -> DataFrame:
    """Self pairs, candidates out of the domain, and nodes that ask nothing; ids are compared stripped."""
    pairs = pairs.select(norm_id(query).alias(query), norm_id(candidate).alias(candidate))
    nodes = nodes.select(norm_id(node).alias(node))
    known = nodes.select(F.col(node).alias("_n")).distinct()
    own = pairs.where(F.col(query) == F.col(candidate)).select(F.col(query).alias("id"), F.lit("self").alias("why"))
    out = pairs.join(known, F.col(candidate) == F.col("_n"), "left_anti").select(F.col(candidate).alias("id"), F.lit("candidate outside").alias("why"))
    ask = pairs.join(known, F.col(query) == F.col("_n"), "left_anti").select(F.col(query).alias("id"), F.lit("query outside").alias("why"))
    mute = known.join(pairs.select(F.col(query).alias("_n")).distinct(), "_n", "left_anti").select(F.col("_n").alias("id"), F.lit("no query").alias("why"))
    return own.union(out).union(ask).union(mute).distinct()


def recall_domain(pairs: DataFrame, nodes: DataFrame, query: str = "query_id", candidate: str = "candidate_id", node: str = "node") -> DataFrame:
    """One row: queries, directed pairs and nodes, after the contract holds."""
    require(candidate_violations(pairs, nodes, query, candidate, node), "candidates break the domain")
    return pairs.agg(F.countDistinct(query).alias("queries"), F.count("*").alias("directed_pairs")).crossJoin(nodes.agg(F.countDistinct(node).alias("nodes")))


def partition_violations(partition: DataFrame, domain: DataFrame | None = None, report: str = "report_id", cluster: str = "cluster_id") -> DataFrame:
    """Reports in several clusters or without one, and differences from the domain."""
    per = partition.groupBy(report).agg(F.count("*").alias("n"), F.count(cluster).alias("named"))
    bad = per.where((F.col("n") > 1) | (F.col("named") == 0)).select(F.col(report).alias("id"), F.when(F.col("n") > 1, "overlap").otherwise("no cluster").alias("why"))
    if domain is not None:
        diff = domain_difference(domain.select(F.col(report)), partition.select(F.col(report)), report)
        bad = bad.union(diff.select(F.col(report).alias("id"), F.when(F.col("side") == "left", "missing").otherwise("extra").alias("why")))
    return bad


def canonical_partition(partition: DataFrame, report: str = "report_id", cluster: str = "cluster_id") -> DataFrame:
    """Clusters named by their least report: the same for every labelling. A cluster may hold any share of the rows; only minima are shuffled."""
    low = partition.groupBy(cluster).agg(F.min(report).alias("_low"))
    return partition.join(low, cluster).select(report, F.col("_low").alias(cluster))


def split_violations(splits: DataFrame, incidents: DataFrame | None = None, fold: str = "fold", split: str = "split", incident: str = "incident_id") -> DataFrame:
    """Incidents in two splits of a fold, tested in several folds or none, or missing from a fold."""
    twice = splits.groupBy(fold, incident).agg(F.count("*").alias("n")).where("n > 1").select(incident, F.lit("two splits of a fold").alias("why"))
    tested = splits.groupBy(incident).agg(F.count_if(F.col(split) == "test").alias("n"), F.countDistinct(fold).alias("folds"))
    folds = splits.agg(F.countDistinct(fold).alias("all"))
    bad = twice.union(tested.where("n <> 1").select(incident, F.lit("not tested once").alias("why")))
    bad = bad.union(tested.crossJoin(F.broadcast(folds)).where("folds <> all").select(incident, F.lit("missing from a fold").alias("why")))
    if incidents is not None:
        bad = bad.union(domain_difference(incidents, splits, incident).select(incident, F.lit("outside").alias("why")))
    return bad


def size_summary(gold: DataFrame, key: str) -> DataFrame:
    """One row: rows, groups, groups of one, and the greatest group."""
    sizes = gold.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


def split_cases(cases: DataFrame, incidents: DataFrame) -> DataFrame:
    """``id, incident`` of the cases in a split's incidents, each id once. cases: id, incident; incidents: incident."""
    kept = cases.join(incidents.select("incident").distinct(), "incident", "left_semi")
    return kept.select(norm_id("id").alias("id"), "incident").distinct()


def gold_clusters(cases: DataFrame, incidents: DataFrame, order: str | None = None) -> DataFrame:
    """``incident, members``: ids of each incident of a split without repeats, in the order of a column (else sorted)."""
    kept = cases.join(incidents.select("incident").distinct(), "incident", "left_semi")
    at = F.col(order) if order else F.lit(0)
    first = kept.groupBy("incident", norm_id("id").alias("id")).agg(F.min(at).alias("at"))
    return first.groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("members"))


def valid_queries(text: DataFrame, event: DataFrame, start: int = 0, end: int | None = None, key: str = "id") -> DataFrame:
    """Ids with a valid vector in both routes, in order, from start to before end. Inputs: id, valid."""
    from kohort.operators.ordering import numbered

    own = lambda df: df.where("valid").select(norm_id(key).alias(key))
    placed = numbered(own(text).intersect(own(event)), [key], "place").where(F.col("place") >= start)
    return (placed if end is None else placed.where(F.col("place") < end)).select(key, "place")


def filter_pairs(rows: DataFrame, cases: DataFrame, embedded: DataFrame | None = None, top_m: int = 250) -> DataFrame:
    """Pairs of nested candidates as stored: the first top_m of each list, then those whose both ids are known.

    rows: query_id, candidates array<struct<candidate_id, score_fuse, score_text, score_event>>; cases, embedded: id.
    Scores are put into [0, 1]; what is no number is 0. No order is made: the list's own counts.
    """
    from kohort.functions.scalars import clip01

    long = rows.select(norm_id("query_id").alias("query_id"), F.posexplode(F.slice("candidates", 1, top_m)).alias("place", "c"))
    long = long.select("query_id", "place", norm_id("c.candidate_id").alias("candidate_id"), *[clip01(f"c.{s}").alias(f"{s}_norm") for s in ("score_fuse", "score_text", "score_event")])
    known = cases.select(norm_id("id").alias("id"))
    if embedded is not None:
        known = known.intersect(embedded.select(norm_id("id").alias("id")))
    known = known.distinct()
    for side in ("query_id", "candidate_id"):
        long = long.join(known.withColumnRenamed("id", side), side, "left_semi")
    return long.where("query_id <> candidate_id").select("query_id", "candidate_id", "place", "score_fuse_norm", "score_text_norm", "score_event_norm")


# The version of the metrics' meaning, and those that every report must have.
METRICS_VERSION = "2.0.0-directional"
BOUNDED_METRICS = ("hungarian_f1_g2p", "hungarian_f1_p2g", "hungarian_f1_symmetric", "induced_pair_f1", "b_cubed_f1", "ari", "nmi")


def require_metrics(values: dict, version: str = METRICS_VERSION) -> None:
    """Raise unless the version fits and each bounded metric is there and a number from -1 to 1."""
    if values.get("metrics_version") != version:
        raise ContractError(f"metrics of version {values.get('metrics_version')!r}, not {version!r}")
    bad = {k: values.get(k) for k in BOUNDED_METRICS if not isinstance(values.get(k), (int, float)) or not -1.0 <= values[k] <= 1.0}
    if bad:
        raise ContractError(f"metrics missing or out of range: {bad}")


def consistent(found: dict, wanted: dict, optional: tuple[str, ...] = ()) -> None:
    """Raise where the description of a checkpoint differs from that of the prepared data; an optional entry may be absent."""
    differ = {k: (found.get(k), v) for k, v in wanted.items() if found.get(k) != v and not (k in optional and (found.get(k) is None or v is None))}
    if differ:
        raise ContractError(f"found and wanted differ: {differ}")


def contiguity(gold: DataFrame, key: str, prefix: str, width: int = 4) -> DataFrame:
    """Numbers from 1 to the number of ids that no id has."""
    own = gold.select(F.col(key)).distinct()
    n = own.count()
    made = gold.sparkSession.range(1, n + 1).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), width, "0")).alias(key))
    return made.join(own, key, "left_anti")
