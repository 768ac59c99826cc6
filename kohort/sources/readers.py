"""Scans. Each returns a keyed DataFrame; strict ones raise on rows that break the contract."""

from __future__ import annotations

import configparser
import os
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions.scalars import MISSING, category, first_present, norm_id, strip
from kohort.operators.ordering import numbered
from kohort.operators.validation import ContractError, duplicate_ids, require
from kohort.session import ship

# Category fields of a case and where they stand.
CATEGORY_PATHS = {
    "actor_main_type": "event_annotation.actor_main_type", "ai_risk_type": "ai_risk.ai_risk_type", "harm_type": "ai_risk.harm_type", "harm_severity": "ai_risk.harm_severity",
    "affected_actor_type": "ai_risk.affected_actor_type", "realized_or_potential": "ai_risk.realized_or_potential", "risk_stage": "ai_risk.risk_stage",
}


def gold_csv(spark: SparkSession, path: str, report_key: str = "report_id", event_key: str = "gold_v2_event_id") -> DataFrame:
    """``report_id, event_id``; a byte order mark is fine, missing columns, empty ids, repeated reports and no rows raise."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := {report_key, event_key} - set(df.columns):
        raise ContractError(f"missing columns {sorted(missing)}")
    out = df.select(norm_id(report_key).alias("report_id"), norm_id(event_key).alias("event_id"))
    require(out.where("coalesce(report_id, '') = '' or coalesce(event_id, '') = ''"), "empty ids")
    require(duplicate_ids(out, "report_id"), "repeated reports")
    if out.isEmpty():
        raise ContractError("no rows")
    return out


def gold_structure(spark: SparkSession, path: str) -> DataFrame:
    """``id, incident`` of ``{"events": [{"incident_id", "ids"}]}``; an id in several incidents keeps the last."""
    df = spark.read.schema("events array<struct<incident_id string, ids array<string>>>").option("multiLine", True).json(path)
    long = df.select(F.posexplode("events").alias("pos", "e")).select("pos", norm_id("e.incident_id").alias("incident"), F.explode("e.ids").alias("id"))
    return long.groupBy(norm_id("id").alias("id")).agg(F.max_by("incident", "pos").alias("incident"))


def gold_partition(gold: DataFrame, report: str = "report_id", event: str = "event_id") -> DataFrame:
    """``event_id, size, members``: the reports of each event in order."""
    return gold.groupBy(event).agg(F.count("*").alias("size"), F.array_sort(F.collect_list(report)).alias("members"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, value``: each line that is not blank, with its number from 0 in its file, blank lines counted."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    placed = numbered(raw, ["path", "_block", "_at"], "_n")
    first = placed.groupBy("path").agg(F.min("_n").alias("_first"))
    return placed.join(F.broadcast(first), "path").where(F.trim("value") != "").select("path", (F.col("_n") - F.col("_first")).alias("line_no"), "value")


def jsonl_schema(spark: SparkSession, path: str) -> str:
    """What Spark's own reader infers, in the JVM."""
    return spark.read.json(path).drop("_corrupt_record").schema.simpleString()


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of lines that are no objects; blank lines are ignored."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select("value", F.from_json("value", schema or jsonl_schema(spark, path), {"mode": "PERMISSIVE"}).alias("x"), F.try_parse_json("value").alias("v"))
    fine = F.col("v").isNotNull() & F.trim("value").startswith("{")
    return parsed.where(fine).select("x.*"), parsed.where(~fine).select("value")


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def json_cases(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Cases of a file that is a JSON list, or an object whose ``cases`` is one."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.explode("cases").alias("c")).select("c.*") if df.columns == ["cases"] else df


def _falsy(v: Column) -> Column:
    """A JSON value that counts as no id: absent, null, false, the number 0, an empty string, list or object."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return v.isNull() | F.is_variant_null(v) | F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double") == 0).otherwise(text.isin("[]", "{}"))


def identified(numbered_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, line_no, id, value`` of JSON-lines cases, and ``path, line_no, value, why`` of the lines set aside.

    The id is the first of id and original_id that is there and no null, empty string, false or number 0 (the string "0" is
    an id), else the number of the line; lines that are no objects, or whose id is blank, are set aside and shift no numbers.
    """
    v = numbered_lines.withColumn("v", F.try_parse_json("value"))
    v = v.withColumn("object", F.col("v").isNotNull() & F.trim("value").startswith("{"))
    for c in ("id", "original_id"):
        v = v.withColumn(f"_{c}", F.when(F.col("object"), F.try_variant_get("v", f"$.{c}", "variant")))
    text = lambda c: F.when(~F.coalesce(_falsy(F.col(c)), F.lit(True)), F.try_variant_get(c, "$", "string"))
    v = v.withColumn("id", F.when(F.col("object"), norm_id(F.coalesce(text("_id"), text("_original_id"), F.col("line_no").cast("string")))))
    good = F.col("object") & (F.col("id") != "")
    bad = v.where(~good).select("path", "line_no", "value", F.when(F.col("v").isNull(), "no JSON").when(~F.col("object"), "no object").otherwise("blank id").alias("why"))
    return v.where(good).select("path", "line_no", "id", "value"), bad


def case_id(df: DataFrame, line_no: str | None = None) -> Column:
    """The first of id and original_id that is neither null, an empty string nor the number 0, else the line's number.

    df: parsed rows; line_no: a column with the number of the line (see lines); without it such rows have a null id.
    """

    def usable(c: str) -> Column:
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        return F.when(F.col(c) != 0 if numeric else F.col(c).cast("string") != "", F.col(c).cast("string"))

    last = F.col(line_no).cast("string") if line_no else F.lit(None).cast("string")
    return strip(F.coalesce(*[usable(c) for c in ("id", "original_id") if c in df.columns], last))


def case_categories(cases: DataFrame) -> DataFrame:
    """``id`` and seven category tokens; of repeated ids the last row stays, and all rows without an id share ''."""
    rows = cases.withColumn("_at", F.monotonically_increasing_id())
    fields = [category(F.col(p)).alias(n) for n, p in CATEGORY_PATHS.items()]
    return rows.select(F.coalesce(norm_id("id"), F.lit("")).alias("id"), F.struct(*fields).alias("c"), "_at").groupBy("id").agg(F.max_by("c", "_at").alias("c")).select("id", "c.*")


# Fields of a case for inference, and the one that is a list.
INFERENCE_FIELDS = (
    "actor_main_type", "domain", "event_type", "event_cause", "event_process", "event_result", "ai_risk_description", "ai_risk_type", "ai_risk_subtype",
    "harm_type", "harm_severity", "affected_actor_type", "affected_actor_subtype", "realized_or_potential", "risk_stage",
)


def inference_cases(rows: DataFrame, key: str = "news_id", systems: str = "ai_system_type_list", renamed: dict[str, str] | None = None) -> DataFrame:
    """``id`` and sixteen tokens: a null is MISSING, a blank text stays as it is, and of a list the first element counts.

    renamed: field to the column it stands in, where they differ. No rows raise.
    """
    from_ = lambda f: F.col((renamed or {}).get(f, f)).cast("string")
    if isinstance(rows.schema[systems].dataType, T.ArrayType):
        first = F.coalesce(F.get(systems, F.lit(0)).cast("string"), F.lit(MISSING))
    else:
        listed = F.try_parse_json(systems)
        is_list = F.coalesce(F.schema_of_variant(listed).startswith("ARRAY"), F.lit(False))
        first = F.when(is_list, F.coalesce(F.try_variant_get(listed, "$[0]", "string"), F.lit(MISSING))).otherwise(F.coalesce(F.col(systems), F.lit(MISSING)))
    out = rows.select(norm_id(key).alias("id"), first.alias("ai_system_type"), *[F.coalesce(from_(f), F.lit(MISSING)).alias(f) for f in INFERENCE_FIELDS])
    if out.isEmpty():
        raise ContractError("no cases")
    return out


_CANDIDATE = "case_id string, candidate_id string, score_text double, score_event double, score_fuse double"
_RECALL = f"ground_truth array<string>, candidates array<struct<{_CANDIDATE}>>"


def _first_key(v: Column, *names: str) -> Column:
    """The value under the first of several keys that is there at all, be it null."""
    out = None
    for n in names:
        there = F.try_variant_get(v, f"$.{n}", "variant")
        value = F.try_variant_get(v, f"$.{n}", "string")
        out = F.when(there.isNotNull(), value) if out is None else out.when(there.isNotNull(), value)
    return out


def _recall_rows(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    text = spark.read.text(path).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    return text.select(norm_id(_first_key(v, *keys)).alias("query_id"), F.from_json("value", _RECALL).alias("x"), F.monotonically_increasing_id().alias("_at")).select("query_id", "_at", "x.*")


def _ranked(rows: DataFrame, top_m: int) -> DataFrame:
    """One row for each kept candidate, best fused score first, then as listed; a query without any has one with nulls."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    flat = rows.select("query_id", "ground_truth", F.posexplode_outer("candidates").alias("pos", "c"))
    flat = flat.select("query_id", "ground_truth", "pos", norm_id(F.coalesce("c.case_id", "c.candidate_id")).alias("candidate_id"), *[F.when(F.col("pos").isNotNull(), zero(f"c.{s}")).alias(s) for s in ("score_text", "score_event")], F.col("c.score_fuse").alias("score_fuse"))
    flat = flat.withColumn("score_fuse", F.coalesce("score_fuse", F.greatest("score_text", "score_event")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score_fuse"), "pos")
    return flat.withColumn("rank", F.when(F.col("pos").isNotNull(), F.row_number().over(best))).where(F.col("pos").isNull() | (F.col("rank") <= top_m))


def recall_jsonl(spark: SparkSession, path: str, top_m: int = 250) -> DataFrame:
    """``query_id, candidate_id, score_text, score_event, score_fuse, rank, ground_truth`` and least and greatest of each score.

    Null scores are 0, a missing fused score is the greater route; the order is fused score, then place in the list; least and
    greatest (``q_min``, ``q_max`` of the fused score, ``text_min`` and so on) are those of the kept top_m, 0 where there are none. A query without candidates
    keeps one row, with null candidate and rank. Repeated queries or candidates, empty ids and scores that are no numbers raise.
    """
    rows = _recall_rows(spark, path, "query_case_id", "query_id", "case_id")
    require(duplicate_ids(rows, "query_id"), "repeated or empty queries")
    every = _ranked(rows, 2**31 - 1)
    there = every.where("pos is not null")
    require(there.where("coalesce(candidate_id, '') = ''"), "empty candidate ids")
    require(there.groupBy("query_id", "candidate_id").count().where("count > 1"), "repeated candidates")
    number = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    require(there.where(~(number("score_text") & number("score_event") & number("score_fuse"))), "scores that are no numbers")
    w = Window.partitionBy("query_id")
    kept = every.where(F.col("pos").isNull() | (F.col("rank") <= top_m)).drop("pos")
    for name, s in (("q", "score_fuse"), ("text", "score_text"), ("event", "score_event")):
        kept = kept.withColumns({f"{name}_min": F.coalesce(F.min(s).over(w), F.lit(0.0)), f"{name}_max": F.coalesce(F.max(s).over(w), F.lit(0.0))})
    return kept


def recall_lenient(spark: SparkSession, path: str, top_m: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (``query_id, candidate_id, score_text, score_event, score_fuse, rank``), truth (``query_id, candidate_id``), and
    least and greatest scores of each query that has candidates.

    A query that stands in several lines has the last one's lists, and least and greatest of that line alone (other
    implementations let earlier lines count there). Repeated candidates of a list stay.
    """
    rows = _recall_rows(spark, path, "query_case_id").where("query_id is not null")
    last = rows.groupBy("query_id").agg(F.max_by(F.struct("ground_truth", "candidates"), "_at").alias("x")).select("query_id", "x.*")
    kept = _ranked(last, top_m).where("pos is not null").select("query_id", "candidate_id", "score_text", "score_event", "score_fuse", "rank")
    truth = last.select("query_id", F.explode("ground_truth").alias("t")).select("query_id", norm_id("t").alias("candidate_id")).distinct()
    ends = kept.groupBy("query_id").agg(*[f(f"score_{n}").alias(f"{n}_{e}") for n in ("text", "event", "fuse") for e, f in (("min", F.min), ("max", F.max))])
    return kept, truth, ends


def scored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, candidate_id, probability`` of a JSON-lines score file, best of repeats; bad rows raise."""
    raw = spark.read.schema("query_id string, candidate_id string, probability double, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.select(norm_id("query_id").alias("query_id"), norm_id("candidate_id").alias("candidate_id"), "probability", "_bad")
    fine = F.col("_bad").isNull() & (F.col("query_id") != "") & (F.col("candidate_id") != "") & (F.col("query_id") != F.col("candidate_id")) & F.col("probability").between(0, 1) & ~F.isnan("probability")
    require(rows.where(~F.coalesce(fine, F.lit(False))), "bad score rows")
    return rows.groupBy("query_id", "candidate_id").agg(F.max("probability").alias("probability"))


def full_scores(spark: SparkSession, path: str, theta: float) -> tuple[DataFrame, DataFrame]:
    """All endpoints as nodes, and the pairs at theta and above, filtered before any shuffle."""
    raw = spark.read.schema("query string, candidate string, query_id string, candidate_id string, probability double, prob double").json(path)
    rows = raw.select(norm_id(first_present("query_id", "query")).alias("query_id"), norm_id(first_present("candidate_id", "candidate")).alias("candidate_id"), first_present("probability", "prob").alias("probability"))
    rows = rows.where("query_id <> '' and candidate_id <> '' and query_id <> candidate_id")
    nodes = rows.select(F.col("query_id").alias("node")).union(rows.select("candidate_id")).distinct()
    return nodes, rows.where((1.0 - F.col("probability")) <= (1.0 - theta) + 1e-12)


def fold_directory(spark: SparkSession, path: str) -> DataFrame:
    """``fold, split, incident_id`` of fold_XX/{train,dev,test}_incidents.json.

    Files that are no JSON lists of strings raise, and so do totals (n_folds, total_incidents) of fold_splits.json, where
    that is there, which the lists do not meet.
    """
    raw = spark.read.text(f"{path}/fold_*/*_incidents.json", wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    rows = raw.select("file", F.regexp_extract("file", r"fold_(\d+)/", 1).cast("int").alias("fold"), F.regexp_extract("file", r"/(\w+)_incidents\.json", 1).alias("split"), "value", F.from_json("value", "array<string>").alias("ids"))
    require(rows.where(F.col("ids").isNull() | ~F.trim(F.translate("value", "\n\r\t", "   ")).startswith("[")).select("file"), "files that are no lists")
    out = rows.select("fold", "split", F.explode("ids").alias("incident_id"))
    try:
        totals = spark.read.option("multiLine", True).schema("n_folds long, total_incidents long").json(f"{path}/fold_splits.json").first()
    except AnalysisException:  # not there
        return out
    found = out.agg(F.countDistinct("fold").alias("n_folds"), F.countDistinct("incident_id").alias("total_incidents")).first()
    for name in ("n_folds", "total_incidents"):
        if totals is not None and totals[name] is not None and totals[name] != found[name]:
            raise ContractError(f"{name} is {totals[name]}, the lists have {found[name]}")
    return out


ROWS = 4096  # of an array that a task reads at a time


def embedding_directory(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``position, id, vec, valid`` of case_ids.txt, emb_<field>.npy and valid_mask_<field>.npy; keyed from then on.

    The folder must be one that executors see: tasks map the array and read ranges of its rows. Only the ids and the header
    are read here; repeated ids, other row counts, and a mask that is neither [N] nor [N, 1] raise.
    """
    ids_path, emb_path, mask_path = (find_asset(path, n) for n in ("case_ids.txt", f"emb_{field}.npy", f"valid_mask_{field}.npy"))
    with open(ids_path, encoding="utf-8") as f:
        ids = [x.strip() for x in f if x.strip()]
    emb, mask = np.load(emb_path, mmap_mode="r"), np.load(mask_path, mmap_mode="r")
    if len(set(ids)) != len(ids) or emb.ndim != 2 or len(emb) != len(ids) or mask.shape not in ((len(ids),), (len(ids), 1)):
        raise ContractError(f"embedding files disagree: {len(ids)} ids ({len(set(ids))} different), vectors {emb.shape}, mask {mask.shape}")
    n, dim = emb.shape
    ship(spark)

    def read(batches):
        vectors, valid = np.load(emb_path, mmap_mode="r"), np.load(mask_path, mmap_mode="r").reshape(-1)
        for b in batches:
            for at in b.column(0).to_pylist():
                x = np.ascontiguousarray(vectors[at : at + ROWS], np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x))), lists, pa.array(valid[at : at + len(x)] > 0)], names=["position", "vec", "valid"])

    rows = spark.range(0, n, ROWS, max(1, -(-n // ROWS))).mapInArrow(read, "position long, vec array<float>, valid boolean")
    named = spark.createDataFrame(pa.table({"position": np.arange(n), "id": pa.array(ids, pa.string())}))
    return rows.join(named, "position").select("position", "id", "vec", "valid")


def find_asset(folder: str, name: str) -> str:
    """A file of that name, or with ``_full`` before its ending, in a folder or below it."""
    stem, ending = os.path.splitext(name)
    for top, _, files in sorted(os.walk(folder)):
        for x in (name, f"{stem}_full{ending}"):
            if x in files:
                return os.path.join(top, x)
    raise ContractError(f"no {name} in {folder}")


def npz_scores(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``query_id, candidate_id, probability, label`` of arrays qc, p and y, and ``why, n`` of the rows set aside.

    Arrays go over as Arrow, not as rows. Strict: self pairs, repeated pairs and scores out of range raise; lenient: they
    are dropped (of repeated pairs one with the greatest score stays) and counted.
    """
    with np.load(path) as z:
        qc, p = z["qc"], z["p"].astype(float)
        y = z["y"] if "y" in z.files else np.full(len(p), -1)
        if qc.shape != (len(p), 2) or len(y) != len(p):
            raise ContractError(f"arrays disagree: {qc.shape}, {p.shape}, {y.shape}")
        own = pa.table({"query_id": pa.array(qc[:, 0].astype(str)), "candidate_id": pa.array(qc[:, 1].astype(str)), "probability": p, "label": y.astype(np.int32)})
    df = spark.createDataFrame(own).withColumns({c: norm_id(c) for c in ("query_id", "candidate_id")})
    why = F.when(F.col("query_id") == F.col("candidate_id"), "self pair").when(F.isnan("probability") | ~F.col("probability").between(0, 1), "out of range")
    df = df.withColumn("why", why)
    copies = df.where("why is null").groupBy("query_id", "candidate_id").agg(F.count("*").alias("n"), F.max(F.struct("probability", "label")).alias("x"))
    if strict:
        require(df.where("why is not null"), "self pairs or scores out of range")
        require(copies.where("n > 1"), "repeated pairs")
    dropped = df.where("why is not null").groupBy("why").agg(F.count("*").alias("n")).union(copies.agg(F.lit("repeated").alias("why"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")))
    return copies.select("query_id", "candidate_id", "x.probability", "x.label"), dropped


def months(first: str, last: str) -> list[tuple[int, int]]:
    """(year, month) from first to last, both in, as YYYY-MM."""
    (a, b), (c, d) = (map(int, x.split("-")) for x in (first, last))
    date(a, b, 1), date(c, d, 1)
    return [(m // 12, m % 12 + 1) for m in range(a * 12 + b - 1, c * 12 + d)]


def scope_filter(classification: str | None = None, scope: list[tuple[int, int]] | None = None, class_col: str = "classification_result", year: str = "archive_year", month: str = "archive_month") -> Column:
    """Equality on class and archive months: prunes partitions, and is pushed down by JDBC."""
    out = F.lit(True)
    if classification is not None:
        out = out & (F.col(class_col) == classification)
    if scope:
        any_month = F.lit(False)
        for y, m in scope:
            any_month = any_month | ((F.col(year) == y) & (F.col(month) == m))
        out = out & any_month
    return out


def scope_months(mode: str, month: str | None = None, months_list: list[str] | None = None, first: str | None = None, last: str | None = None) -> list[tuple[int, int]] | None:
    """Months of a scope: ``full`` has none (all), ``month`` one, ``months`` a list without repeats, ``range`` all from first to last."""
    if mode == "full":
        return None
    if mode == "month" and month:
        return months(month, month)
    if mode == "months" and months_list:
        return sorted({months(m, m)[0] for m in months_list})
    if mode == "range" and first and last:
        return months(first, last)
    raise ContractError(f"a scope of {mode!r} lacks its months, or is unknown")


def count_scope(rows: DataFrame, **scope) -> int:
    """Rows of a scope (see scope_filter); a database counts them itself, a file format reads no columns but the filter's."""
    return rows.where(scope_filter(**scope)).count()


def load_config(path: str) -> configparser.ConfigParser:
    """An INI file, which must be there."""
    out = configparser.ConfigParser()
    with open(path, encoding="utf-8") as f:
        out.read_file(f)
    return out


def database_config(config: configparser.ConfigParser, section: str = "Database") -> dict[str, str | int]:
    """Host, port, database, user and password for jdbc; the password stands only in the variable that password_env names."""
    if section not in config:
        raise ContractError(f"no section {section}")
    own = config[section]
    needed = {k: own.get(k, "").strip() for k in ("host", "database", "user", "password_env")}
    if missing := [k for k, v in needed.items() if not v]:
        raise ContractError(f"{section} lacks {missing}")
    secret = os.environ.get(needed["password_env"], "")
    if not secret:
        raise ContractError(f"the variable {needed['password_env']} is not set")
    defaults = {k: own.get(k, "").strip() for k in ("classification_result", "source_relation")}
    return {**needed, "password": secret, "port": own.getint("port", 5432), **{k: v for k, v in defaults.items() if v}}


def config_path(value: str, base: str) -> str:
    """An absolute path as it is, another below base."""
    if not value.strip():
        raise ContractError("an empty path")
    return os.path.abspath(os.path.join(base, value.strip()))


def split_list(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


# Where a flat row of features goes in a nested case.
_EVENT = {"actor_main": "actor_main", "actor_main_type": "event_actor_main_type", **{f: f for f in ("ai_system", "domain", "event_type", "event_cause", "event_process", "event_result")}}
_RISK = ("ai_risk_description", "ai_risk_type", "ai_risk_subtype", "harm_type", "harm_severity", "affected_actor_type", "affected_actor_subtype", "realized_or_potential", "risk_stage")


def assemble_cases(gold: DataFrame, texts: DataFrame, features: DataFrame) -> DataFrame:
    """Nested cases for evaluation from three flat tables keyed by report_id; the gold's reports must be in both others.

    Empty features are null; ``{a,b}`` in ai_system_list becomes a list without empty parts. Ids are numbers.
    """
    keyed = lambda df: df.withColumn("report_id", norm_id("report_id"))
    gold, texts, features = keyed(gold), keyed(texts), keyed(features)
    for other, what in ((texts, "texts"), (features, "features")):
        require(gold.join(other, "report_id", "left_anti").select("report_id"), f"reports without {what}")
        require(duplicate_ids(other.join(gold.select("report_id"), "report_id", "left_semi"), "report_id"), f"repeated {what}")
    has = lambda df, c: F.col(f"{df}.{c}") if c in {"t": texts, "f": features}[df].columns else F.lit(None).cast("string")
    full = lambda c: F.when(has("f", c) != "", has("f", c))
    rows = gold.alias("g").join(texts.alias("t"), "report_id").join(features.alias("f"), "report_id")
    systems = F.filter(F.split(F.btrim(F.coalesce(has("f", "ai_system_list"), F.lit("")), F.lit("{}")), ","), lambda x: x != "")
    number = F.col("report_id").cast("long")
    empty = F.array().cast("array<string>")
    return rows.select(
        number.alias("id"), number.alias("original_id"),
        *[F.coalesce(has("t", c), F.lit("")).alias(c) for c in ("title", "title_first_line", "text")],
        F.lit(None).cast("string").alias("release_date"), F.coalesce(has("t", "source_url"), F.lit("")).alias("case_link"),
        F.struct(F.lit(None).cast("string").alias("event_time_start"), *[full(c).alias(k) for k, c in _EVENT.items()], empty.alias("actor_list")).alias("event_annotation"),
        F.struct(*[full(c).alias(c) for c in _RISK]).alias("ai_risk"),
        F.struct(systems.alias("ai_system_list"), empty.alias("ai_system_type_list"), empty.alias("ai_system_domain_list")).alias("ai_tech"),
        F.col("g.event_id").alias("gold_event_id"),
    )


def jdbc(spark: SparkSession, url: str, relation: str, partition: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, fetch: int = 2000, **options: str) -> DataFrame:
    """A relation of a database, read in parallel by a numeric column; secrets come in options or the environment."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", relation).option("fetchsize", fetch).options(**options)
    if partition and bounds:
        reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
