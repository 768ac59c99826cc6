"""A training corpus from documents: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.llm import bpe, decontaminate, jaccard, langid, suffixes
from kohort.llm.queries import BPE_FILE
from kohort.session import ensure_checkpoint_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.5  # share of a document's main language


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in COLUMNS]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters or no language with half of their n-grams; learned from rows not held out."""
    langs, logp = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    own = _columns(docs)
    kept = langid.predict(docs, langs, logp, tuple(own))
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the least doc_id, of rows with the same one the first."""
    own = _columns(docs)
    numbered = docs.select(*own, F.monotonically_increasing_id().alias("_row"))
    first = jaccard.join_components(numbered, uid="_row").where("uid = first_uid").select(F.col("uid").alias("_row"))
    return numbered.join(first, "_row", "left_semi").select(*own)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes repeated from earlier documents go; a document of which nothing is left goes, and so do cut characters."""
    own = _columns(docs)
    kept = suffixes.remove_repeats(docs, keep=tuple(c for c in own if c != "text"), as_text=True)
    kept = kept.where((F.col("n_removed") == 0) | (F.length("kept") > 0)).withColumnRenamed("kept", "text")
    if "n_chars" in own:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.select(*own)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of the benchmark."""
    own = _columns(docs)
    numbered = docs.select(*own, F.monotonically_increasing_id().alias("_row"))
    judged = decontaminate.decontaminate(numbered, table(spark, sf_dir, "benchmark"), uid="_row")
    return numbered.join(judged.where("contaminated").select("_row"), "_row", "left_anti").select(*own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests."""
    return bpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can express neither language mixtures nor byte-pair merges; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; only the last one's files stay."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what is written needs nothing of the stage before
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
