"""Benchmark decontamination by winnowing. Native: DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.session import cut

WINDOW = 10  # words of a window
KGRAM = 4  # words of a fingerprint; WINDOW - KGRAM + 1 fingerprints in a row share a window
#: Fingerprint rows of the benchmark (about 300 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20  # the same for item ids, as a common fingerprint may stand in any number of items

EDGES = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the quick way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_word_hashes(df: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``_h``: xxhash64 of each word. Gaps at the ends are trimmed first, so that only a text without words leaves an empty piece."""
    pieces = F.split(F.trim(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(EDGES)), GAP)
    df = df.select(*keep, pieces.alias("_p"))  # a column of its own: inside a lambda the split would run again
    none = F.array().cast(T.ArrayType(T.LongType()))
    return df.select(*keep, F.when(F.get("_p", F.lit(0)) != "", F.transform("_p", lambda w: F.xxhash64(w))).otherwise(none).alias("_h"))


def _winnowed(g: str, own: Column, p: Column) -> Column:
    """Whether the fingerprint own at p is the least of some WINDOW-KGRAM+1 fingerprints in a row (all of equal ones count).

    That is so if enough neighbours on both sides together, up to the first lesser one or the end, are not lesser.
    """
    side = WINDOW - KGRAM

    def run(step: int) -> Column:
        out = F.lit(side)
        for j in range(side, 0, -1):
            out = F.when(F.coalesce(F.get(g, p + step * j) >= own, F.lit(False)), out).otherwise(j - 1)
        return out

    return own.isNotNull() & (run(-1) + run(1) >= side)


def _fingerprints(df: DataFrame, keep: list[str], shorts: list[int], whole_short: bool) -> DataFrame:
    """One row of ``keep, n_words, _h, m, pos, fp`` for each fingerprint, and one with pos -1 for each row of df.

    m is WINDOW for winnowed k-grams; else it is the length of a window that is a whole short item.
    Lambdas run interpreted, so only the hashes of words and k-grams are made in arrays; positions are then rows, and choosing
    minima is compiled together with the join. A k-gram's hash is that of shifted halves: (w1 ^ w2 << 5) ^ (w3 ^ w4 << 5) << 10.
    """
    df = with_word_hashes(df, keep)
    join = lambda a, skip, bits: F.zip_with(a, F.slice(a, skip + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: x.bitwiseXOR(F.shiftleft(y, bits)))
    df = df.select(*keep, "_h", join("_h", 1, 5).alias("_two"))
    df = df.select(*keep, "_h", join("_two", 2, 10).alias("_g"))  # null where fewer words are left
    # explode_outer: a plain explode would have its argument pushed down as a filter, through all the steps above.
    df = df.select(*keep, F.size("_h").alias("n_words"), "_h", "_g", F.explode_outer(F.sequence(F.lit(-1), F.size("_h") - 1)).alias("pos"))
    p = F.col("pos")
    fp = F.get("_g", p)
    if not shorts:
        df = df.where((p < 0) | _winnowed("_g", fp, p))
        return df.select(*keep, "n_words", "_h", F.lit(WINDOW).alias("m"), "pos", fp.alias("fp"))
    kinds = [F.struct(F.lit(WINDOW).alias("m"), F.when((p < 0) | _winnowed("_g", fp, p), F.coalesce(fp, F.lit(0))).alias("fp"))]
    for m in shorts:
        fits = (p == 0) & (F.col("n_words") == m) if whole_short else (p >= 0) & (p + m <= F.col("n_words"))
        kinds.append(F.struct(F.lit(m).alias("m"), F.when(fits, F.xxhash64(F.lit(m), *[F.get("_h", p + j) for j in range(m)])).alias("fp")))
    df = df.select(*keep, "n_words", "_h", "pos", F.explode_outer(F.array(*kinds)).alias("f")).where(F.col("f.fp").isNotNull())
    return df.select(*keep, "n_words", "_h", F.col("f.m").alias("m"), "pos", F.col("f.fp").alias("fp"))


def _context(m: Column) -> Column:
    """The word hashes from WINDOW-KGRAM before a k-gram to as many after it; null for a short item's window."""
    side = WINDOW - KGRAM
    return F.when(m == WINDOW, F.array(*[F.get("_h", F.col("pos") + j) for j in range(-side, KGRAM + side)]))


def _run(side: list[Column]) -> Column:
    """How many of the conditions hold before the first that doesn't."""
    return reduce(lambda acc, ok: F.when(F.coalesce(ok, F.lit(False)), acc + 1).otherwise(0), reversed(side), F.lit(0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, uid: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of docs.

    docs: ``doc_id, text``; benchmark: ``item_id, text``. A window is WINDOW consecutive words of an item, or a shorter
    item as a whole; a document word inside any occurrence of a window is hit. Winnowing guarantees that a shared window
    holds a shared fingerprint; each such hit is extended by WINDOW-KGRAM words to either side by word hashes (64 bits a word) and
    counts if WINDOW words agree. Null or word-less texts have no words; items with a null id count under the name ''
    only if no other row has it; a repeated doc_id gives a row for each input row; repeated items count once by item_id.
    uid: a column of docs that numbers its rows and is returned too.

    Plan: one scan, one Generate, a join with the benchmark's fingerprints (broadcast behind a check of their number,
    shuffled beyond it) and one aggregation by row; no text is shuffled.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    lengths = with_word_hashes(bench, []).select(F.size("_h").alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct()
    shorts = sorted(r.n for r in lengths.collect())  # nine values at most
    prints = _fingerprints(bench, ["item"], shorts, True).where(F.col("pos") >= 0).select("item", F.col("m").alias("bm"), F.col("fp").alias("bfp"), _context(F.col("m")).alias("bctx"))
    prints = cut(prints.groupBy("bm", "bfp", "bctx").agg(F.collect_set("item").alias("items")))
    size = prints.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.array_join("items", ","))), F.lit(0)).alias("bytes")).first()
    small = size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES

    base = docs.select("doc_id", "text", (F.col(uid) if uid else F.monotonically_increasing_id()).alias("_row"))
    rows = _fingerprints(base, ["_row", "doc_id"], shorts, False)
    on = (F.col("fp") == F.col("bfp")) & (F.col("m") == F.col("bm")) & (F.col("pos") >= 0)
    if small:  # word hashes are looked up in their array after the join, which moves nothing
        met = rows.join(F.broadcast(prints), on, "left").where((F.col("pos") < 0) | F.col("bfp").isNotNull()).withColumn("ctx", _context(F.col("m")))
    else:  # rows of pos -1 get keys of their own, so as not to meet in one task
        key = F.when(F.col("pos") < 0, F.xxhash64("_row")).otherwise(F.col("fp"))
        rows = rows.select("_row", "doc_id", "n_words", "m", "pos", key.alias("fp"), _context(F.col("m")).alias("ctx"))
        met = rows.join(prints, on, "left").where((F.col("pos") < 0) | F.col("bfp").isNotNull())

    side = WINDOW - KGRAM
    # Compared in a lambda: matches are few, and code compiled for them would make the join's method too long for the JIT.
    same = F.zip_with("ctx", "bctx", lambda x, y: F.coalesce(x == y, F.lit(False)))
    met = met.withColumn("_same", F.when(F.col("ctx").isNotNull() & F.col("bctx").isNotNull(), same))
    agree = lambda i: F.get("_same", F.lit(i))
    left = _run([agree(i) for i in range(side - 1, -1, -1)])
    right = _run([agree(i) for i in range(side + KGRAM, KGRAM + 2 * side)])
    core = reduce(lambda x, y: x & y, [agree(i) for i in range(side, side + KGRAM)])
    met = met.withColumn("_l", F.when(F.col("m") == WINDOW, left).otherwise(0)).withColumn("_r", F.when(F.col("m") == WINDOW, right).otherwise(0))
    hit = F.col("bfp").isNotNull() & F.when(F.col("m") == WINDOW, core & (F.col("_l") + F.col("_r") + KGRAM >= WINDOW)).otherwise(F.lit(True))
    span = F.struct((F.col("pos") - F.col("_l")).alias("s"), (F.col("pos") + F.when(F.col("m") == WINDOW, F.lit(KGRAM)).otherwise(F.col("m")) + F.col("_r")).alias("e"))
    met = met.select("_row", "doc_id", "n_words", F.when(hit, span).alias("span"), F.when(hit, F.col("items")).alias("items"))
    per = met.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")), lambda acc, x: F.struct(F.greatest(acc["e"], x["e"]).alias("e"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["e"], x["s"]))).alias("n")))["n"]
    return per.select(
        *[F.col("_row").alias(uid)] if uid else [],
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
