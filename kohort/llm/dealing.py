"""Even buckets of whole texts, and numpy on bytes: shared by the joins on n-grams and on suffixes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 4 << 20  # of text in a bucket
GROUP_ITEMS = 1 << 20  # hashes that one task gathers

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64)
BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX1
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def deal(docs: DataFrame, keep: tuple[str, ...] = (), uid: str | None = None) -> tuple[DataFrame, int, int]:
    """``bucket, uid, doc_id, text, was_null, k0, k1 ...``, the number of buckets, and the bytes of text.

    A null text is empty. k0 and so on are the columns of keep. uid numbers the rows: a column of docs, or where none is
    given a number made here, which holds as long as docs is read in the same way (a table does).
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = docs.select(number.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("text").isNull().alias("was_null"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    return rows.select(F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int").alias("bucket"), "*"), buckets, total


def squeeze(values: np.ndarray) -> bytes:
    """Compressed, bytes of equal weight together."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b"")


def stretch(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 as differences: 4 bytes each where they fit."""
    gaps = np.diff(values, prepend=np.uint64(0))
    wide = bool(len(gaps)) and int(gaps.max()) >> 32 != 0
    return bytes([wide]) + squeeze(gaps.astype("<u8" if wide else "<u4"))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(stretch(blob[1:], "<u8" if blob[0] else "<u4").astype(np.uint64), dtype=np.uint64)


LOW = np.uint64((1 << 40) - 1)


def spread(codes: np.ndarray, counts: np.ndarray, bucket: int, groups: int) -> pa.Table:
    """Rows ``grp, bucket, codes, counts`` for distinct hashes of a bucket: by their high bits to a group, by 40 bits in it.

    Hashes that agree in group and 40 bits count as one; this can only keep more than needed.
    """
    grp = (codes >> np.uint64(40)) % np.uint64(groups)
    key = (grp << np.uint64(40)) | (codes & LOW)
    key, inverse = np.unique(key, return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, inverse, counts)
    grp = (key >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(grp, prepend=-1))
    ends = np.append(cuts[1:], len(key))
    return pa.table(
        {
            "grp": pa.array(grp[cuts], pa.int32()),
            "bucket": pa.array(np.full(len(cuts), bucket), pa.int32()),
            "codes": pa.array([pack(key[a:b] & LOW) for a, b in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([_pack_counts(sums[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
        }
    )


def _pack_counts(n: np.ndarray) -> bytes:
    return b"" if (n == 1).all() else squeeze(n.astype("<u4"))


def _unpack_counts(blob: bytes, size: int) -> np.ndarray:
    return stretch(blob, "<u4") if blob else np.ones(size, np.uint32)


SPREAD = "grp int, bucket int, codes binary, counts binary"


def shared(table: pa.Table) -> pa.Table:
    """Of a group's rows (SPREAD) those hashes whose counts sum to two and more, to each bucket that has them."""
    parts = [unpack(x.as_py()) for x in table.column("codes")]
    counts = [_unpack_counts(x.as_py(), len(p)) for x, p in zip(table.column("counts"), parts)]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(every))))
    out, at = [], 0
    for p in parts:
        n = total[at : at + len(p)]
        keep = n >= 2
        out.append((p[keep], n[keep]))
        at += len(p)
    rows = [i for i, (p, _) in enumerate(out) if len(p)]
    return pa.table(
        {
            "grp": table.column("grp").take(pa.array(rows, pa.int64())),
            "bucket": table.column("bucket").take(pa.array(rows, pa.int64())),
            "codes": pa.array([pack(out[i][0]) for i in rows], pa.binary()),
            "counts": pa.array([_pack_counts(np.minimum(out[i][1], 0xFFFFFFFF)) for i in rows], pa.binary()),
        }
    )


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (group and 40 bits) that a bucket shares with others or within itself, and their counts."""
    if not table.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, sums = [], []
    for g, c, n in zip(table.column("grp").to_pylist(), table.column("codes").to_pylist(), table.column("counts").to_pylist()):
        part = unpack(c)
        keys.append(part | np.uint64(g << 40))
        sums.append(_unpack_counts(n, len(part)).astype(np.int64))
    key, n = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(key)
    return key[order], n[order]


def key_of(codes: np.ndarray, groups: int) -> np.ndarray:
    return (((codes >> np.uint64(40)) % np.uint64(groups)) << np.uint64(40)) | (codes & LOW)


def counts_of(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each key, 1 where it is not among the known."""
    if not len(known):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 1)
