"""Removal of long repeated byte strings with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm import workers
from kohort.llm.dealing import BYTE_VALUES, LOW, SPREAD, counts_of, deal, gathered, key_of, mix, pack, power, shared, spread, squeeze, stretch, unpack
from kohort.session import ship, shuffle_partitions

LENGTH = 50  # bytes of a match
GRAM = 24  # bytes of an anchor
CHUNK = 1 << 18  # bytes hashed at a time
BATCH = 1 << 16  # suffixes of a new suffix array
GROUP_ANCHORS = 1 << 19  # anchors that one task gathers
HOT = 1 << 14  # occurrences from which the windows of an anchor go to tasks of their own
NONE = np.iinfo(np.int64).max  # stands for a null doc_id: after all others

_POS = np.uint64((1 << 21) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash of GRAM = 16 + 8 bytes at each position."""
    h = BYTE_VALUES[data]
    eight = None
    for n in (1, 2, 4, 8):
        h = h[:-n] * power(n) + h[n:]
        eight = h if n == 4 else eight
    h = h[: len(data) - GRAM + 1] * power(8) + eight[16 : len(data) - GRAM + 17]
    return mix(h)


def anchored(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, hash, grams)``: runs of windows in texts of the given sizes that stand one after the other in data.

    Each window of length bytes inside one text belongs to the leftmost of its least GRAM-byte hashes, its anchor; a run
    is the windows next to each other with the same anchor. Equal windows have equal anchors at equal offsets, wherever
    they stand. first and last are window starts; grams are the hashes at every position.
    """
    windows = len(data) - length + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    spot = np.empty(windows, np.int32)
    grams = np.empty(len(data) - GRAM + 1, np.uint64)
    width = length - GRAM + 1
    for at in range(0, windows, CHUNK):
        h = _gram_hashes(data[at : at + CHUNK + length - 1])
        grams[at : at + len(h)] = h
        m, n = (h & ~_POS) | np.arange(len(h), dtype=np.uint64), 1
        while n * 2 <= width:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        if n < width:
            m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
        spot[at : at + len(m)] = (m & _POS).astype(np.int32) + np.int32(at)
    ends = np.cumsum(sizes)
    edge = np.zeros(len(data) + 1, np.int32)  # windows that reach into the next text
    np.add.at(edge, np.maximum(ends - sizes, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    spot[np.cumsum(edge[:windows]) > 0] = -1
    start = np.flatnonzero(np.diff(spot, prepend=-1))
    stop = np.append(start[1:], windows) - 1
    inside = spot[start] >= 0
    start, stop = start[inside], stop[inside]
    return start, stop, grams[spot[start]], grams


class SuffixLevels:
    """Suffix arrays of sizes that grow geometrically.

    A level is a sorted array of distinct suffixes, each cut at length bytes, with the least document that has it. A new
    batch gets a suffix array, is merge-scanned against every level for matches of length bytes, and becomes a level;
    while the last level is as large (to a power of two) as the one before, the two merge.
    """

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _array(suffixes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        return ranked[first], np.minimum.reduceat(docs[order], first)

    @staticmethod
    def _look(level: tuple[np.ndarray, np.ndarray], suffixes: np.ndarray) -> np.ndarray:
        """The least document of each of the sorted suffixes in a level, NONE without a match."""
        at = np.minimum(np.searchsorted(level[0], suffixes), len(level[0]) - 1)
        return np.where(level[0][at] == suffixes, level[1][at], NONE)

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The least document so far that has each suffix, this batch included."""
        if not len(suffixes):
            return np.empty(0, np.int64)
        own = self._array(suffixes, docs)
        least = own[1].copy()
        for level in self.levels:
            np.minimum(least, self._look(level, own[0]), out=least)
        out = least[np.searchsorted(own[0], suffixes)]
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-1][0]).bit_length() >= len(self.levels[-2][0]).bit_length():
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append(self._array(np.concatenate([a, b]), np.concatenate([x, y])))
        return out


def _joined(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a bucket, one after the other, and their sizes."""
    texts = own.column("text").combine_chunks()
    ends = texts.offsets.to_numpy() if isinstance(texts, pa.LargeBinaryArray) else np.asarray(pa.Array.from_buffers(pa.int32(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset))
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, np.diff(ends).astype(np.int64)


def _ids(own: pa.Table) -> np.ndarray:
    return own.column("doc_id").fill_null(NONE).to_numpy()


class _Runs:
    """The runs of a bucket whose anchor occurs elsewhere, and the records that stand for them.

    A record is anchor key, number of windows and content in a fixed width; distinct and sorted, so that every stage
    numbers them alike. A record whose anchor stands in hot and more texts is asked for window by window, each keyed by its
    own hash, so that no anchor brings all its texts to one task.
    """

    def __init__(self, own: pa.Table, known: pa.Table, groups: int, length: int, hot: int):
        keys, counts = gathered(known)
        self.data, self.sizes = _joined(own)
        first, last, codes, _ = anchored(self.data, self.sizes, length)
        key = key_of(codes, groups)
        n = counts_of(key, keys, counts)
        self.first, last, key, n = (x[n >= 2] for x in (first, last, key, n))
        self.size = last - self.first + length
        self.doc = _ids(own)[np.searchsorted(np.cumsum(self.sizes), self.first, side="right")]
        content = 2 * length - GRAM
        rows = np.empty((len(key), 9 + content), np.uint8)
        rows[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 8] = self.size - length + 1
        place = np.arange(content)
        for at in range(0, len(key), 1 << 15):
            part = slice(at, at + (1 << 15))
            rows[part, 9:] = np.where(place < self.size[part, None], self.data[np.minimum(self.first[part, None] + place, len(self.data) - 1)], 0)
        records, self.of = _distinct(rows)
        del rows
        self.windows = records[:, 8].astype(np.int64)
        seen = np.zeros(len(records), np.int64)
        seen[self.of] = n
        self.hot = seen >= hot
        spans = self.windows[self.hot]
        self.begin = np.zeros(len(records), np.int64)  # of a hot record's windows in asked_by_window
        self.begin[self.hot] = np.cumsum(spans) - spans
        self.parent = np.repeat(np.flatnonzero(self.hot), spans)
        offset = np.arange(len(self.parent)) - self.begin[self.parent]
        single = np.zeros((len(self.parent), 9 + content), np.uint8)
        if len(single):
            flat = np.ascontiguousarray(records[self.hot, 9:]).ravel()
            at = np.repeat(np.arange(len(spans)), spans) * content + offset
            grams, far = _gram_hashes(flat), length - GRAM
            code = key_of(mix(grams[at] + mix(grams[at + far // 2] + mix(grams[at + far]))), groups)
            single[:, :8] = code.astype(">u8").view(np.uint8).reshape(-1, 8)
            single[:, 8] = 1
            single[:, 9 : 9 + length] = np.lib.stride_tricks.sliding_window_view(flat, length)[at]
        self.asked, of = _distinct(np.concatenate([records[~self.hot], single]))
        cool = len(of) - len(single)
        self.asked_by_record = np.full(len(records), -1)
        self.asked_by_record[~self.hot] = of[:cool]
        self.asked_by_window = of[cool:]

    def least(self) -> np.ndarray:
        """The least document of the bucket for each record that is asked for."""
        low = np.full(len(self.windows), NONE)
        np.minimum.at(low, self.of, self.doc)
        out = np.full(len(self.asked), NONE)
        out[self.asked_by_record[~self.hot]] = low[~self.hot]
        np.minimum.at(out, self.asked_by_window, low[self.parent])
        return out

    def removed(self, whole: np.ndarray, seen: np.ndarray, length: int) -> np.ndarray:
        """Which bytes go, from the least document of each record asked for and the windows that stand in earlier ones."""
        cool = ~self.hot[self.of]
        first, size, doc, at = (x[cool] for x in (self.first, self.size, self.doc, self.asked_by_record[self.of]))
        gone = doc > whole[at]
        starts, sizes = [first[gone]], [size[gone]]
        first, bits = first[~gone], seen[at[~gone]]
        for j in range(length - GRAM + 1):
            some = first[bits >> np.uint64(j) & np.uint64(1) > 0] + j
            starts.append(some), sizes.append(np.full(len(some), length))
        run = np.flatnonzero(~cool)
        spans = self.windows[self.of[run]]
        run = np.repeat(run, spans)
        j = np.arange(len(run)) - np.repeat(np.cumsum(spans) - spans, spans)
        some = self.doc[run] > whole[self.asked_by_window[self.begin[self.of[run]] + j]]
        starts.append((self.first[run] + j)[some]), sizes.append(np.full(int(some.sum()), length))
        starts, sizes = np.concatenate(starts), np.concatenate(sizes)
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes, -1)
        return np.cumsum(edge[:-1]) > 0


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of bytes, and for each row the number of its equal."""
    if not len(rows):
        return rows, np.empty(0, np.int64)
    flat = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    found, of = np.unique(flat, return_inverse=True)
    return found.view(np.uint8).reshape(-1, rows.shape[1]), of.ravel()


def _key_of_records(records: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(records[:, :8]).view(">u8").ravel().astype(np.uint64)


def _repeats(dealt: tuple[DataFrame, int, int], length: int, hot: int) -> tuple[DataFrame, int]:
    """For each bucket the anchors that it shares and, for its records in order, what is known of them elsewhere."""
    rows, _, total = dealt
    groups = max(shuffle_partitions(rows.sparkSession), math.ceil(total / (length - GRAM + 2) * 2 / GROUP_ANCHORS))

    def anchors(table: pa.Table) -> pa.Table:
        workers.drop()
        data, sizes = _joined(table)
        first, _, codes, _ = anchored(data, sizes, length)
        # An anchor counts once a text: order by text and hash, then by hash.
        text = np.searchsorted(np.cumsum(sizes), first, side="right").astype(np.uint64)
        order = np.lexsort((codes, text))
        codes, text = codes[order], text[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
        codes, n = np.unique(codes[new], return_counts=True)
        return spread(codes, n, table.column("bucket")[0].as_py(), groups)

    common = rows.groupBy("bucket").applyInArrow(anchors, SPREAD).groupBy("grp").applyInArrow(shared, SPREAD)

    def contents(own: pa.Table, known: pa.Table) -> pa.Table:
        """Each record once, with the least document of the bucket that has it, packed by group."""
        out: dict[str, list] = {"grp": [], "bucket": [], "codes": [], "sizes": [], "content": [], "docs": []}
        if own.num_rows and known.num_rows:
            runs = _Runs(own, known, groups, length, hot)
            records, least = runs.asked, runs.least()
            key = _key_of_records(records)
            size = records[:, 8]
            grp = (key >> np.uint64(40)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(grp, prepend=-1)), len(grp))
            inside = np.arange(records.shape[1] - 9) < size[:, None].astype(np.int64) + length - 1
            bucket = own.column("bucket")[0].as_py()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                out["grp"].append(int(grp[a])), out["bucket"].append(bucket), out["codes"].append(pack(key[a:b] & LOW)), out["sizes"].append(size[a:b].tobytes())
                out["content"].append(squeeze(records[a:b, 9:][inside[a:b]])), out["docs"].append(squeeze(least[a:b]))
        return pa.table({c: pa.array(v, pa.int32() if c in ("grp", "bucket") else pa.binary()) for c, v in out.items()})

    def resolve(table: pa.Table) -> pa.Table:
        """The least document of each record, and the windows of its least document's run that stand in an earlier one.

        Equal records of all buckets collapse; where an anchor has differing ones, batches of their suffixes go through
        the levels in the order of documents.
        """
        grp = table.column("grp")[0].as_py()
        parts, docs, width = [], [], 9 + 2 * length - GRAM
        for codes, sizes, content, d in zip(*(table.column(c).to_pylist() for c in ("codes", "sizes", "content", "docs"))):
            size = np.frombuffer(sizes, np.uint8)
            rows = np.zeros((len(size), width), np.uint8)
            rows[:, :8] = (unpack(codes) | np.uint64(grp << 40)).astype(">u8").view(np.uint8).reshape(-1, 8)
            rows[:, 8] = size
            rows[:, 9:][np.arange(width - 9) < size[:, None].astype(np.int64) + length - 1] = stretch(content, np.uint8)
            parts.append(rows)
            docs.append(stretch(d, np.int64))
        records, of = _distinct(np.concatenate(parts))
        counts = [len(x) for x in parts]
        del parts
        whole = np.full(len(records), NONE)
        np.minimum.at(whole, of, np.concatenate(docs))
        key = _key_of_records(records)
        same = np.diff(key) == 0
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        queue = np.flatnonzero(several)
        queue = queue[np.argsort(whole[queue], kind="stable")]
        n_windows = records[queue, 8].astype(np.int64)
        ends = np.cumsum(n_windows)
        levels, at, hits = SuffixLevels(length), 0, []
        while at < len(queue):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH)))
            own, n = queue[at:upto], n_windows[at:upto]
            which = np.repeat(np.arange(len(own)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat = np.ascontiguousarray(records[own, 9:]).ravel()
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, length)[which * (width - 9) + offset]).view(f"S{length}").ravel()
            hit = levels.add(suffixes, whole[own][which]) < whole[own][which]
            hits.append((own[which[hit]], offset[hit]))
            at = upto
        record, offset = (np.concatenate(x) for x in zip(*hits)) if hits else (np.empty(0, np.int64), np.empty(0, np.int64))
        bits = np.zeros(len(records), np.uint64)  # a record has length - GRAM + 1 windows at most
        np.bitwise_or.at(bits, record, np.uint64(1) << offset.astype(np.uint64))
        least, seen = [], []
        for a, b in zip((np.cumsum(counts) - counts).tolist(), np.cumsum(counts).tolist()):
            least.append(squeeze(whole[of[a:b]])), seen.append(squeeze(bits[of[a:b]]))
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "codes": pa.array([None] * table.num_rows, pa.binary()), "counts": pa.array([None] * table.num_rows, pa.binary()), "least": pa.array(least, pa.binary()), "seen": pa.array(seen, pa.binary())})

    runs = rows.groupBy("bucket").cogroup(common.groupBy("bucket")).applyInArrow(contents, "grp int, bucket int, codes binary, sizes binary, content binary, docs binary")
    told = runs.groupBy("grp").applyInArrow(resolve, SPREAD + ", least binary, seen binary")
    return common.select("*", F.lit(None).cast("binary").alias("least"), F.lit(None).cast("binary").alias("seen")).union(told), groups


def _removed(own: pa.Table, told: pa.Table, groups: int, length: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a bucket's texts, their sizes, and which bytes go."""
    is_known = told.column("codes").is_valid()
    answers = told.filter(pc.invert(is_known)).sort_by("grp")
    if not answers.num_rows:
        data, sizes = _joined(own)
        return data, sizes, np.zeros(len(data), bool)
    runs = _Runs(own, told.filter(is_known), groups, length, hot)
    whole, seen = (np.concatenate([stretch(x, kind) for x in answers.column(c).to_pylist()]) for c, kind in (("least", np.int64), ("seen", np.uint64)))
    return runs.data, runs.sizes, runs.removed(whole, seen, length)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), as_text: bool = False, hot: int = HOT) -> DataFrame:
    """The columns of keep with ``n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row; kept is the text left, as bytes.

    as_text: kept is a string, without the bytes of characters that a cut parts (an uncut text, null too, is itself).

    Texts are UTF-8 bytes, null counts as empty. Every byte covered by a string of length bytes that also starts in a
    document with a smaller doc_id goes; overlaps count, strings are judged on the input, matches never cross documents.
    Rows with the same doc_id are not each other's smaller document; a null doc_id comes after all others. Texts
    shorter than length stay. An empty table gives no rows.

    Plan: rows are dealt evenly into buckets of BUCKET_BYTES. Each window of length bytes belongs to its anchor, the
    least GRAM-byte hash in it; anchors (about one for 14 bytes, four bytes each, made distinct in their bucket) are
    counted by hash, and only runs of windows whose anchor occurs twice go on, so that unique text is shuffled once.
    Distinct runs of a bucket meet others by anchor, packed in one row for a bucket and a group of anchors (a passage in
    a third of all documents is one record for each bucket); differing ones go through SuffixLevels. What comes back is
    the least document of each record and a bit for each window; no place in a text is ever shuffled.
    """
    if not GRAM < length <= 63 + GRAM:
        raise ValueError(f"length is from {GRAM + 1} to {63 + GRAM} bytes")
    ship(docs.sparkSession)
    dealt = deal(docs, keep)
    rows = dealt[0]
    told, groups = _repeats(dealt, length, hot)

    def trimmed(own: pa.Table, answers: pa.Table) -> pa.Table:
        data, sizes, gone = _removed(own, answers, groups, length, hot)
        out: list[list] = [[] for _ in range(5)]
        ends = np.cumsum(sizes)
        was_null = own.column("was_null").to_pylist()
        for a, b, null in zip((ends - sizes).tolist(), ends.tolist(), was_null):
            mask = gone[a:b]
            removed = int(mask.sum())
            if removed:
                edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
                cuts = [a, *(edge + a).tolist(), b]
                parts = [data[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2])]
                kept, n = b"".join(parts), len(edge) // 2
            else:
                kept, n = data[a:b].tobytes(), 0
                parts = [kept]
            digest = hashlib.sha256(kept).hexdigest()
            if as_text:  # each part alone: bytes of two parts make no character
                kept = None if null else "".join(p.decode("utf-8", "ignore") for p in parts)
            for x, v in zip(out, (b - a, removed, n, digest, kept)):
                x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
        more = [own.column(f"k{i}") for i in range(len(keep))]
        return pa.Table.from_arrays([*more, *(pa.array(v, k) for v, k in zip(out, kinds))], names=[f"k{i}" for i in range(len(keep))] + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if as_text else "binary")
    found = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(trimmed, schema)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
