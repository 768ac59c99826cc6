"""Byte-level BPE: recursive DuckDB queries per partition."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kohort.llm import workers
from kohort.session import ship

PART_BYTES = 1 << 19  # of words that one recursive query contracts
PIECE = 1 << 21  # characters that are split into words at a time
ROWS = 1000  # worked on at a time
PIECE_IDS = 1 << 20  # that one aggregation decodes
CACHE_BYTES = 128 << 20  # of a worker's words that are done
STEP, OVERLAP = 240, 60  # bytes: a long word is contracted in stretches that overlap

#: One row is a token of a word at a position. Each round joins neighbours to the merge table, takes the first of the
#: pairs of least rank in every word and contracts it; a word without a pair comes out as it is and rests. Rank and
#: position are packed in one number, 32 bits for the position: no text has as many bytes.
CONTRACT = """
WITH RECURSIVE state(word, pos, tok, live) AS (
    SELECT word, pos, tok, true FROM start
  UNION ALL
    (WITH paired AS MATERIALIZED (
        SELECT p.word, p.pos, p.tok, p.prv, m.made * 4294967296 + p.pos AS pair
        FROM (SELECT word, pos, tok, lead(tok) OVER w AS nxt, lag(pos) OVER w AS prv FROM state WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)) p
        LEFT JOIN merges m ON p.tok = m.a AND p.nxt = m.b
    ), least AS (SELECT word, min(pair) AS best FROM paired GROUP BY word)
    SELECT word, pos, CASE WHEN best = pair THEN best // 4294967296 ELSE tok END, best IS NOT NULL
    FROM paired JOIN least USING (word) WHERE best IS NULL OR prv IS NULL OR prv <> best % 4294967296)
)
SELECT word, list(tok ORDER BY pos) AS toks FROM state WHERE NOT live GROUP BY word
"""

DECODE = "SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS text FROM given JOIN vocabulary USING (id) GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes words by rank (a word that is a token is that token, else its bytes are contracted) and decodes ids."""

    def __init__(self, path: str, pattern: str | None = None):
        import duckdb

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern) if pattern is not None else None
        size = 1 + max(self.ranks.values())
        bytes_of = [b""] * size
        for token, rank in self.ranks.items():
            bytes_of[rank] = token
        self.width = np.array([len(x) for x in bytes_of], np.int64)
        # One thread, and no folder to spill to: parts are small, and a worker's disk is not for data.
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        # A byte is the character of its number, but for 0, which text in SQL had better not hold.
        self._table("vocabulary", pa.table({"id": np.arange(size, dtype=np.int32), "piece": [x.decode("latin-1").replace("\0", "\u0100") for x in bytes_of]}))
        if pattern is not None:
            pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
            a, b, made = zip(*pairs) if pairs else ((), (), ())
            self._table("merges", pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "made": pa.array(made, pa.int64())}))
            self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.done: dict[str, bytes] = {}
        self.held = 0

    def close(self) -> None:
        self.db.close()
        self.done.clear()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.db.unregister("rows")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("start", pa.table({"word": np.repeat(np.arange(len(words)), lengths), "pos": np.arange(len(flat)) - first, "tok": self.single[flat]}))
        got = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("start")
        out = [b""] * len(words)
        toks = got.column("toks").combine_chunks()
        ids, ends = toks.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), toks.offsets.to_numpy()
        ends = (4 * (ends - ends[0])).tolist()
        for i, w in enumerate(got.column("word").to_pylist()):
            out[w] = ids[ends[i] : ends[i + 1]]
        return out

    def _stitch(self, begins: list[int], parts: list[np.ndarray]) -> np.ndarray | None:
        """The ids of a word from those of stretches that overlap; None if two of them have no token in common there.

        A sequence of tokens is the encoding of its bytes if and only if each two neighbours are that of theirs: up to
        the first contraction across a boundary of the sequence, all go on inside its tokens, in the order in which they
        would for the two neighbours alone, which would hence make that contraction too. So two encodings that share a
        token, one up to it and the other from it, together are the encoding of all bytes.
        """
        out, spans = parts[0], begins[0] + np.cumsum(self.width[parts[0]])
        for begin, part in zip(begins[1:], parts[1:]):
            ends = begin + np.cumsum(self.width[part])
            tail = int(np.searchsorted(spans, begin, side="right"))
            mine = {(e - int(self.width[t]), e): i for i, (e, t) in enumerate(zip(spans[tail:].tolist(), out[tail:].tolist()), tail)}
            for j, (e, t) in enumerate(zip(ends.tolist(), part.tolist())):
                i = mine.get((e - int(self.width[t]), e))
                if i is not None:
                    out, spans = np.concatenate([out[: i + 1], part[j + 1 :]]), np.concatenate([spans[: i + 1], ends[j + 1 :]])
                    break
            else:
                return None
        return out

    def _encode_words(self, words: list[bytes], step: int = STEP) -> list[bytes]:
        """Words of any length in time about linear in it."""
        parts = [w for w in words if len(w) <= step + OVERLAP]
        begins = [range(0, len(w) - OVERLAP, step) for w in words if len(w) > step + OVERLAP]
        long = [w for w in words if len(w) > step + OVERLAP]
        parts += [w[a : a + step + OVERLAP] for w, at in zip(long, begins) for a in at]
        done = iter(self._encode_parts(parts))
        out = [next(done) if len(w) <= step + OVERLAP else b"" for w in words]
        stitched = (self._stitch(list(at), [np.frombuffer(next(done), "<u4") for _ in at]) for at in begins)
        for i in (i for i, w in enumerate(words) if len(w) > step + OVERLAP):
            got = next(stitched)
            out[i] = self._encode_words([words[i]], step * 4)[0] if got is None else got.tobytes()
        return out

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """PART_BYTES at a time, parts of like lengths together: they need as many rounds."""
        out: list = [None] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        at = 0
        while at < len(order):
            upto, n = at, 0
            while upto < len(order) and (upto == at or n + len(parts[order[upto]]) <= PART_BYTES):
                n += len(parts[order[upto]])
                upto += 1
            for i, ids in zip(order[at:upto], self._contract([parts[i] for i in order[at:upto]])):
                out[i] = ids
            at = upto
        return out

    def learn(self, words: set[str]) -> None:
        """Contract words that are not known yet."""
        rest: list[tuple[str, bytes]] = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is None:
                rest.append((w, raw))
            else:
                self.done[w] = rank.to_bytes(4, "little")
        self.done.update(zip([w for w, _ in rest], self._encode_words([raw for _, raw in rest])))
        self.held += sum(map(len, words)) + 150 * len(words)

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text; those of a long one some at a time."""
        if len(text) <= PIECE:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(itertools.islice(found, PIECE // 8)):
            yield part

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        new: set[str] = set()
        for words in split:
            new.update(words)
        if self.held > CACHE_BYTES:
            self.done.clear()
            self.held = 0
        new -= self.done.keys()
        self.learn(new)
        get = self.done.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            upto, n = at, 0
            while upto < len(texts) and (upto == at or n + len(texts[upto]) <= PIECE):
                n += len(texts[upto])
                upto += 1
            if upto == at + 1:
                out.append(b"".join(self._ids([words])[0] for words in self._words(texts[at])))
            else:
                out += self._ids([self.pattern.findall(t) for t in texts[at:upto]])
            at = upto
        return out

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids: they join the vocabulary, and an aggregation puts pieces in the order of positions."""
        out = [b""] * len(texts)
        counts = np.fromiter((len(x) // 4 for x in texts), np.int64, len(texts))
        flat = np.frombuffer(b"".join(texts), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        for at in range(0, len(flat), PIECE_IDS):
            part = slice(at, at + PIECE_IDS)
            self.db.register("given", pa.table({"doc": doc[part], "pos": np.arange(len(flat[part]), dtype=np.int32), "id": flat[part]}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("given")
            for i, text in zip(got.column("doc").to_pylist(), got.column("text")):
                out[i] += text.as_py().replace("\u0100", "\0").encode("latin-1")
        return out


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids`` array<int> if keep_ids) for each row.

    path: a .tiktoken file that every worker can read; pattern: what parts a text into words. Words are encoded apart,
    without special tokens. A null text is empty: no tokens, and the digests of nothing. Ties of a rank cannot occur;
    of equal pairs the leftmost is contracted. A repeated row gives a row of its own. No rows give no rows.

    Plan: no shuffle; words of PIECE characters are made distinct, new ones are contracted by recursive queries of
    PART_BYTES, a word longer than STEP in stretches. A worker keeps CACHE_BYTES of words from task to task.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            coder = workers.hold(("bpe", path, pattern), lambda: Coder(path, pattern))
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = coder.encode([x or "" for x in batch.column(1).to_pylist()])
                cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, coder.decode(ids)), pa.string())]
                if keep_ids:
                    cols.append(_as_lists(ids))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _as_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` (bytes) for each row of ``doc_id, ids`` (array<int>).

    Null or no ids give no bytes; a null among them, or a number that the vocabulary hasn't, counts as nothing.
    """
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            coder = workers.hold(("bpe", path, None), lambda: Coder(path))
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [np.array([-1 if i is None else i for i in x or ()], "<i4").tobytes() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(ids), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")
