"""Token counts of a unigram vocabulary: Aho-Corasick matches, and dynamic programming over score and count only."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kohort.llm import workers
from kohort.session import ship

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # below the least score of the vocabulary
CACHE_BYTES = 96 << 20
NORMAL, BYTE = 1, 6  # kinds of pieces in a .model file


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """``(piece, score, kind)`` of a sentencepiece .model file, read as protocol buffer fields."""

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = raw[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while at < len(raw):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or varint()
                yield tag >> 3, raw[at : at + size]
                at += size

    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            out.append((own[1].decode("utf-8"), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


class Counter:
    """Counts the pieces of the best segmentation.

    The score of a segmentation is the sum of its pieces' scores in double precision; an unknown character counts
    UNKNOWN_PENALTY less than the least score. Of equal sums at a position the one whose last piece is longest stays.
    Unknown characters are spelt in bytes, one piece each, if the vocabulary has all bytes, else a run of them is one piece.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        normal = {p: s for p, s, kind in pieces if kind == NORMAL and p}
        self.fallback = sum(kind == BYTE for _, _, kind in pieces) == 256
        self.unknown = min(normal.values(), default=0.0) - UNKNOWN_PENALTY
        self.machine = ahocorasick.Automaton()
        for p, s in normal.items():
            self.machine.add_word(p, (len(p), s))
        if normal:
            self.machine.make_automaton()
        # Sums of whole numbers are exact, so that words can be counted apart if no piece reaches into a next word.
        self.apart = SPACE in normal and all(s == int(s) for s in normal.values()) and not any(SPACE in p.lstrip(SPACE) for p in normal)
        self.word = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.done: dict[str, int] = {}
        self.held = 0

    def close(self) -> None:
        self.done.clear()

    def count_unit(self, unit: str) -> int:
        n = len(unit)
        score, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0

        def settle(upto: int) -> None:
            """Positions without a match ending there."""
            nonlocal at
            while at < upto:
                at += 1
                step(at, ())

        def step(end: int, found) -> None:
            best, number, single = None, 0, False
            for length, s in found:  # longest first
                single |= length == 1
                total = score[end - length] + s
                if best is None or total > best:
                    best, number = total, count[end - length] + 1
            is_unk = False
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, is_unk = total, True
                    number = count[end - 1] + (len(unit[end - 1].encode("utf-8", "surrogatepass")) if self.fallback else not unk[end - 1])
            score[end], count[end], unk[end] = best, number, is_unk

        found: list = []
        if len(self.machine):
            for last, match in self.machine.iter(unit):
                if found and last + 1 != at + 1:
                    step(at + 1, found)
                    at += 1
                    found = []
                if not found:
                    settle(last)
                found.append(match)
            if found:
                step(at + 1, found)
                at += 1
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        """Of a text whose spaces are read as SPACE, with one more before it; an empty text has none."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self.count_unit(text)
        total, done = 0, self.done
        for unit in self.word.findall(text):
            n = done.get(unit)
            if n is None:
                n = self.count_unit(unit)
                if len(unit) <= 64:
                    if self.held > CACHE_BYTES:
                        done.clear()
                        self.held = 0
                    done[unit] = n
                    self.held += 130 + len(unit)
            total += n
        return total


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens`` for each row: pieces of the best segmentation of the whole text.

    The scores are those of the file. A file of a byte-pair vocabulary has merge ranks there, negative whole numbers: they are
    taken as unigram scores, and the counts are then those of that unigram model, not of the byte-pair tokenizer.

    path: a .model file that every worker can read. A null or empty text has 0; a repeated row gives a row of its own.
    No shuffle; a worker keeps at most CACHE_BYTES of words it has counted, and the programme of a text holds three
    numbers for each character.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = workers.hold(("viterbi", path), lambda: Counter(load_pieces(path)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.count(x.as_py() or "") for x in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")
