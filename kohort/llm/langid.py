"""Language mixtures of documents: expectation-maximisation over character n-grams, languages by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm import workers
from kohort.session import ship

BUCKETS = 1 << 15  # hashed n-grams of a language model
ORDER = 3  # characters of an n-gram
MAX_LANGUAGES = 512  # bounds the broadcast: MAX_LANGUAGES * BUCKETS floats
PIECE = 1 << 19  # characters worked on at a time, so that a long text needs no more memory
ROUNDS = 200  # of expectation-maximisation at most; it ends where no proportion moves by SETTLED
SETTLED = 1e-4
SMOOTHING = 0.5


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct hashed n-grams of a whole text with their counts; None without a letter.

    Letters are lower-cased, every run of other characters is one space, and an n-gram holds a letter in its middle.
    """
    if not text:
        return None
    total, keep = None, np.empty(0, np.uint32)
    for at in range(0, len(text), PIECE):
        part = text[at : at + PIECE].lower()
        code = np.concatenate([keep, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)])
        last = at + PIECE >= len(text)
        letter = _is_letter(code)
        code = np.where(letter, code, 32)
        space = code == 32
        lone = np.ones(len(code), bool)
        lone[1:] = ~(space[1:] & space[:-1])
        code = code[lone]
        if not at:
            code = np.concatenate([np.array([32], np.uint32), code])
        if last:
            code = np.concatenate([code, np.array([32], np.uint32)])
        keep = code[-2:]
        if len(code) < ORDER:
            continue
        c = code.astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        h = h[code[1:-1] != 32].astype(np.int64)
        if len(h):
            found = np.bincount(h, minlength=BUCKETS)
            total = found if total is None else total + found
    if total is None:
        return None
    ids = np.flatnonzero(total)
    return ids, total[ids]


_LETTERS: np.ndarray | None = None


def _is_letter(code: np.ndarray) -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS[code]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, n-gram), from all rows of docs (``text, lang``) with both.

    Counts are summed inside each partition before they are shuffled; BUCKETS sums a language reach the driver.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                if (got := ngram_counts(text.as_py())) is not None:
                    row = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                    row[got[0]] += got[1]
        for lang, row in sums.items():
            ids = np.flatnonzero(row)
            yield pa.record_batch({"lang": pa.array([lang] * len(ids), pa.string()), "gram": pa.array(ids, pa.int32()), "n": pa.array(row[ids], pa.int64())})

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds {MAX_LANGUAGES}")
    table = np.full((max(1, len(langs)), BUCKETS), SMOOTHING)
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        table[[at[x] for x in sums.column("lang").to_pylist()], sums.column("gram").to_numpy()] += sums.column("n").to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the languages (rows of p) for n-grams with counts n, and the log likelihood."""
    share, total = start, n.sum()
    for _ in range(rounds):
        mix = share @ p
        new = share * (p @ (n / mix)) / total
        settled = np.abs(new - share).max() < SETTLED
        share = new
        if settled:
            break
    return share, float(n @ np.log(share @ p))


def infer(ids: np.ndarray, n: np.ndarray, logp: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions over all languages of a document.

    Languages join one at a time, of those towards which the likelihood rises the one with which it ends highest, while it
    gains more than half of log(n-grams) for the parameter (BIC); each step refits by expectation-maximisation.
    """
    p = logp[:, ids].astype(np.float64)
    p = np.exp(p - p.max(0))  # relative to the best language of each n-gram: constant in every comparison
    n = n.astype(np.float64)
    single = np.log(np.maximum(p, 1e-300)) @ n
    best = int(single.argmax())
    chosen, share, like = [best], np.ones(1), float(single[best])
    penalty = 0.5 * np.log(max(2.0, n.sum()))
    while len(chosen) < len(p):
        mix = share @ p[chosen]
        gain = p @ (n / mix) / n.sum()  # over 1: more of this language would raise the likelihood
        gain[chosen] = 0
        if gain.max() <= 1 or like + penalty >= 0:  # 0 is the likelihood if each n-gram had its best language
            break
        start = np.append(share * 0.9, 0.1)
        tried = [(*_em(p[[*chosen, new]], n, start, rounds), int(new)) for new in np.flatnonzero(gain > 1)]
        wider, more, new = max(tried, key=lambda x: x[1])
        if more - like <= penalty:
            break
        chosen, share, like = [*chosen, new], wider, more
    out = np.zeros(len(p))
    out[chosen] = share
    return out


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with ``lang_pred``, ``score`` and ``mixture`` (language to proportion, those chosen).

    lang_pred is the language with the greatest proportion (ties: the first by name), score its proportion from 0 to 1.
    A null text, one without letters, or a model without languages give ``und`` and 0 with an empty mixture. No shuffle;
    each row by itself, whole texts in pieces of PIECE characters.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast((langs, logp))
    fields = [docs.schema[c] for c in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        langs, logp = model.value
        for batch in batches:
            pred, score, mixed = [], [], []
            for text in batch.column(len(keep)):
                got = ngram_counts(text.as_py()) if langs else None
                if got is None:
                    pred.append("und"), score.append(0.0), mixed.append([])
                    continue
                share = infer(*got, logp)
                top = int(share.argmax())
                pred.append(langs[top]), score.append(float(min(1.0, share[top])))
                mixed.append([(langs[i], float(share[i])) for i in np.flatnonzero(share > 1e-6)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], names=[*keep, "lang_pred", "score", "mixture"]
            )

    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, lang_pred string, score double, mixture map<string,double>")


def held_out(doc_id: str = "doc_id"):
    """True for documents that are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, mixture`` for each row; learned from rows that are not held out."""
    langs, logp = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.withColumn("held_out", held_out()), langs, logp, ("doc_id", "held_out"))
