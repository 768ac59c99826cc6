"""Language mixtures and unigram counts against exhaustive search and the public library."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.llm import langid, viterbi
from tests.llm.test_operators import P, docs


def exhaustive(ids, n, logp):
    """The best set of languages by likelihood less half of log(n-grams) for each further one, plain EM to the end."""
    p = np.exp(logp[:, ids].astype(float))
    best = None
    for k in range(1, len(p) + 1):
        for some in itertools.combinations(range(len(p)), k):
            q, share = p[list(some)], np.full(k, 1 / k)
            for _ in range(3000):
                share = share * (q @ (n / (share @ q))) / n.sum()
            value = n @ np.log(share @ q) - 0.5 * np.log(max(2.0, n.sum())) * (k - 1)
            if best is None or value > best[0] + 1e-9:
                best = (value, some, share)
    return best


def test_mixtures_against_exhaustive_search():
    rng = np.random.default_rng(11)
    languages, grams = 5, 400
    table = rng.dirichlet(np.full(grams, 0.15), languages) + 1e-6
    logp = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    same = 0
    for trial in range(60):
        k = 1 + trial % 3
        some = rng.choice(languages, k, replace=False)
        share = rng.dirichlet(np.full(k, 3.0))
        counts = rng.multinomial(int(rng.choice([40, 200, 1500])), share @ np.exp(logp[some].astype(float)) / (share @ np.exp(logp[some].astype(float))).sum())
        ids = np.flatnonzero(counts)
        n = counts[ids].astype(float)
        value, chosen, want = exhaustive(ids, n, logp)
        got = langid.infer(ids, counts[ids], logp)
        assert np.isclose(got.sum(), 1)
        mine = np.flatnonzero(got > 0)
        own = n @ np.log(got[mine] @ np.exp(logp[mine][:, ids].astype(float))) - 0.5 * np.log(max(2.0, n.sum())) * (len(mine) - 1)
        assert own >= value - 0.6, trial  # steps may miss the very best set, by less than the penalty of one language
        if tuple(mine) == chosen:
            same += 1
            assert np.abs(got[list(chosen)] - want).max() < 0.03
    assert same >= 57


def test_language_odd_tables(spark):
    kind = "doc_id long, text string, lang string, held_out string, score string, `_row` int"
    rows = [(i, t, x, "h", "s", 1) for i, t, x in [(1, "the and of", "en"), (1, "the and of", "en"), (2, "der und die", "de"), (None, "der und die", "de"), (3, "the and of der und die", None), (4, "", "en"), (5, None, None)] * 3]
    got = langid.identify(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 21 and {r.lang_pred for r in got if r.doc_id == 1} == {"en"} and {r.lang_pred for r in got if r.doc_id in (4, 5)} == {"und"}
    assert len({str(r) for r in got if r.doc_id == 1}) == 1
    assert langid.identify(spark.createDataFrame([], kind)).count() == 0


def library(pieces, unk, fallback):
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.models.Unigram([("<unk>", unk)] + [(p, s) for p, s, _ in pieces], 0, fallback)


def test_counts_with_bytes(spark):
    pieces = viterbi.load_pieces(P.path("piece_bpe_32k.model"))
    normal = [x for x in pieces if x[2] == viterbi.NORMAL]
    with_bytes = [x for x in pieces if x[2] in (viterbi.NORMAL, viterbi.BYTE)]
    assert len(with_bytes) - len(normal) == 256
    # In the library bytes are pieces like others, so they get scores that no text can use.
    model = library([(p, s, k) if k == viterbi.NORMAL else (p, -1e9, k) for p, s, k in with_bytes], min(s for _, s, _ in normal), True)
    ours = viterbi.Counter(with_bytes)
    for t in ("plain words", "naïve 漢字 🙂🙂 mixed", "\x00\x01", "ᚠᚢ ᚦ", "🙂", "a🙂b🙂🙂"):
        assert ours.count(t) == len(model.tokenize("▁" + t.replace(" ", "▁"))), t


def test_counts_with_ties():
    rng = random.Random(12)
    for trial in range(40):
        found = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)}
        pieces = [(p, float(-rng.randint(1, 4)), viterbi.NORMAL) for p in sorted(found)]
        model = library(pieces, min(s for _, s, _ in pieces), False)
        ours = viterbi.Counter(pieces)
        for _ in range(30):
            t = "".join(rng.choices("abcx", k=rng.randint(1, 14)))
            assert ours.count_unit(t) == len(model.tokenize(t)), (trial, t, pieces)


def test_counts_odd_rows(spark):
    path = P.path("piece_bpe_32k.model")
    assert viterbi.count_tokens(docs(spark, []), path).count() == 0
    long = "word " * 300_000 + "x" * 100_000
    got = viterbi.count_tokens(docs(spark, ["a b", "a b", None, long], [1, 1, 2, 3]).withColumn("n_tokens", F.lit(1)), path).collect()
    assert sorted(r.n_tokens for r in got if r.doc_id == 1)[0] == sorted(r.n_tokens for r in got if r.doc_id == 1)[1] > 0
    assert [r.n_tokens for r in got if r.doc_id == 2] == [0] and [r.n_tokens for r in got if r.doc_id == 3][0] > 300_000
