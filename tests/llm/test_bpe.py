import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.llm import bpe
from tests.llm.test_operators import P, docs


def test_bpe_long_words():
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(5)
    coder = bpe.Coder(path, P.PATTERN)
    letters = lambda n, some: "".join(rng.choice(some) for _ in range(n))
    texts = [letters(n, "etaoinshrdlu") for n in (239, 240, 241, 299, 300, 301, 541, 5000)]
    texts += [letters(100_000, "abcdefghijklmnopqrstuvwxyz"), letters(3000, "aé漢"), "a" * 10_001, "ha" * 3001, "abcde" * 2003, "—" * 2000, "=" * 5000, " " * 4000 + "x", "0" * 700]
    for t, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t[:20]
        assert coder.decode([ids, b""]) == [t.encode(), b""]


def test_bpe_stitches_exactly_with_short_overlaps(monkeypatch, tmp_path):
    """Random ranks, stretches far shorter than need be: what can't be stitched is contracted in longer ones."""
    import base64

    rng = random.Random(9)

    def plain(raw, ranks):
        toks = [raw[i : i + 1] for i in range(len(raw))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(toks, toks[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            toks[i : i + 2] = [toks[i] + toks[i + 1]]
        return [ranks[t] for t in toks]

    monkeypatch.setattr(bpe, "STEP", 12)
    monkeypatch.setattr(bpe, "OVERLAP", 6)
    for trial in range(6):
        more = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(40)}
        tokens = [bytes([i]) for i in range(256)] + rng.sample(sorted(more), len(more))
        ranks = {t: i for i, t in enumerate(tokens)}
        path = f"{tmp_path}/{trial}.tiktoken"
        with open(path, "w") as f:
            f.writelines(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens))
        coder = bpe.Coder(path, "[a-z]+")
        words = ["".join(rng.choices("abc", k=rng.randint(1, 90))) for _ in range(60)]
        for w, ids in zip(words, coder._encode_words([w.encode() for w in words], 12)):
            assert np.frombuffer(ids, "<u4").tolist() == plain(w.encode(), ranks)


def test_bpe_odd_rows(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = [None, "", "a b", "a b", "x\0y\x80"]
    got = bpe.encode(docs(spark, texts, [1, None, 3, 3, 5]).withColumn("ids", F.lit(1)), path, P.PATTERN, keep_ids=True)
    rows = got.collect()
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0] and sum(r.doc_id == 3 for r in rows) == 2
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(got, path).collect()}
    assert back == {1: b"", None: b"", 3: b"a b", 5: "x\0y\x80".encode()}
    odd = spark.createDataFrame([(1, [64, None, 10**9]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: len(r.decoded) for r in bpe.decode(odd, path).collect()} == {1: 1, 2: 0}
