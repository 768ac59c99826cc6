import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.llm import bpe, chat, dealing, decontaminate, embeddings, jaccard, langid, licenses, sharding, suffixes, viterbi

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, _row string, uid int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", None, "x", 1) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def odd_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["the", "an", "o", "ÄÉ", "ti", "9", "漢"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    out = [None, "", "   ", "\n\t", "a", "One two", "x" * 3000, "🙂🙂 🙂", "a\x1cb\x00c", passage, passage, passage.upper(), "the the the the the the"]
    for _ in range(30):
        body = [word() for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.5:
            at = rng.randrange(len(body))
            body[at:at] = passage.split()[: rng.randint(5, 30)]
        out.append(rng.choice([" ", "  ", "\n"]).join(body))
    near = out[-1].split()
    near[len(near) // 2] = "changed"
    return [*out, " ".join(near), out[-1]]


def test_chat(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, None, None), (4, 0, "user", "only"), (None, 0, "user", "lost"), (6, 0, "user", "s"), (7, 0, "user", "s")]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash"))).collect()}
    assert sorted(got) == [0, 2, 3]
    r = got[0]
    assert r.prefix_turns == 1 and r.prompt == "<|im_start|>user\nq<|im_end|>\n" and r.complete
    s = r.chosen_mask[0]
    assert r.chosen[s.start : s.start + s.length] == "good<|im_end|>\n" and len(r.rejected_mask) == 1 and r.rejected.endswith("<|im_start|>\n<|im_end|>\n")
    assert got[2].rejected is None and not got[2].complete and got[2].prompt == ""
    assert got[3].prefix_turns == 1 and got[3].chosen == "" == got[3].rejected
    assert chat.format_preferences(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (0, 3, "assistant", "end"), (0, 3, "assistant", "end"), (1, 0, "user", "x" * 200_000), (1, 1, "assistant", "other"), (2, 0, "user", "alone"), (None, 0, "user", "lost"), (4, 1, "assistant", None), (4, 1, "user", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash"))
    swapped = chat.swapped_replies(table)
    got = {r.pair_id: r for r in chat.format_turns(swapped).collect()}
    assert chat.swapped_replies(table.limit(0)).count() == 0
    rejected = swapped.select((-1 - F.col("pair_id")).alias("conv_id"), F.explode("b").alias("t")).select("conv_id", "t.*")
    ids = swapped.select("pair_id", F.col("pair_id").alias("chosen_id"), (-1 - F.col("pair_id")).alias("rejected_id"), F.lit(1).alias("role"))
    assert {r.pair_id: r for r in chat.format_preferences(table.select("conv_id", "turn", "role", "text").union(rejected), ids).collect()} == got
    assert sorted(got) == [0, 1, 2, 4] and all(r.complete for r in got.values())
    assert got[0].prefix_turns == 3 and got[0].prompt.endswith("more<|im_end|>\n") and got[0].chosen.count("end<|im_end|>") == 2 == got[0].rejected.count("other<|im_end|>")
    assert got[1].prefix_turns == 1 and "end<|im_end|>" in got[1].rejected and len(got[1].prompt) > 200_000
    assert got[2].prefix_turns == 1 and got[2].chosen == "" == got[2].rejected
    assert got[4].prefix_turns == 0 and got[4].chosen == got[4].rejected  # null and '' are different turns that look alike
    some = spark.createDataFrame([("p", 0, 1), ("r", 0, 99), (None, 2, 2)], "pair_id string, chosen_id long, rejected_id long")
    named = {r.pair_id: r for r in chat.format_preferences(table, some).collect()}
    assert named["p"].prefix_turns == 0 and not named["r"].complete and named["r"].rejected is None and named[None].prefix_turns == 1


def test_sharding(spark):
    texts = odd_texts()
    ids = [5, 5, None, *range(100, 100 + len(texts) - 3)]
    got = sharding.shard_by_bytes(docs(spark, texts, ids), 7).collect()
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts), key=lambda x: -1 if x[0] is None else x[0])
    sizes = [16 + len((t or "").encode()) for _, t in order]
    total, start = sum(sizes), 0
    want = []
    for (i, t), s in zip(order, sizes):
        want.append((i, s, zlib.crc32((t or "").encode()), min(6, start * 7 // total)))
        start += s
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.text_crc32, r.shard)) for r in got)
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sharding.shard_by_bytes(docs(spark, []), 7).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_decontaminate(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    texts = odd_texts()
    items = [("10", texts[9]), ("9", "one two"), ("11", " ".join(texts[9].split()[3:14])), ("12", None), ("13", "  "), ("14", "the the the the the the the the the the the the")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in enumerate(texts):
        w, hit, got = words(t), set(), set()
        for item, x in items:
            b = words(x)
            n = min(10, len(b))
            wins = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    got.add(item)
        want.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, decontaminate.decontaminate(docs(spark, texts), bench).collect())) == want
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(docs(spark, ["a"]), bench.limit(0)).first().n_hit == 0


def test_decontaminate_odd_tables(spark):
    rng = random.Random(10)
    item = " ".join(f"item{i}" for i in range(14))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    texts = [long + " " + item + " " + long, item, item, None, " ".join(item.split()[:9]), "ITEM1 " * 3 + item.upper()]
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "  ")], "item_id long, text string").withColumn("fp", F.lit(1))
    frame = docs(spark, texts, [1, 2, 2, 4, 5, 6]).withColumn("_h", F.lit("clash")).withColumn("fp", F.lit(1))
    got = decontaminate.decontaminate(frame, bench).collect()
    sha = hashlib.sha256(b",1").hexdigest()  # the item without an id goes by ''
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(1, 240_014, 14, 2, True), (2, 14, 14, 2, True), (2, 14, 14, 2, True), (4, 0, 0, 0, False), (5, 9, 0, 0, False), (6, 17, 14, 2, True)]
    assert {r.items_sha256 for r in got if r.contaminated} == {sha}
    numbered = decontaminate.decontaminate(frame.withColumn("n", F.monotonically_increasing_id()), bench, uid="n")
    assert numbered.select("n").distinct().count() == 6


def test_language(spark):
    rng = random.Random(2)
    words = {"en": "the and with from this that have not".split(), "de": "der und nicht mit das ist ein auch".split(), "fr": "les est dans pour une avec sur qui".split()}
    make = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(i, make(x, 40), x) for i, x in enumerate(random.Random(3).choices(list(words), k=200))]
    rows += [(1000, None, "en"), (1001, "12 !?", "de"), (1002, "", None), (1003, make("en", 200) + " " + make("fr", 200), None), (1004, make("de", 200_000), None), (None, make("de", 30), "de")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == x for i, _, x in rows[:200]) and any(got[i].held_out for i in range(200))
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert set(got[1003].mixture) == {"en", "fr"} and 0.4 < got[1003].score < 0.62
    assert got[1004].lang_pred == "de" and got[1004].score > 0.95
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(none).first().lang_pred == "und"


def test_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = odd_texts()
    for r in bpe.encode(docs(spark, texts), path, P.PATTERN, keep_ids=True).collect():
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(docs(spark, []), path, P.PATTERN).count() == 0


def test_viterbi_against_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("piece_bpe_32k.model")
    pieces = viterbi.load_pieces(path)
    least = min(s for _, s, k in pieces if k == viterbi.NORMAL)
    small = [(p, s, k) for p, s, k in pieces if k == viterbi.NORMAL]
    model = tokenizers.models.Unigram([("<unk>", least)] + [(p, s) for p, s, _ in small], 0, False)
    ours = viterbi.Counter(small)
    assert ours.apart
    for t in filter(None, odd_texts()):
        assert ours.count(t) == len(model.tokenize("▁" + t.replace(" ", "▁"))), t[:80]
        assert ours.count_unit("▁" + t.replace(" ", "▁")) == ours.count(t)
    got = viterbi.count_tokens(docs(spark, [None, "", "hello world"]), path).collect()
    assert [r.n_tokens for r in got][:2] == [0, 0] and got[2].n_tokens > 0


@pytest.mark.parametrize("block", [embeddings.BLOCK, 3])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)  # buckets over it are dealt into blocks
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [base[i % 60] + 0.03 * rng.standard_normal(16) * (i >= 60) for i in range(200)]
    vecs = [(i, [float(x) for x in np.float32(v)], i % 60 % 3) for i, v in enumerate(rows)]
    vecs += [(i, [float(x) for x in np.float32(base[7] + 0.002 * rng.standard_normal(16))], 1) for i in range(300, 340)]
    vecs += [(400, [1.0, 2.0, 3.0], 1), (401, [1.0, 2.0, 3.0], 1), (402, [1.0, 2.0, 3.01], 1), (403, [1.0, 2.0, 3.0], 2), (403, [1.0, 2.0, 3.0], 2)]
    vecs += [(200, vecs[5][1], 5 % 3), (201, None, 1), (202, [0.0] * 16, 1), (203, [float("nan")] + [1.0] * 15, 1), (204, vecs[5][1], None), (205, [], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))).collect()}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    sound = {i: np.float64(v) / np.linalg.norm(np.float64(v)) for i, v, y in vecs if v and y is not None and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in vecs}
    links = {i: {j for j in sound if i in sound and j != i and label[i] == label[j] and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= 0.98} for i in got}
    assert len(got) == len(vecs) - 1  # one id stands twice
    assert sum(got[i].n_links for i in got) >= 0.9 * sum(map(len, links.values())) and all(got[i].n_links <= len(links[i]) for i in got if i != 403)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(201, 206))
    assert got[200].component_id == min(links[200]) and got[403].n_links == 1 and got[402].component_id == 400
    assert all(got[i].n_links == len(links[i]) for i in range(300, 340))  # so close that every pair meets


def without_repeats(raw, ids):
    """Brute force: the mask of removed bytes of each text; a null id comes last."""
    out = []
    for i, r in zip(ids, raw):
        seen = {o[p : p + 50] for j, o in zip(ids, raw) if j is not None and (i is None or j < i) for p in range(len(o) - 49)}
        mask = bytearray(len(r))
        for p in range(len(r) - 49):
            if r[p : p + 50] in seen:
                mask[p : p + 50] = b"\1" * 50
        out.append(mask)
    return out


@pytest.mark.parametrize("hot, bucket", [(suffixes.HOT, None), (3, None), (2, 4096)])
def test_suffixes_against_brute_force(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(suffixes, "BATCH", 200)  # several batches and levels
    if bucket:
        monkeypatch.setattr(dealing, "BUCKET_BYTES", bucket)
    texts = odd_texts()
    ids = [7, 7, None, *range(100, 100 + len(texts) - 3)]
    ids[10] = ids[9]  # equal texts under one doc_id don't remove each other
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, r, mask in zip(ids, raw, without_repeats(raw, ids)):
        kept = bytes(c for c, m in zip(r, mask) if not m)
        want.append(str((i, len(mask), sum(mask), sum(mask[i] and not (i and mask[i - 1]) for i in range(len(mask))), hashlib.sha256(kept).hexdigest())))
    got = [str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffixes.remove_repeats(docs(spark, texts, ids), hot=hot).collect()]
    assert sorted(got) == sorted(want) and any("(0" not in w for w in want)
    if not bucket:
        assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_suffixes_of_long_texts(spark):
    rng = random.Random(8)
    common = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    long = "".join(rng.choice("ijklmnop ") for _ in range(1_300_000))
    texts = [long + common, "start " + common[:2000] + " end", common[500:] + long[1_048_000:1_049_000], "é" * 40 + common[:60], None]
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: (r.n_removed, r.kept_sha256, r._row) for r in suffixes.remove_repeats(docs(spark, texts), keep=("doc_id", "_row")).collect()}
    for i, (r, mask) in enumerate(zip(raw, without_repeats(raw, range(5)))):
        assert got[i] == (sum(mask), hashlib.sha256(bytes(c for c, m in zip(r, mask) if not m)).hexdigest(), "x")


def test_suffix_levels_grow_geometrically():
    levels, rng = suffixes.SuffixLevels(4), random.Random(3)
    seen = {}
    for batch in range(20):
        words = np.array([bytes(rng.choices(b"ab", k=4)) for _ in range(8)], "S4")
        for w in words.tolist():
            seen.setdefault(w, batch)
        assert levels.add(words, np.full(8, batch)).tolist() == [seen[w] for w in words.tolist()]
    sizes = [len(x).bit_length() for x, _ in levels.levels]
    assert sizes == sorted(set(sizes), reverse=True)


@pytest.mark.parametrize("block", [300_000, 60])
def test_jaccard_against_brute_force(spark, block):
    rng = random.Random(6)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    texts = odd_texts()
    for _ in range(25):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(80)] = f"z{rng.randrange(1000)}"
        texts.append(" ".join(t))
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(docs(spark, texts), block_items=block).collect())
    assert got == [(i, len(sets[i]), comp[i]) for i in sets]
    if block > 100:
        assert jaccard.join_components(docs(spark, [])).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES][0] == "language ID" and len(cp.STAGES) == 5
    body = " ".join(f"the word{i} and" for i in range(60))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([body, body + " x", "123 456", "and the other text that stands alone here"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.language(spark, d, "").collect()) == [0, 1, 3]
    assert sorted(r.doc_id for r in cp.near_copies(spark, d, "").collect()) == [0, 2, 3]
    left = {r.doc_id: r.text for r in cp.repeated_passages(spark, d, "").collect()}
    assert left[0] == body and len(left[1]) < 10 and left[3] == rows[3][1]


def test_pipeline_keeps_documents_cut_inside_characters(spark, tmp_path):
    import corpus_pipeline as cp

    passage = " ".join(f"common passage {i}" for i in range(6)) + " "
    own = [" ".join(f"{w} words that only stand in text number {k} {w}{i}" for i in range(12)) for k, w in enumerate(["first", "second", "third", "fourth"])]
    # The cuts end inside characters: é and è, ю and я have their first bytes in common.
    texts = [f"{own[0]} {passage}é one", f"{own[1]} � {passage}è two", f"{own[2]} ж{passage}ю", f"{own[3]} д{passage}я"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a benchmark item of ten and more words that no document here has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    raw, want = [t.encode() for t in texts], []
    for k, r in enumerate(raw):  # brute force; parts are decoded one by one
        seen = {o[p : p + 50] for o in raw[:k] for p in range(len(o) - 49)}
        gone = bytearray(len(r))
        for p in range(len(r) - 49):
            if r[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        want.append("".join(r[m.start() : m.end()].decode("utf-8", "ignore") for m in re.finditer(rb"\0+", bytes(gone))))
    assert any("�" in t for t in want) and any(b != t for b, t in zip(texts, want))
    assert sorted(got) == [0, 1, 2, 3]
    for k, t in enumerate(want):
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over nulls, empty texts, repeated rows, copies, cuts, leaks and columns with the names of stages' own."""
    import corpus_pipeline as cp

    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(21)
    words = {"en": "the and with from this that have not were been their which".split(), "de": "der und nicht mit das ist ein auch werden wurde eine durch".split()}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "", "e", "n", "s"]) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(n))
    passage, leak = make("en", 25), make("en", 14)
    texts = [make(rng.choice(["en", "de"]), rng.randint(20, 120)) for _ in range(30)]
    texts[3] = texts[2] + " end"  # a near copy
    texts[5] = texts[4]
    for k in (6, 8, 10, 12):
        texts[k] = f"{texts[k]} {passage} {texts[k + 1]}"
    texts[14] = f"{texts[14]} {leak}"
    texts[16], texts[18] = passage, f"é{passage}é {texts[18]}"
    texts[20] = f"è{passage}ê {texts[20]}"
    rows = [(i, t, "de" if t.split()[0][:3] in ("der", "und") else "en") for i, t in enumerate(texts)]
    rows += [(2, texts[2], "en"), (None, texts[7], None), (None, make("de", 60), None), (100, None, "en"), (101, "", "de"), (102, "12 34 !", "en"), (103, "the", "en"), (7, make("en", 50), "en")]
    frame = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    for c in ("_row", "uid", "bucket", "k0", "kept", "grp"):
        frame = frame.withColumn(c, F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", leak), ("b2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Stage 1 by the operator's own parts, the others by brute force.
    known = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2 or i is None]
    langs = sorted({x for t, x in known if t and x})
    sums = np.full((len(langs), langid.BUCKETS), langid.SMOOTHING)
    for t, x in known:
        if x and (got := langid.ngram_counts(t)):
            sums[langs.index(x), got[0]] += got[1]
    logp = np.log(sums / sums.sum(1, keepdims=True)).astype(np.float32)
    left = [(i, t) for i, t, _ in rows if (got := langid.ngram_counts(t)) and langid.infer(*got, logp).max() >= cp.MIN_SCORE]
    assert len(left) >= len(rows) - 5
    sets = []
    for _, t in left:
        w = t.lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)})
    comp = list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            for b in range(len(left)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    first = {}
    for k, c in enumerate(comp):
        order = (left[k][0] is None, left[k][0] or 0, k)
        first[c] = min(first.get(c, order), order)
    left = [left[k] for _, _, k in sorted(first.values(), key=lambda x: x[2])]
    raw = [t.encode() for _, t in left]
    cut = []
    for (i, _), r, mask in zip(left, raw, without_repeats(raw, [i for i, _ in left])):
        parts = [r[m.start() : m.end()].decode("utf-8", "ignore") for m in re.finditer(rb"\0+", bytes(mask))]
        if not any(mask) or "".join(parts):
            cut.append((i, "".join(parts)))
    ten = lambda t: (lambda w: {tuple(w[j : j + 10]) for j in range(len(w) - 9)})(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    clean = [(i, t) for i, t in cut if not ten(t) & ten(leak)]
    assert len(raw) > len(cut) > len(clean) and any(i is None for i, _ in clean)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, list(r.ids), r.decoded_sha256) for r in got), key=str) == sorted(((i, enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean), key=str)


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_a_row_of_each_group(spark):
    import corpus_pipeline as cp

    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    pairs = [(None, "a"), (None, "b"), (None, "a"), (None, "c"), (7, "d"), (7, "e"), (7, "d"), (8, "f"), (8, "c"), (9, "e")]
    rows = [(i, text(w)) for i, w in pairs] + [(None, ""), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.text) for r in cp.near_copies(spark, d, "").collect()]
    want = [(None, text("a")), (None, text("b")), (7, text("d")), (7, text("e")), (8, text("f")), (8, text("c")), (None, ""), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
