import random
import re

import pytest

from kohort.llm import licenses
from tests.llm.test_operators import docs


def bigrams(text):
    words = re.sub("licen[cs]e", "license", re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()).split()
    return list(zip(words, words[1:])), len(words)


def bag(grams):
    out = {}
    for g in grams:
        out[g] = out.get(g, 0) + 1
    return out


def brute(text, templates=licenses.TEMPLATES):
    """Every passage, from every word, against every template."""
    grams, _ = bigrams(text)
    out = {}
    for name, t in templates:
        other = bigrams(t)[0]
        s, have = len(other), bag(other)
        best = 0.0
        for i in range(len(grams)):
            part = grams[i : i + s]
            common = sum(min(n, have.get(g, 0)) for g, n in bag(part).items())
            best = max(best, 2.0 * common / (len(part) + s))
        if best >= 0.8:
            out[name] = best
    return out


def scanned(spark, texts, **more):
    rows = licenses.scan_licenses(docs(spark, texts), **more).collect()
    return {r.doc_id: r for r in rows}


def test_licenses_against_brute_force(spark):
    rng = random.Random(4)
    full = dict(licenses.TEMPLATES)
    wrap = lambda t, n, sep: sep.join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    prose = lambda n: " ".join(rng.choice("the software of in this use any or copy to be with and without limitation".split()) for _ in range(n))
    texts = ["Prose.\nReleased under the MIT Licence.\nmore", full["mit-text"][:420], wrap(full["mit-text"], 7, "\n * "), f"{prose(80)} {full['gpl-3.0-header']} {prose(90)}", "x; released under the\n   MIT License; y", None, "", "one", "   "]
    texts += [f"{prose(30)} {wrap(full['isc-text'], 9, chr(10) + '# ')} {prose(300)}", full["bsd-3-clause-text"] + "\n" + full["apache-2.0-header"], prose(1500)]
    for name in ("mit-text", "zlib-text", "mpl-2.0-header", "cc-by-4.0-notice", "bsd-2-clause-text"):
        words = full[name].split()
        for share in (0.05, 0.1, 0.15):  # some lose too much
            texts.append(prose(10) + " " + " ".join(w if rng.random() > share else "changed" for w in words) + " " + prose(10))
        texts.append(" ".join(words[: int(0.66 * len(words))]))
        texts.append(" ".join(words[: int(0.7 * len(words))]))
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert {m.id: round(m.score, 12) for m in got[i].matches} == {k: round(v, 12) for k, v in want.items()}, t[:60]
        assert [m.id for m in got[i].matches] == sorted(want) and got[i].n_words == bigrams(t)[1]
    assert "mit-grant" in brute(texts[1]) and "mit-text" in brute(texts[2]) and "gpl-3.0-header" in brute(texts[3]) and "mit" in brute(texts[4]) and any(not brute(t) for t in texts[-25:])
    assert [m.word for m in got[4].matches if m.id == "mit"] == [1]


def test_licenses_at_the_threshold(spark):
    lines = ["Now released under the MIT License today", "the BSD 2-Clause License.", "public license version 3 affero general", "Released under the MIT", "Released under the MIT License"]
    lines += ["Licensed under CC BY-NC 4.0"[12:], "This work is licensed under the GNU Affero General Public"]
    got = scanned(spark, lines)
    for i, t in enumerate(lines):
        assert {m.id: m.score for m in got[i].matches} == brute(t)
    exact = [("t", "a b c d e f g h i j k")]  # ten bigrams
    for text, hit in (("a b c d e f g h i", True), ("b c d e f g h", False), ("x a b c d e f g h i x x x", True), ("x a b c d e f g h x x x x", False)):
        assert bool(brute(text, exact)) == hit == bool(scanned(spark, [text], templates=exact)[0].matches)


def test_licenses_odd_tables(spark, tmp_path):
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    twice = licenses.scan_licenses(docs(spark, ["Released under the MIT License", "Released under the MIT License"], [3, 3])).collect()
    assert [[m.id for m in r.matches] for r in twice] == [["mit"]] * 2
    long = " ".join(f"word{i % 5000}" for i in range(200_000)) + " released under the mit license"
    assert scanned(spark, [long])[0].matches[0].word == 200_000
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs(spark, ["x"]), templates=[("t", "one")])
    (tmp_path / "own.txt").write_text("one two three\nfour")
    own = licenses.read_templates(spark, str(tmp_path))
    assert own == [("own", "one two three\nfour")] and scanned(spark, ["one two THREE four"], templates=own)[0].matches[0].score == 1.0
    repeated = [("t", "a b a b a b c")]
    for text in ("a b a b a b a b c", "a b c", "a b a b c", "b a b a"):
        assert {m.id: m.score for m in scanned(spark, [text], templates=repeated)[0].matches} == brute(text, repeated)
