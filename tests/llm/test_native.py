"""License scan and decontamination against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetext.llm import decontaminate, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = dict(licenses.TEMPLATES)["mit"]


def split(t):
    return WORD.findall((t or "").translate(LOW))


def base_brute(text):
    w, at = split(text), []
    for label, p in licenses.PHRASES:
        p = p.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


CASES = [
    "Released under the MIT License.", "under the mit license under THE mit license", "Apache License, Version 2.0; CC-BY-NC", "cc by nc cc by nc", None, "", "under the mit", "É under_the-MIT\nlicense 日本", "mit", "under the mit licenses",
    "intro words " + MIT.upper() + " outro", "x " + MIT.replace("sublicense", "sub license now") + " y", " ".join(MIT.split()[:12]), "ſ K under the mit license",
]


def test_scan(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string").withColumn("w", F.lit(1)).withColumn("pos", F.lit("x"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, t in enumerate(CASES):
        n, places, first, last, labels = base_brute(t)
        base = [s for s in got[k].spans if s.phrase]
        assert (got[k].n_words, len(base)) == (n, places) and ",".join(sorted({s.label for s in base})) == labels
        assert min((s.first_word for s in base), default=None) == first and max((s.first_word for s in base), default=None) == last
        assert 0 <= got[k].score <= 1
    whole = [s for s in got[10].spans if not s.phrase]
    assert [(s.label, s.first_word, s.n_words, s.coverage) for s in whole] == [("mit", 2, len(MIT.split()), 1.0)]
    moved = [s for s in got[11].spans if not s.phrase]
    assert len(moved) == 1 and moved[0].label == "mit" and 0.8 < moved[0].coverage < 1 and moved[0].n_words == len(MIT.split()) + 2
    assert not [s for s in got[12].spans if not s.phrase]


def test_scan_odd(spark, odd, none, docs, texts):
    rows = licenses.scan(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, len(split(r.text))) for r in odd.collect())
    assert licenses.scan(none).count() == 0
    assert {r.doc_id: r.n_words for r in licenses.scan(docs).collect()} == {k: len(split(t)) for k, t in enumerate(texts)}
    twice = spark.createDataFrame([(5, "under the mit license")] * 3, "doc_id bigint, text string")
    assert [len(r.spans) for r in licenses.scan(twice).collect()] == [1, 1, 1]


def leaks_brute(docs, items, t=0.8):
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    out = {}
    for k, text in docs:
        w = [x.lower() for x in split(text)]
        for i, item in items:
            v = [x.lower() for x in split(item)]
            if not v or not w:
                continue
            bag, n = Counter(sh(v)), len(v)
            for a in range(max(1, len(w) - n + 1)):
                own = w[a : a + n]
                if n < 5:
                    sim = float(own == v)
                elif len(own) < 5:
                    continue
                else:
                    x = Counter(sh(own))
                    both = sum((x & bag).values())
                    sim = both / (sum(x.values()) + sum(bag.values()) - both)
                if sim >= t - 1e-12 and sim > out.get((k, i), (0, 0))[0]:
                    out[k, i] = (sim, a)
    return out


def test_leaks(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("aeiou")
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((40, 40, 25, 60, 12, 7))] + [(6, "two words"), (7, ""), (8, None), (9, "solo"), (10, "again and again and again and again and again and again")]
    body = dict(items)
    docs = [(0, text(50) + " " + body[0] + " " + text(30)), (1, body[1].upper() + "."), (2, text(20))]
    for k in range(3, 23):  # edits of an item inside other words
        w = body[rng.choice([0, 1, 3])].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"]])
        docs.append((k, text(rng.randrange(30)) + " " + " ".join(w) + " " + text(rng.randrange(30))))
    half = body[0].split()
    docs += [(23, " ".join(half[20:] + half[:20])), (24, "two words here"), (25, "Solo"), (26, None), (27, ""), (28, " ".join(half[:-2])), (29, "x again and again and again and again and again and again and again y"), (30, body[0] + " " + body[0])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("s", F.lit(1)).withColumn("size", F.lit(2))
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.find_leaks(d, i).collect()}
    want = leaks_brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[x] == pytest.approx(want[x]) for x in want)
    assert decontaminate.find_leaks(d.limit(0), i).count() == 0 and decontaminate.find_leaks(d, i.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 100)  # several passes
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, i).collect()} == want.keys()
    monkeypatch.undo()
    again = decontaminate.find_leaks(d.unionByName(d), i)
    assert again.count() == len(want)


@pytest.mark.parametrize("wide", [0x7FFF, 50])
def test_long_leaks(spark, monkeypatch, wide):
    """Items longer than the windows that roll in one row, edited, in long documents; counters of either width."""
    monkeypatch.setattr(decontaminate, "WIDE", wide)
    monkeypatch.setattr(decontaminate, "STEP", 64)
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    items = [(0, text(300)), (1, " ".join(["round and round we go"] * 20 + text(40).split()))]
    docs = []
    for k in range(6):
        w = items[k % 2][1].split()
        for _ in range(k // 2 * 2):
            w[rng.randrange(len(w))] = "new"
        docs.append((k, text(200 + 50 * k) + " " + " ".join(w) + " " + text(100)))
    docs.append((6, text(900)))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.find_leaks(d, i).collect()}
    want = leaks_brute(docs, items)
    assert len(want) >= 4 and got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_bags(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(8) for _ in range(rng.randrange(1, 30))], [rng.randrange(8) for _ in range(rng.randrange(1, 30))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for r in df.select("a", "b", decontaminate.similarity(F.col("a"), F.col("b")).alias("s"), decontaminate.held(F.col("a"), F.col("b")).alias("h")).collect():
        both = sum((Counter(r.a) & Counter(r.b)).values())
        assert r.s == pytest.approx(both / (len(r.a) + len(r.b) - both)) and r.h == [x in r.b for x in r.a]


def test_fingerprint(spark):
    rng = random.Random(1)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(rng.randrange(1, 50))],) for _ in range(40)]
    df = spark.createDataFrame(rows, "h array<bigint>")
    for r in df.select("h", decontaminate.fingerprint(F.col("h")).alias("f")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))
        assert r.f % (1 << 64) == want


def test_plans_are_native(spark, sf, capsys):
    for q in (licenses.op2_licenses, decontaminate.op8_decontamination):
        q(spark, sf).explain()
        plan = capsys.readouterr().out
        assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_wide_fingerprints(spark):
    """Fingerprints of more shingles than a counter of 16 bits can hold."""
    rng = random.Random(12)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(70_000)]
    for n in (32_767, 32_768, 65_536, 70_000):
        df = spark.createDataFrame([(hashes[:n],)], "h array<bigint>")
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes[:n]) > n)
        assert df.select(decontaminate.fingerprint(F.col("h")).alias("f")).first().f % (1 << 64) == want
    for n in (32_767, 32_768, 70_000):
        same = spark.createDataFrame([([-1] * n,)], "h array<bigint>")
        assert same.select(decontaminate.fingerprint(F.col("h")).alias("f")).first().f == -1


def test_other_letters_stay(spark):
    """The Kelvin sign folds to k elsewhere; here it makes another word."""
    d = spark.createDataFrame([(1, "Under THE mit LICENSE"), (2, "wor\u212a Under the MIT license \u00c9"), (3, "apache license version\u212a 2")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, [s.label for s in r.spans if s.phrase]) for r in licenses.scan(d).collect()}
    assert got == {1: (4, ["mit"]), 2: (6, ["mit"]), 3: (4, [])}
    assert d.select(F.explode(licenses.words(F.col("text"))).alias("w")).filter(F.col("w") == "wor\u212a").count() == 1


def test_many_template_grams(spark, monkeypatch):
    """Beyond the bound of the broadcast the same spans are found by an exchange."""
    d = spark.createDataFrame([(1, "x under the mit license y"), (2, "apache license version 2"), (3, None)], "doc_id bigint, text string")
    want = sorted(map(str, licenses.scan(d).collect()))
    monkeypatch.setattr(licenses, "MOST_GRAMS", 3)
    found = licenses.scan(d)
    assert sorted(map(str, found.collect())) == want
