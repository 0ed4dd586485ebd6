"""Components, SimHash and the multi-index against brute force."""

import os
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetext.llm import graph, multi_index, simhash


def closure(n, links):
    low = list(range(n))
    for _ in range(n):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_local_components(n, links):
    links = [(a % n, b % n) for a, b in links]
    got = graph.local_components(n, np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
    assert got.tolist() == closure(n, links)


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in graph.components(df).collect()}
    want = closure(400, links)
    assert all(got.get(k, k) == want[k] for k in range(400))
    assert graph.components(df.limit(0)).count() == 0
    from kinetext.llm.common import shared_dir

    tables = lambda: len([x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("links-")])
    before = tables()
    assert graph.components(df).count() > 0 and tables() == before + 1  # the last round's table stays


def plain(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, docs, texts, none, odd):
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
    assert simhash.fingerprints(none).count() == 0 and simhash.near_duplicates(simhash.fingerprints(none)).count() == 0
    rows = simhash.near_duplicates(simhash.fingerprints(odd)).collect()
    assert len(rows) == 8 and {r.component_id for r in rows if r.doc_id in (1, 2) and r.fp == rows[0].fp} <= {1, 2}
    native = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def cloud(rng, n):
    """Fingerprints in clusters, so that many lie within a few bits."""
    out = []
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            x = c
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out[:n]


def test_all_pairs(spark):
    rng = random.Random(8)
    fps = cloud(rng, 700)
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "doc_id bigint, fp bigint")
    for radius in (2, 5):
        want = closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
        for block in (4096, 7):  # shards as a whole; cut into blocks
            got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, radius, sample=64, shard=40, block=block).collect()}
            assert got == dict(enumerate(want))
    arr = np.array(sorted(set(fps)), np.uint64)
    found = {(int(a), int(b)) for i, j in simhash.links(arr[:400], arr[400:], 3, block=16) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(len(arr)) for j in range(len(arr)) if (i < j < 400 or i >= 400 > j) and (int(arr[i]) ^ int(arr[j])).bit_count() <= 3}
    norm = lambda s: {(min(p), max(p)) for p in s}
    assert norm(found) == norm(want)


def test_null_ids_link(spark):
    """0 and 15 are linked through a row without an id only."""
    df = spark.createDataFrame([(7, 0), (None, 3), (9, 15), (None, -1)], "doc_id bigint, fp bigint")
    assert sorted((r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(-1, None), (0, 7), (3, 7), (15, 7)]


def test_blocks_meet_once():
    """Blocks of a cut leaf: all pairs of members, and of members with queries, in exactly one group."""
    rng = np.random.default_rng(2)
    fps, query = rng.integers(0, 1 << 63, 60, dtype=np.uint64), np.arange(60) >= 40
    for parts in ([1, 1], [3, 2], [1, 3], [4, 1]):
        sub, side, at = simhash.pair_blocks(fps, np.zeros(60, int), query, np.array([parts]))
        met: dict = {}
        for g in set(sub.tolist()):
            own = np.flatnonzero(sub == g)
            for i, j in simhash.meet(side[own], fps[at[own]], 64):
                for x, y in zip(at[own][i].tolist(), at[own][j].tolist(), strict=True):
                    met[min(x, y), max(x, y)] = met.get((min(x, y), max(x, y)), 0) + 1
        assert met == {(i, j): 1 for i in range(40) for j in range(i + 1, 60)}


def test_routing_growth():
    """Rows per fingerprint without structure, at the shards that so many fingerprints get."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    for n, most in ((1_000_000, 5), (30_000_000, 5), (160_000_000, 9)):
        shards = simhash.shard_count(n)
        tree = simhash.build(fps[: max(8192, 8 * shards)], shards)
        rows, _, _ = simhash.route(fps, tree, 2)
        assert len(rows) < most * len(fps)
    assert simhash.shard_count(100) == 1 and simhash.shard_count(1 << 40) == simhash.SAMPLE // 8


def test_keep_one(spark, docs, texts, odd, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(" ".join((t or "").lower().split()), k)
    assert set(ids) <= set(first.values()) and len(ids) >= len(first) - 3
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(odd).collect())
    assert len(rows) == len(set(rows)) and simhash.keep_one(none).count() == 0
    texts_of = [r.text for r in odd.collect()]
    assert {t for _, _, t in rows} == {t or "" for t in texts_of}


def test_similar_copies(spark):
    """Edited copies against all pairs by brute force, in chunks that are smaller than some groups."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(40):
        w = [word() for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            v = w[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                v[rng.randrange(len(v))] = word()
            rows.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = closure(len(rows), pairs)
    assert len(pairs) > 15 and sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(want))
    i, j = simhash.similar([np.array(sorted(hash(x) for x in s)) for s in sets], 0.8, most=5000)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(b, a) for a, b in pairs}


def test_multi_index(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, 500)] + 0.12 * rng.normal(size=(500, 16))
    x = np.vstack([x, x[:20], x[:20], 3 * x[20:30]]).astype(np.float32)
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 4]
    rows = [(k, [float(v) for v in e]) for k, e in enumerate(x)] + [(1000 + k, e) for k, e in enumerate(bad)] + [(None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1)).withColumn("links", F.lit(1))
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sim = u @ u.T >= 0.95
    np.fill_diagonal(sim, False)
    links = sum(got[k].n_links for k in range(len(x)))
    assert all(got[k].n_links <= sim[k].sum() for k in range(len(x))) and links >= 0.9 * sim.sum() and sim.sum() > 1000
    want = closure(len(x), np.argwhere(sim).tolist())
    assert sum(got[k].component_id == want[k] for k in range(len(x))) >= 0.95 * len(x)
    assert all(got[k].kept == (got[k].component_id == k) for k in range(len(x)))
    assert all((got[1000 + k].n_links, got[1000 + k].component_id, got[1000 + k].kept) == (0, 1000 + k, True) for k in range(len(bad)))
    assert got[None].n_links == 0 and len(got) == len(rows)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_cells(spark, monkeypatch):
    """Cells cut into small blocks give the same links."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1, 8)) + 0.1 * rng.normal(size=(300, 8))
    df = spark.createDataFrame([(k, [float(v) for v in e]) for k, e in enumerate(x)], "vec_id bigint, embedding array<double>")
    a = sorted(map(tuple, multi_index.near_duplicates(df).collect()))
    monkeypatch.setattr(multi_index, "BLOCK", 32)
    assert sorted(map(tuple, multi_index.near_duplicates(df).collect())) == a
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert sum(r[1] for r in a) >= 0.95 * n.sum()


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 6))
    ix = multi_index.Index(rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), 9)
    full = (multi_index.distances(x[:, :3], ix.first)[:, :, None] + multi_index.distances(x[:, 3:], ix.second)[:, None, :]).reshape(20, -1)
    assert (ix.order(x) == full.argsort(axis=1, kind="stable")[:, :9]).all()
    assert (ix.cells(x) == full.argmin(axis=1)).all() and (ix.order(x)[:, 0] == ix.cells(x)).all()


def test_ranks_by_brute_force():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(30, 8)), rng.normal(size=(30, 8))
    ix = multi_index.Index(rng.normal(size=(7, 4)), rng.normal(size=(7, 4)), 49)
    at = (ix.order(x) == ix.cells(y)[:, None]).argmax(axis=1)
    assert (ix._rank(x, y) == at).all()


def test_lengths_are_indexed_apart(spark):
    """Vectors of rarer lengths link among themselves, copies as well."""
    rows = [(k, [float(k == j) for j in range(6)]) for k in range(6)] + [(10, [1.0, 0.1]), (11, [1.0, 0.12]), (12, [0.0, 1.0]), (13, [5.0]), (14, [5.0]), (15, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(df).collect()}
    assert got == {k: (0, k) for k in (*range(6), 12, 15)} | {10: (1, 10), 11: (1, 10), 13: (1, 13), 14: (1, 13)}


def test_recall_on_planted_neighbours(spark):
    """64 dimensions, neighbours just beyond the threshold: at least 0.9 of the links and none below."""
    rng = np.random.default_rng(13)
    base = rng.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    u = rng.normal(size=(1500, 64))
    u -= (u * base[:1500]).sum(axis=1, keepdims=True) * base[:1500]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.999, (1500, 1))
    x = np.concatenate([base, c * base[:1500] + np.sqrt(1 - c * c) * u]).astype(np.float32)
    df = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(df).collect()}
    v = multi_index.units(x)
    n = (v @ v.T >= 0.95).sum(axis=1) - 1
    assert n.sum() >= 3000 and all(got[k] <= n[k] for k in range(len(x))) and sum(got.values()) >= 0.95 * n.sum()
    assert [multi_index.codebook(m) for m in (100, 3_200_000, 1 << 40)] == [2, 316, multi_index.MOST_CENTROIDS]


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def _kept(spark, rows):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect())


def test_large_band(spark, monkeypatch):
    """Near copies among many different texts that share a band, which is larger than a chunk: none is lost."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        w = _words(rng, 60)
        rows += [" ".join(w), " ".join(w[:-1] + _words(rng, 1))]
    # one value for all bands: a text meets its copy in that group only
    real = simhash.sketch
    monkeypatch.setattr(simhash, "sketch", lambda t, k: tuple([7] if isinstance(x, list) else x for x in real(t, k)))
    assert _kept(spark, rows) == list(range(0, 120, 2))


def test_repeated_line_in_a_copy(spark):
    """A copy that also repeats a line: its fingerprint is far off, its set of shingles near."""
    rng = random.Random(4)
    rows = []
    for _ in range(20):
        w = _words(rng, 150)
        rows += [" ".join(w), " ".join(w + _words(rng, 10) * 50)]
    far = [(simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert max(far) > 20 and _kept(spark, rows) == list(range(0, 40, 2))


def test_different_texts_with_one_line(spark):
    """Different texts dominated by one line have near fingerprints and all stay."""
    rng = random.Random(5)
    line = _words(rng, 11) * 20
    rows = [" ".join(_words(rng, 60) + line) for _ in range(20)]
    fps = [simhash.fingerprint(t.encode(), 5) for t in rows]
    assert min((a ^ b).bit_count() for a in fps for b in fps if a is not b) <= 2 and _kept(spark, rows) == list(range(20))


def test_texts_of_one_fingerprint(spark):
    """Each of several texts of one fingerprint gets its own near copies."""
    rng = random.Random(6)
    line = _words(rng, 11)
    firsts = [_words(rng, 60) for _ in range(6)]
    rows = [" ".join(w + line * 400) for w in firsts]
    rows += [" ".join(w[:-1] + _words(rng, 1) + _words(rng, 3) + line * 3) for w in firsts]
    fps = [simhash.fingerprint(t.encode(), 5) for t in rows]
    assert len(set(fps[:6])) < 6 and min((a ^ b).bit_count() for a in fps[:6] for b in fps[6:]) > 2
    assert _kept(spark, rows) == list(range(6))


def test_radius_pairs(spark):
    """Similar texts that share no band are found by their fingerprints."""
    rng = random.Random(8)
    w = _words(rng, 400)
    rows = [" ".join(w), " ".join(w[:-1] + _words(rng, 1)), " ".join(_words(rng, 400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    s = simhash.sketches(df, 5).withColumn("bands", F.array().cast("array<bigint>"))
    nodes = s.select("sid", "_key", "size", "bands", "map")
    assert simhash.verified_links(df, s, nodes, 5, 8, 0.8).count() == 1


def test_parity_maps():
    """No pair that reaches the threshold is lost by the maps."""
    rng = np.random.default_rng(9)
    sets = []
    for n in (1, 5, 9, 31, 32, 33, 70, 500):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: n - d], rng.integers(0, 1 << 63, e, dtype=np.uint64)])) for d in range(0, max(1, n // 5)) for e in (0, d, n // 4)]
    sets = [s for s in sets if len(s)][:400]
    i, j = simhash.similar(sets, 0.8)
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    got = {(min(a, b), max(a, b)) for x, y in simhash.candidates(np.array([len(s) for s in sets]), [simhash.parity(s) for s in sets], 0.8) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert len(want) > 100 and want <= got
