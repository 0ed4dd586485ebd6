"""Hand-made goldens, the minimum-length table, metamorphic properties and a numpy re-derivation."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetext.functions import vectors as vx
from kinetext.operators import compare, projection, scores
from kinetext.operators import kinematics as km

G = [(1.0, 0.0), (0.8, 0.6), (0.0, 1.0), (0.6, 0.8), (1.0, 0.0), (0.96, 0.28)]
S = [(1.0, 0.0), (0.6, 0.8), (0.8, 0.6), (0.0, 1.0), (1.0, 0.0)]


def seq(spark, **passages):
    rows = [(k, i, [float(x) for x in e]) for k, v in passages.items() for i, e in enumerate(v)]
    return spark.createDataFrame(rows, "doc_id string, pos int, e array<double>")


def of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_profiles(spark):
    r = of(km.profiles(km.motion(seq(spark, G=G, S=S))))
    assert r["G"].velocity_profile == [0.6325, 0.8944, 0.6325, 0.8944, 0.2828]
    assert r["G"].acceleration_profile == [0.262, 0.262, 0.262, 0.6116]
    assert r["G"].curvature_profile == [0.7854, 2.9997, 0.7854, 2.8198]
    assert r["S"].velocity_profile == [0.8944, 0.2828, 0.8944, 1.4142]
    assert r["S"].acceleration_profile == [0.6116, 0.6116, 0.5198]


def test_report_goldens(spark):
    r = of(scores.report(scores.measure(seq(spark, G=G, S=S))))
    g, s = r["G"], r["S"]
    assert (g.mean_velocity, g.velocity_variance, g.mean_acceleration, g.acceleration_variance) == (0.6673, 0.050682, 0.3494, 0.022918)
    assert (g.max_acceleration, g.max_acceleration_index, g.max_curvature, g.max_curvature_index) == (0.6116, 3, 2.9997, 2)
    assert [tuple(x) for x in g.acceleration_spikes] == [(3, 0.6116, 0.8093, 1.0)]
    assert [tuple(x) for x in s.acceleration_spikes] == [(0, 0.6116, 0.0, 0.0), (1, 0.6116, 0.1466, 0.5), (2, 0.5198, 0.0, 1.0)]
    assert (g.deadpan_score, s.deadpan_score) == (0.5330, 0.0171)
    assert (g.circularity_score, s.circularity_score) == (0.28, 1.0)
    assert (g.tautology_density, s.tautology_density) == (0.8139, 0.7792)
    assert (g.deceleration_score, s.deceleration_score) == (0.7, 0.2)
    assert (g.heller_score, s.heller_score) == (0.5985, 0.7117)


def test_compare_golden(spark):
    known = compare.profile_of(seq(spark, G=G, S=S))
    pairs = spark.createDataFrame([("G", "S")], "golden_id string, synthetic_id string")
    r = compare.compare(pairs, known, known).first()
    assert (r.acceleration_dtw, r.acceleration_correlation, r.spike_position_match, r.spike_count_match) == (0.1748, -0.9428, 0.6, 0.3333)
    assert (r.synthetic_deadpan, r.synthetic_mean_isolation, r.fitness_score, r.interpretation) == (0.0171, 0.0489, 0.7292, "Poor match")
    assert r.reference_summary.n_spikes == 1 and r.comparison_summary.n_spikes == 3 and r.error is None


def test_smoothing(spark):
    s = km.smooth(seq(spark, G=G, T=G[:2]), 2)
    rows = [r for r in s.orderBy("doc_id", "pos").collect() if r.doc_id == "G"]
    assert np.allclose([r.e for r in rows], [(0.9, 0.3), (0.4, 0.8), (0.3, 0.9), (0.8, 0.4), (0.98, 0.14)])
    assert all(r.smoothed for r in rows)
    assert [r.smoothed for r in s.collect() if r.doc_id == "T"] == [False, False]
    assert km.smooth(seq(spark, G=G), 1).count() == 6
    said = seq(spark, G=G, T=G[:2]).withColumn("sentence", F.concat(F.lit("x" * 60), F.col("pos").cast("string")))
    labels = {(r.doc_id, r.pos): r.sentence for r in km.smooth(said, 3).collect()}
    assert len(labels) == 6 and labels["G", 0] == "x" * 50 + "... (+2)" and labels["T", 1] == "x" * 60 + "1"
    few = scores.recompute(seq(spark, G=G[:4]), 3).first()
    assert few.error == "Window too large for 4 sentences"


def test_minimum_lengths(spark):
    r = of(scores.measure(seq(spark, a=G[:1], b=G[:2], c=G[:3], d=G[:4])))
    assert of(scores.report(scores.measure(seq(spark, a=G[:1]))))["a"].error == "Need at least 2 sentences, got 1"
    assert (r["b"].deadpan_score, r["b"].circularity_score, r["b"].deceleration_score) == (0.0, 0.0, 0.0) and r["b"].tautology_density > 0
    assert r["c"].deadpan_score == 0.0 and abs(r["c"].deceleration_score - 0.2) < 1e-12
    assert r["d"].n == 4 and r["d"].na == 2
    alone = of(scores.measure(seq(spark, c=G[:3]), 0.1))["c"]  # an only acceleration has no neighbours
    assert alone.n_spikes == 1 and alone.isolation == 0.5
    known = compare.profile_of(seq(spark, b=G[:2], g=G))
    out = compare.compare(spark.createDataFrame([("g", "b")], "golden_id string, synthetic_id string"), known, known).first()
    assert math.isinf(out.acceleration_dtw) and out.acceleration_correlation == 0.0


def test_zero_vectors_and_ties(spark):
    z = [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    r = of(scores.measure(seq(spark, z=z)))["z"]
    assert r.circularity_score == 1.0 and r.max_acceleration == 0.0 and r.max_acceleration_index == 0
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert d.select(vx.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 1.0
    assert d.select(vx.heatmap_unit(F.col("a"))).first()[0] == [0.0, 0.0]
    assert d.select(vx.normalize(F.col("a"))).first()[0] == [0.0, 0.0]


def test_pairwise_forms_agree(spark):
    rng = np.random.default_rng(0)
    s = seq(spark, x=rng.normal(size=(20, 5)), y=rng.normal(size=(7, 5)))
    a, b = of(scores.pairwise_mean(s)), of(scores.pairwise_mean_by_join(s))
    assert all(abs(a[k].pairwise - b[k].pairwise) < 1e-12 for k in "xy")


def test_long_sequences(spark, monkeypatch):
    """More vectors than a chunk: sums of chunks give the same mean."""
    monkeypatch.setattr(scores, "CHUNK", 4)
    rng = np.random.default_rng(3)
    s = seq(spark, x=rng.normal(size=(23, 5)), y=rng.normal(size=(4, 5)), z=[(0.0,) * 5, (1.0,) + (0.0,) * 4])
    a, b, m = of(scores.pairwise_mean(s)), of(scores.pairwise_mean_by_join(s)), of(scores.measure(s))
    assert all(abs(a[k].pairwise - b[k].pairwise) < 1e-12 and abs(m[k].pairwise - b[k].pairwise) < 1e-12 for k in "xy") and a["z"].pairwise == m["z"].pairwise == 0.0


def test_scaling_and_duplicates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 4))
    r = of(scores.measure(seq(spark, a=x, b=3 * x)))
    assert abs(r["a"].circularity_score - r["b"].circularity_score) < 1e-12 and abs(r["a"].max_curvature - r["b"].max_curvature) < 1e-9
    assert abs(3 * r["a"].mean_velocity - r["b"].mean_velocity) < 1e-9
    v = of(km.profiles(km.motion(seq(spark, a=x, b=x[::-1], c=np.vstack([x, x[-1]])))))
    assert v["a"].velocity_profile == v["b"].velocity_profile[::-1] and v["c"].velocity_profile[-1] == 0.0


def test_random_against_numpy(spark):
    rng = np.random.default_rng(2)
    xs = {f"k{i}": rng.normal(size=(rng.integers(3, 12), 6)) for i in range(12)}
    r = of(scores.measure(seq(spark, **xs), 0.5))
    for k, x in xs.items():
        v = np.linalg.norm(np.diff(x, axis=0), axis=1)
        a = np.abs(np.diff(v))
        assert abs(r[k].mean_velocity - v.mean()) < 1e-9 and abs(r[k].velocity_variance - v.var()) < 1e-9
        assert r[k].n_spikes == (a >= 0.5).sum() and r[k].max_acceleration_index == a.argmax()


def dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = abs(x - y) + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return d[-1, -1] / (len(a) + len(b) - 1)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.floats(0, 1), min_size=1, max_size=8), st.lists(st.floats(0, 1), min_size=1, max_size=8)), min_size=5, max_size=20))
def test_array_folds(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    for r in df.select("i", vx.dtw(F.col("a"), F.col("b")).alias("d"), vx.greedy_match(F.col("a"), F.col("b")).alias("g"), vx.resample(F.col("a"), F.lit(5)).alias("l")).collect():
        a, b = pairs[r.i]
        assert abs(r.d - dtw(a, b)) < 1e-9
        used, total = set(), 0.0
        for p in a:
            best, at = 1.0, None
            for j, q in enumerate(b):
                if j not in used and abs(p - q) < best:
                    best, at = abs(p - q), j
            used.add(at)
            total += best
        assert abs(r.g - total) < 1e-9
        assert np.allclose(r.l, np.interp(np.linspace(0, 1, 5), np.linspace(0, 1, len(a)) if len(a) > 1 else [0.0], a))


def test_projections(spark):
    s = seq(spark, G=G)
    p = projection.principal_components(s).orderBy("pos").collect()
    x = np.array(G) - np.mean(G, axis=0)
    sv = np.linalg.svd(x, compute_uv=False)
    assert abs(p[0].ev1 - sv[0] ** 2 / (sv**2).sum()) < 1e-9 and len(p) == 6
    m = {(r.i, r.j): r.sim for r in projection.similarity_matrix(s).collect()}
    assert len(m) == 36 and abs(m[0, 1] - 0.8) < 1e-12 and m[1, 0] == pytest.approx(m[0, 1])
    o = projection.overlay_series(s).orderBy("x").collect()
    assert [r.x for r in o] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert projection.profile_series(s).groupBy("series").count().count() == 3


def test_empty(spark):
    none = seq(spark).limit(0)
    assert scores.report(scores.measure(none)).count() == 0 and km.smooth(none, 3).count() == 0


def test_greedy_match_of_long_profiles(spark):
    """Thousands of places on both sides, with ties and gaps, against the definition: quadratic, not cubic."""
    import time

    rng = np.random.default_rng(7)
    a, b = sorted(rng.integers(0, 3000, 6000) / 3000), sorted(rng.integers(0, 2500, 5500) / 2500)
    want, free = 0.0, np.array(b)
    for p in a:
        j = int(np.abs(p - free).argmin())
        d = abs(p - free[j])
        want, free[j] = (want + d, np.inf) if d < 1 else (want + 1.0, free[j])
    rows = [(0, [float(x) for x in a], [float(x) for x in b]), (1, [0.5, 0.5], []), (2, [], [0.5]), (3, None, [0.5]), (4, [5.0, 0.2], [0.1, 0.3])]
    t0 = time.monotonic()
    got = of(spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", vx.greedy_match(F.col("a"), F.col("b")).alias("g")), "i")
    assert time.monotonic() - t0 < 60
    assert got[0].g == float(want) and [got[i].g for i in (1, 2, 3)] == [2.0, 0.0, None] and abs(got[4].g - 1.1) < 1e-12


def test_dtw_of_long_profiles(spark):
    """Two profiles of thousands of values against the definition, to the last bit, also with the sides swapped; odd rows."""
    import time

    rng = np.random.default_rng(8)
    a, b = rng.random(4000), rng.random(3100)
    row = np.concatenate([[0.0], np.full(len(b), np.inf)])
    for x in a:
        up, row = row, [np.inf]
        for d, p, q in zip(np.abs(x - b).tolist(), up[1:], up):
            row.append(d + min(p, q, row[-1]))
    want = float(row[-1]) / (len(a) + len(b) - 1)
    a, b = a.tolist(), b.tolist()
    rows = [(0, a, b), (1, b, a), (2, [], [1.0]), (3, [1.0], []), (4, None, [1.0]), (5, [1.0], [3.0, 1.0]), (6, [2.0] * 3, [2.0])]
    t0 = time.monotonic()
    got = of(spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", vx.dtw(F.col("a"), F.col("b")).alias("d")), "i")
    assert time.monotonic() - t0 < 30
    assert [got[i].d for i in range(7)] == [want, want, math.inf, math.inf, None, 1.0, 0.0]


def test_compare_long_sequences(spark):
    """A whole comparison of sequences of thousands of vectors, most of whose accelerations are spikes."""
    import time

    rng = np.random.default_rng(9)
    known = compare.profile_of(seq(spark, G=rng.normal(size=(2500, 3)), S=rng.normal(size=(2200, 3))), 0.05).cache()
    g, s = (of(known, "id")[k] for k in "GS")
    assert g.n_spikes > 2000 and s.n_spikes > 2000
    t0 = time.monotonic()
    r = compare.compare(spark.createDataFrame([("G", "S")], "golden_id string, synthetic_id string"), known, known).first()
    assert time.monotonic() - t0 < 30
    assert r.acceleration_dtw == round(dtw(g.acc, s.acc), 4) and r.spike_count_match == round(min(g.n_spikes, s.n_spikes) / max(g.n_spikes, s.n_spikes), 4)
    known.unpersist()


def test_compare_computes_a_side_once(spark):
    """A table of profiles that is both sides is computed once, and each pair comes as often as it is asked for; unknown ones are left out."""
    known = compare.profile_of(seq(spark, G=G, S=S, T=S[::-1]))
    pairs = [("G", "S"), ("S", "T"), ("G", "S"), ("G", "G"), ("G", "?"), (None, "S")]
    pairs = spark.createDataFrame(pairs, "golden_id string, synthetic_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for profiles of long sequences
    out = compare.compare(pairs, known, known)
    got = sorted(out.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    windows = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Window [")
    assert windows(out) == 4
    assert [(r.golden_id, r.synthetic_id) for r in got] == [("G", "G"), ("G", "S"), ("G", "S"), ("S", "T")]
    assert (got[0].acceleration_dtw, got[0].spike_position_match) == (0.0, 1.0) and got[1] == got[2] and got[1].fitness_score == 0.7292
    assert sorted(compare.compare(pairs, known.filter("id != 'T'"), known).collect()) == got


def test_similarity_of_long_sequences(spark):
    """Sequences of several blocks, against numpy: every pair is there, in time that numpy's products set."""
    import time

    rng = np.random.default_rng(10)
    x = rng.normal(size=(2600, 64))
    rows = spark.createDataFrame([(k, i, e.tolist()) for k in range(6) for i, e in enumerate(x)], "doc_id int, pos int, e array<double>").cache()
    assert rows.count() == 6 * len(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = u @ u.T
    t0 = time.monotonic()
    m = of(projection.similarity_matrix(rows, digits=4).groupBy("doc_id").agg(F.count("sim").alias("n"), F.count_distinct("i").alias("d"), F.sum("sim").alias("s"), F.sum(F.when(F.col("i") < F.col("j"), F.col("sim") * F.col("i"))).alias("si")))
    assert time.monotonic() - t0 < 40
    assert len(m) == 6 and all(r.n == len(x) ** 2 and r.d == len(x) for r in m.values())
    assert all(abs(r.s - np.round(want, 4).sum()) < 0.01 and abs(r.si - (np.triu(np.round(want, 4), 1) * np.arange(len(x))[:, None]).sum()) < 1 for r in m.values())


def test_similarity_of_odd_vectors(spark):
    """Null vectors, vectors that hold null, other lengths and zeros keep their rows; equal places and null keys."""
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, None), ("a", 2, [1.0, None]), ("a", 2, [0.6, 0.8]), ("a", 3, [0.0, 0.0]), ("a", 4, [1.0]), ("b", 0, [2.0]), (None, 0, [1.0])], "doc_id string, pos int, e array<double>")
    got = [(r.doc_id, r.i, r.j, r.sim) for r in projection.similarity_matrix(rows, digits=4).collect()]
    known = sorted(x for x in got if x[3] is not None)
    assert len(got) == 37 and known == sorted([
        ("a", 0, 0, 1.0), ("a", 0, 2, 0.6), ("a", 2, 0, 0.6), ("a", 2, 2, 1.0), ("a", 0, 3, 0.0), ("a", 3, 0, 0.0), ("a", 2, 3, 0.0), ("a", 3, 2, 0.0), ("a", 3, 3, 0.0), ("a", 4, 4, 1.0), ("b", 0, 0, 1.0)])


def test_pairwise_join_of_long_sequences(spark):
    """By its definition over several blocks, equal to the closed form and to numpy; equal places are no pair, odd vectors are left out."""
    import time

    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64)) + 0.3
    rows = [(k, i, e.tolist()) for k in range(4) for i, e in enumerate(x)]
    rows += [(9, 0, [1.0, 0.0]), (9, 1, [0.6, 0.8]), (9, 1, [0.0, 1.0]), (9, 2, None), (9, 3, [0.0, 0.0]), (8, 0, [1.0])]
    rows = spark.createDataFrame(rows, "doc_id int, pos int, e array<double>").cache()
    assert rows.count() == 12_006
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T)[np.triu_indices(len(x), 1)].mean()
    t0 = time.monotonic()
    got = of(scores.pairwise_mean_by_join(rows))
    assert time.monotonic() - t0 < 25
    assert sorted(got) == [0, 1, 2, 3, 9] and all(abs(got[k].pairwise - want) < 1e-9 for k in range(4)) and abs(got[9].pairwise - 0.3) < 1e-12
