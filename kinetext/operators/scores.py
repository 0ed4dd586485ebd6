"""Scores of whole sequences, from the rows of ``kinematics.motion`` and ``kinematics.spikes``.

All come from one pass over the vectors: the mean pairwise cosine has the closed form (|S|^2 - m) / (m (m - 1)), with S the sum of the
m unit vectors, which is added up by chunks of a sequence first. So vectors are never read (or embedded) twice, and no
row ever holds more than a chunk of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetext.functions import vectors as vx
from kinetext.functions.vectors import clip01
from kinetext.operators import blocks
from kinetext.operators import kinematics as km

#: Velocities that differ by less are equal, and a slope under it is flat: else the last bit of a sum would decide.
EQUAL = 1e-12
#: Vectors of a chunk, and digits to which accelerations and curvatures are compared for the place of the largest (the first of equal ones).
CHUNK, DIGITS = 256, 9
SPIKE = "array<struct<index:int,magnitude:double,isolation_score:double,position_ratio:double>>"


def pairwise(sums: Column, m: Column) -> Column:
    """Mean cosine of all pairs of ``m`` unit vectors, of the sums of parts of them; 0 without a pair."""
    ss = vx.once(vx.total(sums), lambda s: vx.dot(s, s))
    return F.when(m > 1, (ss - m) / (m * (m - 1))).otherwise(0.0)


def _unit() -> Column:
    n = vx.norm(F.col("e"))
    return F.when(n > vx.TINY, vx.scale(F.col("e"), 1 / n))


def pairwise_mean(seq: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pairwise): mean cosine over all pairs of vectors whose norms aren't tiny; 0 without a pair."""
    rows = seq.select(key, "pos", vx.double(F.col("e")).alias("e")).withColumn("_chunk", F.floor((F.row_number().over(km._window(key)) - 1) / CHUNK))
    sums = rows.select(key, "_chunk", _unit().alias("_u")).groupBy(key, "_chunk").agg(vx.total(F.collect_list("_u")).alias("s"), F.count("_u").alias("m"))
    return sums.groupBy(key).agg(F.collect_list("s").alias("s"), F.sum("m").alias("m")).select(key, pairwise(F.col("s"), F.col("m")).alias("pairwise"))


def pairwise_mean_by_join(seq: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same by its definition, the cosine of each pair, a block of a sequence joined with a block; quadratic in a sequence's length, for checks."""
    rows = seq.select(key, "pos", vx.double(F.col("e")).alias("e")).filter((vx.norm(F.col("e")) > vx.TINY) & F.col("pos").isNotNull())
    name = seq.schema[key].dataType.simpleString()

    def pairs(k, a, b, cosines, ok):
        p, q = (t["pos"].to_numpy() for t in (a, b))
        ok = ok & (p[:, None] < q[None, :])
        return pa.table([pa.array([k.as_py()], k.type), pa.array([float(cosines[ok].sum())]), pa.array([int(ok.sum())])], names=[key, "s", "m"])

    sums = blocks.products(rows.select(key, "pos", _unit().alias("u")), key, pairs, f"{key} {name}, s double, m bigint", half=True)
    return sums.groupBy(key).agg(F.sum("s").alias("s"), F.sum("m").alias("m")).filter("m > 0").select(key, (F.col("s") / F.col("m")).alias("pairwise"))


def _rows(seq: DataFrame, threshold: float, key: str, keep: tuple[str, ...]) -> DataFrame:
    """The rows of ``spikes``, with the sums of unit vectors (_sum, _m) on the first row of each chunk and vectors at both ends only."""
    rows = km.spikes(km.motion(seq, key, keep), threshold, key)
    of = ["p", "n", "v", "_v1", "a", "k", "lag2", "i", "iso", "ratio", "spike", *keep]
    ends = F.when((F.col("p") == 0) | (F.col("p") == F.col("n") - 1), F.col("e")).alias("e")
    rows = rows.select(key, F.floor(F.col("p") / CHUNK).alias("_chunk"), _unit().alias("_u"), F.struct(*of, ends).alias("_row"))
    chunks = rows.groupBy(key, "_chunk").agg(vx.total(F.collect_list("_u")).alias("_sum"), F.count("_u").alias("_m"), F.collect_list("_row").alias("_rows"))
    rows = chunks.select(key, "_sum", "_m", F.posexplode("_rows").alias("_at", "_row"))
    first = F.col("_at") == 0
    return rows.select(key, "_row.*", F.when(first, F.col("_sum")).alias("_sum"), F.when(first, F.col("_m")).alias("_m"))


def measure(seq: DataFrame, threshold: float = 0.3, key: str = "doc_id", keep: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """One row per sequence of ``seq`` (key, pos, e), unrounded: counts, means, variances, extremes, spikes and all scores.

    ``more`` adds aggregates of the rows of ``kinematics.spikes`` (and of the columns ``keep``), from the same grouping.
    """
    rows = _rows(seq, threshold, key, keep)
    spike = F.col("spike")
    of = lambda c: F.when(spike, F.col(c))
    calm = F.when(F.col("a").isNotNull() & ~spike, F.col("a"))
    place = lambda c: F.max_by("i", F.when(F.col(c).isNotNull(), F.struct(F.round(c, DIGITS), -F.col("p"))))
    t = rows.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.count("v").alias("nv"), F.count("a").alias("na"),
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean_velocity"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("velocity_variance"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("path"),
        F.coalesce(F.avg("a"), F.lit(0.0)).alias("mean_acceleration"), F.coalesce(F.var_pop("a"), F.lit(0.0)).alias("acceleration_variance"),
        F.coalesce(F.max("a"), F.lit(0.0)).alias("max_acceleration"), F.coalesce(place("a"), F.lit(0)).alias("max_acceleration_index"),
        F.coalesce(F.max("k"), F.lit(0.0)).alias("max_curvature"), F.coalesce(place("k") + 1, F.lit(0)).alias("max_curvature_index"),
        F.array_sort(F.collect_list(F.when(spike, F.struct(F.col("i").alias("index"), F.col("a").alias("magnitude"), F.col("iso").alias("isolation_score"), F.col("ratio").alias("position_ratio"))))).alias("spikes"),
        F.count_if(spike).alias("n_spikes"), F.coalesce(F.avg(of("iso")), F.lit(0.0)).alias("isolation"), F.max(of("a")).alias("top"), F.avg(calm).alias("calm"), F.max(calm).alias("calm_top"),
        F.avg("lag2").alias("lag2"), F.min_by("e", "p").alias("e0"), F.max_by("e", "p").alias("e1"),
        F.avg(F.when(F.col("_v1").isNotNull(), (F.col("_v1") - F.col("v") > EQUAL).cast("double"))).alias("falling"), F.regr_slope(F.col("v"), F.col("p").cast("double")).alias("slope"),
        F.collect_list("_sum").alias("_sums"), F.sum("_m").alias("_m"), *[c.alias(name) for name, c in more.items()],
    )
    t = t.withColumn("pairwise", pairwise(F.col("_sums"), F.col("_m"))).drop("_sums", "_m")
    n_spikes, na = F.col("n_spikes"), F.col("na")
    spikiness = 1 - F.least(3 * n_spikes / F.when(na > 0, na), F.lit(1.0))
    stability = F.coalesce(1 - F.least(F.col("calm") / 0.3, F.lit(1.0)), F.lit(0.0))
    contrast = F.coalesce(F.tanh(2 * (F.col("top") - F.col("calm_top")) / (F.col("top") + 0.01)), F.lit(0.0))
    deadpan = F.when(na < 2, 0.0).otherwise(clip01(0.25 * spikiness + 0.35 * F.col("isolation") + 0.20 * stability + 0.20 * contrast))
    circularity = F.when(F.col("lag2").isNull(), 0.0).otherwise(clip01((F.col("lag2") - 0.3) / 0.5))
    net = F.when((vx.norm(F.col("e0")) <= vx.TINY) | (vx.norm(F.col("e1")) <= vx.TINY), 0.0).otherwise(1 - F.least(vx.norm(vx.subtract(F.col("e1"), F.col("e0"))) / (F.col("path") + 0.01), F.lit(1.0)))
    close = F.when(F.coalesce("pairwise", F.lit(0.0)) == 0, 0.0).otherwise(clip01((F.col("pairwise") - 0.3) / 0.5))
    tautology = F.when(F.col("n") < 2, 0.0).otherwise(clip01(0.6 * close + 0.4 * net))
    slope = F.when(F.abs("slope") < EQUAL, 0.0).otherwise(F.col("slope"))
    trend = F.when(F.col("nv") < 3, 0.5).when(slope < -0.05, 1.0).when(slope < 0, 0.5).otherwise(0.0)
    deceleration = F.when(F.col("nv") < 2, 0.0).otherwise(clip01(0.6 * F.col("falling") + 0.4 * trend))
    t = t.withColumns({"deadpan_score": deadpan, "circularity_score": circularity, "tautology_density": tautology, "deceleration_score": deceleration})
    return t.withColumn("heller_score", clip01(0.35 * F.col("circularity_score") + 0.40 * F.col("tautology_density") + 0.25 * F.col("deceleration_score")))


def spike_interpretation(deadpan: Column) -> Column:
    return F.when(deadpan > 0.6, "Strong isolated spikes against steady background").when(deadpan > 0.4, "Moderate isolated spike pattern").otherwise("Weak or no isolated spike pattern")


def circularity_interpretation(heller: Column) -> Column:
    return F.when(heller > 0.5, "Strong circular/repetitive structure with deceleration").when(heller > 0.3, "Moderate circular structure").otherwise("Weak or no circular structure")


def report(measured: DataFrame, key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """The metrics, rounded (variances to 6 places, the others to 4), with interpretations; under two sentences an error. Columns ``also`` stay."""
    few = F.col("n") < 2
    r = lambda c, d=4: F.when(~few, F.round(c, d)).alias(c)
    rounded = F.transform("spikes", lambda s: F.struct(s["index"].alias("index"), F.round(s["magnitude"], 4).alias("magnitude"), F.round(s["isolation_score"], 4).alias("isolation_score"), F.round(s["position_ratio"], 4).alias("position_ratio")))
    return measured.select(
        key, F.col("n").alias("n_sentences"), r("mean_velocity"), r("velocity_variance", 6), r("mean_acceleration"), r("acceleration_variance", 6), r("max_acceleration"), F.when(~few, F.col("max_acceleration_index")).alias("max_acceleration_index"),
        r("max_curvature"), F.when(~few, F.col("max_curvature_index")).alias("max_curvature_index"), F.when(~few, rounded).alias("acceleration_spikes"), r("deadpan_score"), r("circularity_score"), r("tautology_density"), r("deceleration_score"), r("heller_score"),
        F.when(~few, spike_interpretation(F.col("deadpan_score"))).alias("spike_interpretation"), F.when(~few, circularity_interpretation(F.col("heller_score"))).alias("circularity_interpretation"),
        F.when(few, F.concat(F.lit("Need at least 2 sentences, got "), F.col("n").cast("string"))).alias("error"), *also,
    )


def recompute(seq: DataFrame, width: int = 1, threshold: float = 0.3, key: str = "doc_id") -> DataFrame:
    """The report on smoothed vectors; fewer than three of them are an error, which names the sentences before smoothing."""
    rows = km.smooth(seq, width, key).select(key, "pos", "e", "before")
    out = report(measure(rows, threshold, key, ("before",), _n=F.first("before")), key, ("_n",))
    small = F.col("n_sentences") < 3
    return out.withColumn("error", F.when(small, F.format_string("Window too large for %d sentences", "_n"))).drop("_n")


def recompute_pair(golden: DataFrame, synthetic: DataFrame, pairs: DataFrame, width: int = 1, threshold: float = 0.3, key: str = "doc_id") -> DataFrame:
    """For ``pairs`` (golden_id, synthetic_id) both summaries on smoothed vectors: sentences, isolation, circularity (the combined score) and spikes."""
    def side(seq: DataFrame, name: str) -> DataFrame:
        m = measure(km.smooth(seq, width, key).select(key, "pos", "e"), threshold, key)
        s = F.struct(F.col("n").alias("n_sentences"), F.round("deadpan_score", 4).alias("spike_isolation"), F.round("heller_score", 4).alias("circularity"), F.col("n_spikes"))
        return m.select(F.col(key).alias(f"{name}_id"), s.alias(f"{name}_summary"))

    out = pairs.join(side(golden, "golden"), "golden_id").join(side(synthetic, "synthetic"), "synthetic_id")
    small = (F.col("golden_summary.n_sentences") < 3) | (F.col("synthetic_summary.n_sentences") < 3)
    return out.withColumn("error", F.when(small, F.lit("Window too large for passage lengths")))
