"""Structural comparison of two sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetext.functions import vectors as vx
from kinetext.operators import kinematics as km
from kinetext.operators import scores


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, of both profiles at the longer one's length; 0 unless both have two values and some spread."""
    def stats(xy: Column) -> Column:
        n = F.size(xy)
        mean = lambda c: F.aggregate(xy, F.lit(0.0), lambda s, p: s + p[c]) / n
        zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))

        def sums(m: Column) -> Column:
            def step(s: Column, p: Column) -> Column:
                dx, dy = p["x"] - m["x"], p["y"] - m["y"]
                return F.struct((s["xy"] + dx * dy).alias("xy"), (s["xx"] + dx * dx).alias("xx"), (s["yy"] + dy * dy).alias("yy"))

            return F.aggregate(xy, zero, step)

        return vx.once(
            vx.once(F.struct(mean("x").alias("x"), mean("y").alias("y")), sums),
            lambda s: F.when((F.sqrt(s["xx"] / n) > vx.TINY) & (F.sqrt(s["yy"] / n) > vx.TINY), s["xy"] / F.sqrt(s["xx"] * s["yy"])).otherwise(0.0),
        )

    length = F.greatest(F.size(a), F.size(b))
    both = F.zip_with(vx.resample(a, length), vx.resample(b, length), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when((F.size(a) > 1) & (F.size(b) > 1), vx.once(both, stats)).otherwise(0.0)


def fitness_interpretation(fitness: Column) -> Column:
    return F.when(fitness < 0.3, "Excellent structural match").when(fitness < 0.5, "Good match, some rhythm deviation").when(fitness < 0.7, "Moderate — structure present but weak").otherwise("Poor match")


def profile_of(seq: DataFrame, threshold: float = 0.3, key: str = "doc_id") -> DataFrame:
    """What a comparison needs of each sequence, computed once however many pairs it is in."""
    m = scores.measure(seq, threshold, key, acc=km.in_order("a"))
    return m.select(F.col(key).alias("id"), "n", "acc", "deadpan_score", "heller_score", "isolation", F.col("n_spikes").cast("int").alias("n_spikes"), F.transform("spikes", lambda s: s["position_ratio"]).alias("places"))


def _sides(pairs: DataFrame, golden: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(golden_id, synthetic_id, g, s, _copies): each distinct pair with both profiles, and how often ``pairs`` has it; pairs that lack one go."""
    def of(known: DataFrame, *sides: str) -> DataFrame:
        at = F.explode(F.array(*[F.struct(F.col(f"{x}_id").alias("id"), F.lit(x).alias("side")) for x in sides])).alias("x")
        roles = pairs.select("golden_id", "synthetic_id", at).select("golden_id", "synthetic_id", "x.*")
        return roles.join(known.select("id", F.struct("*").alias("x")), "id").drop("id")

    rows = of(golden, "golden", "synthetic") if golden is synthetic else of(golden, "golden").unionByName(of(synthetic, "synthetic"))
    # a fixed number of partitions: warping has nothing to do with the few bytes of two profiles, by which partitions would be merged
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "golden_id", "synthetic_id")
    side = lambda x: F.when(F.col("side") == x, F.col("x"))
    t = rows.groupBy("golden_id", "synthetic_id").agg(F.first(side("golden"), True).alias("g"), F.first(side("synthetic"), True).alias("s"), F.count(side("golden")).cast("int").alias("_copies"))
    return t.filter("g is not null and s is not null")


def compare(pairs: DataFrame, golden: DataFrame, synthetic: DataFrame) -> DataFrame:
    """For ``pairs`` (golden_id, synthetic_id) and the ``profile_of`` both sides: the seven components, fitness and summaries.

    Lower fitness is better; components are rounded before they enter it. Sides with under two sentences are an error.
    Where both sides are the same table, it is computed once; both profiles of a pair meet by the pair.
    """
    t = _sides(pairs, golden, synthetic)
    ng, ns = F.col("g.n_spikes"), F.col("s.n_spikes")
    place = F.when((ng > 0) & (ns > 0), 1 - F.least(vx.greedy_match(F.col("g.places"), F.col("s.places")) / ng + 0.2 * F.abs(ng - ns), F.lit(1.0))).when((ng == 0) & (ns == 0), 1.0).otherwise(0.0)
    count = F.when(ng > 0, F.least(ng, ns) / F.greatest(ng, ns)).otherwise(F.when(ns == 0, 1.0).otherwise(0.0))
    t = t.select(
        "golden_id", "synthetic_id", "g", "s", "_copies", F.round("s.deadpan_score", 4).alias("synthetic_deadpan"), F.round("s.heller_score", 4).alias("synthetic_heller"), F.round("s.isolation", 4).alias("synthetic_mean_isolation"),
        F.round(vx.dtw(F.col("g.acc"), F.col("s.acc")), 4).alias("acceleration_dtw"), F.round(correlation(F.col("g.acc"), F.col("s.acc")), 4).alias("acceleration_correlation"),
        F.round(place, 4).alias("spike_position_match"), F.round(count, 4).alias("spike_count_match"),
    )
    fitness = (
        0.30 * (1 - F.col("synthetic_deadpan")) + 0.15 * (1 - F.col("synthetic_mean_isolation")) + 0.20 * F.least(F.col("acceleration_dtw"), F.lit(1.0))
        + 0.15 * (1 - F.greatest(F.col("acceleration_correlation"), F.lit(0.0))) + 0.10 * (1 - F.col("spike_position_match")) + 0.10 * (1 - F.col("spike_count_match"))
    )
    # to 8 places first: sums of rounded components often lie on a tie, which the last bit of the sum mustn't decide
    t = t.withColumn("fitness_score", F.round(F.round(fitness, 8), 4))
    summary = lambda x: F.struct(F.col(f"{x}.n").alias("n_sentences"), F.round(f"{x}.deadpan_score", 4).alias("deadpan_score"), F.round(f"{x}.heller_score", 4).alias("heller_score"), F.col(f"{x}.n_spikes").alias("n_spikes"))
    few = F.when(F.col("g.n") < 2, F.col("g.n")).when(F.col("s.n") < 2, F.col("s.n"))
    return t.select(
        *[c for c in t.columns if c not in ("g", "s", "_copies")], fitness_interpretation(F.col("fitness_score")).alias("interpretation"), summary("g").alias("reference_summary"), summary("s").alias("comparison_summary"),
        F.when(few.isNotNull(), F.concat(F.lit("Need at least 2 sentences, got "), few.cast("string"))).alias("error"), F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
