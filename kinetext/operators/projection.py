"""Data series of plots: profiles, overlays, similarity matrices and principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetext.functions import text as tx
from kinetext.functions import vectors as vx
from kinetext.operators import blocks
from kinetext.operators import kinematics as km


def profile_series(seq: DataFrame, threshold: float = 0.3, key: str = "doc_id") -> DataFrame:
    """(key, series, x, y, spike): velocities, accelerations and curvatures by index, spikes marked on accelerations."""
    rows = km.spikes(km.motion(seq, key), threshold, key)
    out = rows.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("series"), (F.col("p") - back).alias("x"), F.col(c).alias("y"), (F.col("spike") if c == "a" else F.lit(False)).alias("spike")) for name, c, back in (("velocity", "v", 1), ("acceleration", "a", 2), ("curvature", "k", 2))])).alias("s"))
    return out.select(key, "s.*").filter(F.col("y").isNotNull())


def overlay_series(seq: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, x, y): accelerations over normalised position, 0 to 1."""
    rows = km.motion(seq, key).filter(F.col("a").isNotNull())
    return rows.select(key, F.percent_rank().over(Window.partitionBy(key).orderBy("p")).alias("x"), F.col("a").alias("y"))


def spike_sentences(sentences: DataFrame, spikes: DataFrame, key: str = "doc_id", chars: int = 50) -> DataFrame:
    """The sentence behind each spike (place index + 1, if there is one), shortened."""
    at = sentences.select(F.col(key), F.col("pos").alias("_pos"), "sentence")
    t = spikes.select(key, F.explode("acceleration_spikes").alias("s")).select(key, F.col("s.index").alias("index"), F.col("s.magnitude").alias("magnitude"), (F.col("s.index") + 1).alias("_pos"))
    return t.join(at, [key, "_pos"]).select(key, "index", "magnitude", tx.preview(F.col("sentence"), chars).alias("label"))


def similarity_matrix(seq: DataFrame, key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """(key, i, j, sim) for all pairs of a sequence, both triangles and the diagonal, rounded to ``digits``; quadratic in its length by nature."""
    u = seq.select(key, "pos", vx.heatmap_unit(vx.double(F.col("e"))).alias("u"))
    name, pos = (seq.schema[c].dataType.simpleString() for c in (key, "pos"))

    def pairs(k, a, b, sim, ok):
        if digits is not None:
            sim = np.trunc(sim * 10.0**digits + np.copysign(0.5, sim)) / 10.0**digits
        n, m = sim.shape
        i, j = a["pos"].take(pa.array(np.repeat(np.arange(n), m))), b["pos"].take(pa.array(np.tile(np.arange(m), n)))
        sim = pa.array(sim.ravel(), mask=None if ok.all() else ~ok.ravel())
        return pa.table([pa.repeat(k, n * m), i, j, sim], names=[key, "i", "j", "sim"])

    return blocks.products(u, key, pairs, f"{key} {name}, i {pos}, j {pos}, sim double")


def principal_components(seq: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, pc1, pc2, ev1, ev2): coordinates on the first two components and their shares of the variance.

    Each axis points so that its largest coordinate (the first of equal ones) is positive. A missing second component is 0.
    """
    kind = seq.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = np.stack(pdf["e"].to_numpy()).astype(float)
        u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        total = float((s**2).sum())
        xy = np.zeros((len(x), 2))
        xy[:, : min(2, len(s))] = (u * s)[:, :2]
        xy *= np.where(xy[np.abs(xy).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)
        ev = [float(s[k] ** 2) / total if total > 0 and k < len(s) else 0.0 for k in (0, 1)]
        return pd.DataFrame({key: pdf[key], "pos": pdf["pos"], "pc1": xy[:, 0], "pc2": xy[:, 1], "ev1": ev[0], "ev2": ev[1]})

    rows = seq.select(key, F.col("pos").cast("bigint").alias("pos"), vx.double(F.col("e")).alias("e"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, pos bigint, pc1 double, pc2 double, ev1 double, ev2 double")
