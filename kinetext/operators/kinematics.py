"""Motion of ordered vectors: velocity, acceleration, curvature, spikes, smoothing.

Input: rows (key, pos, e) with ``e`` an array of doubles. All measures of a sequence share one window, so one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetext.functions import vectors as vx


#: Characters of a sentence in the label of a mean.
LABEL = 50
PROFILES = {"velocity_profile": "v", "acceleration_profile": "a", "curvature_profile": "k"}


def _window(key: str) -> Window:
    return Window.partitionBy(key).orderBy("pos")


def motion(seq: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds p (place from 0), n (places), v, a, k and lag2 (cosine with the vector two places before; null if a norm is tiny).

    Row p holds velocity p - 1, acceleration p - 2 and curvature p - 2; rows before the first of each hold null. Columns ``keep`` stay.
    """
    w = _window(key)
    rows = seq.select(key, "pos", *keep, vx.double(F.col("e")).alias("e"))
    rows = rows.withColumns({"p": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(key)), "_e1": F.lag("e", 1).over(w), "_e2": F.lag("e", 2).over(w)})
    rows = rows.withColumn("_d", F.when(F.col("_e1").isNotNull(), vx.subtract(F.col("e"), F.col("_e1"))))
    rows = rows.withColumn("v", vx.norm(F.col("_d")))
    rows = rows.withColumns({"_v1": F.lag("v").over(w), "_d1": F.lag("_d").over(w)})
    n0, n2 = vx.norm(F.col("e")), vx.norm(F.col("_e2"))
    return rows.select(
        key, "pos", *keep, "p", "n", "e", "v", "_v1", F.abs(F.col("v") - F.col("_v1")).alias("a"),
        F.when(F.col("_d1").isNotNull(), vx.angle(F.col("_d1"), F.col("_d"))).alias("k"),
        F.when((n0 > vx.TINY) & (n2 > vx.TINY), vx.dot(F.col("e"), F.col("_e2")) / (n0 * n2)).alias("lag2"),
    )


def spikes(rows: DataFrame, threshold: float = 0.3, key: str = "doc_id") -> DataFrame:
    """Adds to ``motion`` rows: i (the acceleration's index), iso (isolation against its neighbours), ratio (position) and spike."""
    w = _window(key)
    before, after = F.lag("a").over(w), F.lead("a").over(w)
    rows = rows.withColumns({"_before": before, "_after": after})
    known = F.col("_before").isNotNull().cast("int") + F.col("_after").isNotNull().cast("int")
    around = (F.coalesce("_before", F.lit(0.0)) + F.coalesce("_after", F.lit(0.0))) / F.when(known > 0, known)
    iso = F.when(known > 0, F.greatest(F.lit(0.0), F.tanh(2 * (F.col("a") - around) / (F.col("a") + 0.01))))
    return rows.withColumns({
        "i": F.col("p") - 2, "iso": F.when(F.col("a").isNotNull(), F.coalesce(iso, F.lit(0.5))),
        "ratio": (F.col("p") - 2) / F.greatest(F.col("n") - 3, F.lit(1)), "spike": F.coalesce(F.col("a") >= threshold, F.lit(False)),
    }).drop("_before", "_after")


def smooth(seq: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """Means of each ``width`` consecutive vectors; sequences of at most ``width`` vectors, or a width up to 1, stay as they are.

    Adds ``smoothed`` and ``before`` (vectors before smoothing). Where ``seq`` has a column sentence, it becomes the label of the
    mean: its first LABEL characters and how many sentences follow.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy(key))
    if width <= 1:
        return seq.withColumns({"smoothed": F.lit(False), "before": count})
    ahead = _window(key).rowsBetween(0, width - 1)
    rows = seq.withColumn("e", vx.double(F.col("e"))).withColumns({"before": count, "_near": F.collect_list("e").over(ahead)})
    rows = rows.filter((F.col("before") <= width) | (F.size("_near") == width)).withColumn("smoothed", F.col("before") > width)
    if "sentence" in seq.columns:
        rows = rows.withColumn("sentence", F.when(F.col("smoothed"), F.concat(F.substring("sentence", 1, LABEL), F.lit(f"... (+{width - 1})"))).otherwise(F.col("sentence")))
    return rows.withColumn("e", F.when(F.col("smoothed"), vx.scale(vx.total(F.col("_near")), F.lit(1.0 / width))).otherwise(F.col("e"))).drop("_near")


def in_order(column: str, digits: int | None = None) -> Column:
    """Aggregate: the column's values by place, nulls left out."""
    value = (lambda x: F.round(x[column], digits)) if digits is not None else (lambda x: x[column])
    return F.transform(F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("p", column)))), value)


def profiles(rows: DataFrame, key: str = "doc_id", digits: int = 4) -> DataFrame:
    """One row per sequence with its three profiles as arrays in order."""
    return rows.groupBy(key).agg(*[in_order(c, digits).alias(name) for name, c in PROFILES.items()])
