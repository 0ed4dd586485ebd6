"""Semantic drift (cosine distance) between texts, one pair or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetext.functions import text as tx
from kinetext.functions import vectors as vx


#: A drift that is less under a limit is at it: else the last bit of a sum would decide.
EQUAL = 1e-12


def interpretation(drift: Column) -> Column:
    under = lambda limit: drift < limit - EQUAL
    return (
        F.when(under(0.1), "Very similar (near-identical semantics)").when(under(0.3), "Similar (related semantics)").when(under(0.5), "Moderate drift (some semantic divergence)")
        .when(under(0.7), "Significant drift (different semantics)").when(drift.isNotNull(), "High drift (unrelated or opposite semantics)")
    )


def rounded(drift: Column) -> Column:
    """To 4 places, to 12 first: a drift that lies halfway goes up, whatever the last bit of a sum says."""
    return F.round(F.round(drift, 12), 4)


def between(pairs: DataFrame, backend, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """Adds drift (4 places), interpretation (of the unrounded drift), both previews, and an error where a text is missing."""
    ok = (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
    t = backend.embed(backend.embed(pairs, a, "_a"), b, "_b")
    t = t.withColumn("_drift", F.when(ok, vx.cosine_distance(F.col("_a"), F.col("_b"))))
    return t.select(
        *pairs.columns, rounded(F.col("_drift")).alias("drift"), interpretation(F.col("_drift")).alias("interpretation"), F.when(ok, tx.preview(F.col(a), 80)).alias("text_a_preview"),
        F.when(ok, tx.preview(F.col(b), 80)).alias("text_b_preview"), F.when(~ok, F.lit("Both text_a and text_b are required")).alias("error"),
    )


def bulk(lines: DataFrame, backend) -> DataFrame:
    """For parsed lines (line, text_a, text_b, valid): line, previews, drift and interpretation; invalid lines stay, marked so."""
    t = between(lines, backend)
    bad = ~F.col("valid")
    return t.select(
        "line", F.when(bad, "(invalid)").otherwise(tx.preview(F.col("text_a"), 80)).alias("text_a_preview"), F.when(bad, "(invalid)").otherwise(tx.preview(F.col("text_b"), 80)).alias("text_b_preview"),
        F.when(~bad, F.col("drift")).alias("drift"), F.when(bad, "Invalid JSON or missing fields").otherwise(F.col("interpretation")).alias("interpretation"),
    )


def status(results: DataFrame) -> DataFrame:
    """One row: how many pairs were processed and how many were valid."""
    n = F.count(F.lit(1))
    return results.agg(F.when(n == 0, F.lit("No valid pairs found in file")).otherwise(F.format_string("Processed %d pairs (%d valid)", n, F.count("drift"))).alias("status"))
