"""Classification by the nearest exemplar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetext.functions import text as tx
from kinetext.functions import vectors as vx

CONTENT_CHARS, THRESHOLD = 2000, 0.85
#: Categories, and numbers of all their vectors, that are broadcast at a time; more are compared in several passes.
MOST_CATEGORIES, MOST_VALUES = 10_000, 8_000_000


def nearest(docs: DataFrame, categories: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """For ``docs`` (key, e) and ``categories`` (category, ordinal, e): best match, similarity, confident, and all similarities in falling order.

    Ties go to the smaller ordinal. One pass over the documents for each MOST_CATEGORIES categories (or MOST_VALUES numbers), which travel
    as one array; several passes meet by ``key``, which then has to be unique.
    """
    size = categories.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("e")), F.lit(0)).alias("values")).first()
    if not size.n:
        return docs.select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("best_match", "string"), ("similarity", "double"), ("confident", "boolean"), ("all_similarities", "array<struct<category:string,similarity:double>>"))], F.lit("No valid category exemplars provided").alias("error"))
    passes = max(1, -(-size.n // MOST_CATEGORIES), -(-size.values // MOST_VALUES))
    part = F.pmod(F.xxhash64("category", "ordinal"), F.lit(passes))
    found = [_similarities(docs, categories if passes == 1 else categories.filter(part == k), key) for k in range(passes)]
    t = found[0] if passes == 1 else reduce(DataFrame.unionByName, found).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("sims"))).alias("sims"))
    t = t.withColumn("best", F.get("sims", 0))
    return t.select(
        key, F.col("best.category").alias("best_match"), F.round(-F.col("best.down"), 4).alias("similarity"), (-F.col("best.down") >= threshold).alias("confident"),
        F.transform("sims", lambda s: F.struct(s["category"].alias("category"), F.round(-s["down"], 4).alias("similarity"))).alias("all_similarities"), F.lit(None).cast("string").alias("error"),
    )


def _similarities(docs: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """(key, sims) against a bounded number of categories."""
    table = categories.agg(F.array_sort(F.collect_list(F.struct("ordinal", "category", vx.double(F.col("e")).alias("e")))).alias("cats"))
    t = docs.crossJoin(F.broadcast(table))  # a single row
    sims = F.transform("cats", lambda c: F.struct((-vx.cosine_similarity(F.col("e"), c["e"])).alias("down"), c["ordinal"].alias("ordinal"), c["category"].alias("category")))
    return t.select(key, F.array_sort(sims).alias("sims"))


def classify(docs: DataFrame, categories: DataFrame, backend, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts (their first CONTENT_CHARS characters, which is the feature) against exemplars (category, ordinal, exemplar; empty ones are left out)."""
    head, cut = tx.truncate(F.col(text), CONTENT_CHARS)
    usable = categories.filter(F.coalesce("exemplar", F.lit("")) != "")
    cats = backend.embed(usable, "exemplar", "e").select("category", "ordinal", "e")
    rows = docs.select(key, head.alias("_text"), F.coalesce(cut, F.lit(False)).alias("content_truncated"), (F.coalesce(F.col(text), F.lit("")) == "").alias("_empty"))
    found = nearest(backend.embed(rows, "_text", "e").select(key, "e"), cats, threshold, key)
    out = found.join(rows.select(key, "content_truncated", "_empty"), key)
    keep = lambda c: F.when(~F.col("_empty"), F.col(c)).alias(c)
    return out.select(key, *map(keep, ("best_match", "similarity", "confident", "all_similarities", "content_truncated")), F.lit(backend.model_name).alias("model"), F.lit(threshold).alias("threshold"), F.when(F.col("_empty"), F.lit("No content provided")).otherwise(F.col("error")).alias("error"))
