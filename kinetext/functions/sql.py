"""Functions for use in SQL texts, as SQL functions of the session: they are inlined into plans, without a UDF."""

from __future__ import annotations

from pyspark.sql import SparkSession

VECTOR = "ARRAY<DOUBLE>"

FUNCTIONS = {
    "kx_dot": (f"a {VECTOR}, b {VECTOR}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "kx_norm": (f"a {VECTOR}", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "kx_cosine_similarity": (f"a {VECTOR}, b {VECTOR}", "DOUBLE", "CASE WHEN kx_norm(a) = 0 OR kx_norm(b) = 0 THEN 0D ELSE kx_dot(a, b) / (kx_norm(a) * kx_norm(b)) END"),
    "kx_cosine_distance": (f"a {VECTOR}, b {VECTOR}", "DOUBLE", "1 - kx_cosine_similarity(a, b)"),
    "kx_text_key": ("t STRING", "STRING", "substring(sha2(t, 256), 1, 16)"),
    "kx_preview": ("t STRING, n INT", "STRING", "CASE WHEN length(t) > n THEN concat(substring(t, 1, n), '...') ELSE t END"),
    "kx_words": ("t STRING", "ARRAY<STRING>", r"array_distinct(filter(split(regexp_replace(lower(coalesce(t, '')), r'(?U)[^\p{L}\p{N}_\s\x1c-\x1f]', ''), r'(?U)[\s\x1c-\x1f]+'), x -> x <> ''))"),
    "kx_jaccard": ("a STRING, b STRING", "DOUBLE", "CASE WHEN size(kx_words(a)) = 0 OR size(kx_words(b)) = 0 THEN 0D ELSE size(array_intersect(kx_words(a), kx_words(b))) / size(array_union(kx_words(a), kx_words(b))) END"),
}


def register(spark: SparkSession) -> None:
    """Makes all of FUNCTIONS temporary functions of the session."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
