"""Text pairs as JSON lines, results as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, value) to (line, text_a, text_b, valid). Blank lines go; lines that aren't objects with both texts stay as invalid."""
    t = lines.filter(F.trim("value") != "").select("line", F.from_json("value", "text_a string, text_b string").alias("j"))
    t = t.select("line", F.col("j.text_a").alias("text_a"), F.col("j.text_b").alias("text_b"))
    return t.withColumn("valid", (F.coalesce("text_a", F.lit("")) != "") & (F.coalesce("text_b", F.lit("")) != ""))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of each file with their 1-based line numbers, in which blank lines count. A file is one task's work, for numbers need it whole."""
    whole = spark.read.text(path, wholetext=True)
    return parse_lines(whole.select(F.posexplode(F.split("value", "\n")).alias("at", "value")).select((F.col("at") + 1).alias("line"), "value"))


def write_csv(results: DataFrame, path: str) -> None:
    """One CSV with a header, in line order; null drift is an empty cell. Meant for reports: the rows meet in one file."""
    results.orderBy("line").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, pretty: bool = True) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))
