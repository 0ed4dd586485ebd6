"""The corpus pipeline: STAGES applied to documents, each written as Parquet and read again as the next one's input.

language     drops documents whose language can't be told: no letters, or hardly an n-gram of any language
near_copies  keeps one document of each group of near-duplicates
passages     removes repeated passages of 35 words and more; a document of which nothing stays goes
benchmarks   drops documents that leak a benchmark item
packing      packs what is left into context windows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm import decontaminate, langid, packing, simhash, substrings
from kinetext.llm.common import aside, materialize, table
from kinetext.llm.tokens import public_path

#: A text of at least so many n-grams of which a smaller share belongs to its best language is in no known language.
LEAST_GRAMS, LEAST_EVIDENCE = 20, 0.1
#: Encoded pieces that a worker keeps: other stages have used its memory before.
PIECES = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows outside the held-out fold and rejects "und" and texts without evidence; null languages get the prediction.
    Null texts and texts without letters go; rows without an id are judged like any other and never trained on; repeated rows stay
    or go together; other columns stay; an empty table stays empty."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("lang", "text"))
    plain, back = aside(docs, "doc_id", "text", "lang")
    found = langid.identify(plain, model)
    unknown = (F.col("lang_pred") == "und") | ((F.col("n_grams") >= LEAST_GRAMS) & (F.col("evidence") < LEAST_EVIDENCE))
    return back(found.filter(~unknown).withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group; of repeated rows one, and a row without an id only where its group has no other.
    Texts without words are copies of each other; columns of any names stay; an empty table stays empty."""
    return simhash.keep_one(docs, radius=2, k=5, threshold=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose words get the rest, joined by spaces, as their text and its length; others stay as they are, also those with
    null or empty texts. Rows without an id and repeated rows repeat each other's windows; other columns stay."""
    plain, back = aside(docs, "doc_id", "text", "n_chars")
    found = substrings.remove_repeats(plain)
    cut = F.col("n_removed") > 0
    found = found.filter(~cut | (F.col("n_removed") < F.col("n_words")))
    found = found.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return back(found)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text leaks an item, judged row by row (by doc_id and text), so that a row without an id doesn't take others along.
    Null and empty texts leak nothing; repeated rows stay or go together; other columns stay; an empty benchmark drops nothing."""
    plain, back = aside(docs, "doc_id", "text")
    rows = plain.withColumn("_key", simhash.row_key())
    leaks = decontaminate.find_leaks(rows.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return back(rows.join(leaks, "_key", "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece; null and empty texts hold the end id only, repeated rows and rows without an id are packed like any other,
    other columns are dropped; an empty table gives no rows."""
    return packing.pack(docs, public_path("word_bpe_49k.json"), pieces=PIECES)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("benchmarks", benchmarks), ("packing", pack)]

#: SimHash links, language models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
