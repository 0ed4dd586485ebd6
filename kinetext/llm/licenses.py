"""License scan by diagonal voting, in DataFrame operations only.

All rolling word k-grams of the texts are hashed and joined with the positions of the same k-grams in license templates. A match at
word ``pos`` of the text and ``tpos`` of the template votes for the diagonal ``pos - tpos``. Votes are counted by diagonal,
diagonals that lie within ``slack`` words of the next are merged (insertions and deletions move the diagonal), and
a merged span stands if it covers enough of the template densely enough. Short phrases stand at
each diagonal that holds all their k-grams.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetext.llm.common import key_of, table

#: Runs of digits, ASCII letters and characters beyond ASCII, on lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]

#: Template k-grams are broadcast up to this many, and joined by an exchange beyond.
MOST_GRAMS = 100_000


def words(text: Column) -> Column:
    """The words of a text (null: none), lower-cased in A-Z only: other characters that fold to a Latin letter don't become one."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def gram_rows(w: Column, k: int) -> Column:
    """For each word the struct (w0, ..., w{k-1}) of it and the words after it; null where the text ends."""
    return F.arrays_zip(w.alias("w0"), *[F.slice(w, i + 1, F.size(w)).alias(f"w{i}") for i in range(1, k)])


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int) -> DataFrame:
    """One row per distinct k-gram: its hash, its words, and the places (template, tpos) that hold it."""
    rows = []
    for t, (_, text, _) in enumerate(templates):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        if len(own) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        rows += [(*own[i : i + k], t, i) for i in range(len(own) - k + 1)]
    names = [f"t{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", template int, tpos int")
    return df.groupBy(*names).agg(F.collect_list(F.struct("template", "tpos")).alias("places")).withColumn("gram", F.xxhash64(*names)).hint("broadcast" if len(rows) <= MOST_GRAMS else "shuffle_hash")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, k: int = 3, slack: int = 3, min_coverage: float = 0.5, min_density: float = 0.5) -> DataFrame:
    """Per document: n_words, spans (label, phrase or not, first word, words, coverage) and score.

    ``docs`` has doc_id and text; other columns are dropped first, so their names can't clash. Null and empty texts have no
    words and no spans; a null doc_id is a document like any other; rows that share doc_id and text give as
    many equal rows; an empty table gives no rows. Equal spans of one label are listed once per place.
    """
    spark = docs.sparkSession
    both = [(n, t, True) for n, t in phrases] + [(n, t, False) for n, t in templates]
    grams = template_grams(spark, both, k)
    about = F.create_map(*[x for t, (_, text, _) in enumerate(both) for x in (F.lit(t), F.lit(len(text.split()) - k + 1))])
    label = F.create_map(*[x for t, (name, _, _) in enumerate(both) for x in (F.lit(t), F.lit(name))])

    base = key_of(docs.select("doc_id", "text")).select("doc_id", "_h", words(F.col("text")).alias("w"))
    # One pass over the words: a row for each k-gram; those without a match go at once, but for the first of each document.
    rows = base.select("doc_id", "_h", F.size("w").alias("n_words"), F.posexplode_outer(gram_rows(F.col("w"), k)).alias("pos", "g"))
    rows = rows.select("doc_id", "_h", "n_words", "pos", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(k)]).withColumn("gram", F.xxhash64(*[f"w{i}" for i in range(k)]))
    same = (F.col("r.gram") == F.col("t.gram")) & F.col(f"w{k - 1}").isNotNull()
    for i in range(k):
        same &= F.col(f"w{i}") == F.col(f"t{i}")
    hits = rows.alias("r").join(grams.alias("t"), same, "left")
    hits = hits.filter(F.col("places").isNotNull() | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
    hits = hits.select("doc_id", "_h", "n_words", "pos", "places").repartition("doc_id", "_h")
    hits = hits.select("doc_id", "_h", "n_words", "pos", F.posexplode_outer("places").alias("place", "p"))
    # A document's first row also counts its repeats.
    first = (F.coalesce(F.col("pos"), F.lit(0)) == 0) & (F.coalesce(F.col("place"), F.lit(0)) == 0)
    hits = hits.select("doc_id", "_h", "n_words", "pos", F.col("p.template").alias("template"), F.col("p.tpos").alias("tpos"), first.cast("long").alias("times"))

    # A document's rows lie together from here on: no further exchange.
    key = ["doc_id", "_h", "n_words"]
    votes = hits.groupBy(*key, "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("tset"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("times").alias("times")
    )
    w = Window.partitionBy(*key, "template").orderBy("diagonal")
    phrase = F.col("template") < len(phrases)
    opens = F.when(phrase | (F.col("diagonal") - F.lag("diagonal").over(w) > slack), 1).otherwise(0)
    spans = votes.withColumn("opens", opens).withColumn("span", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "template", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("tset"))).alias("tset"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("times").alias("times")
    )
    grams_of, covered = about[F.col("template")], F.size("tset")
    spans = spans.withColumn("coverage", F.when(F.col("template").isNotNull(), covered / grams_of))
    stands = F.when(F.col("template").isNull(), False).when(phrase, F.col("coverage") == 1.0).otherwise(
        (F.col("coverage") >= min_coverage) & (covered >= min_density * (F.col("hi") - F.col("lo") + 1))
    )
    span = F.struct(
        label[F.col("template")].alias("label"), phrase.alias("phrase"), F.col("lo").cast("long").alias("first_word"),
        (F.col("hi") - F.col("lo") + k).cast("long").alias("n_words"), F.col("coverage"),
    )
    out = spans.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(stands, span))).alias("spans"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"), F.sum("times").cast("int").alias("times")
    )
    return out.select("doc_id", "n_words", "spans", "score", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["first_word"])
    names = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.col("score").cast("double").alias("score"),
    )
