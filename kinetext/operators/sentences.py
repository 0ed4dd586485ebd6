"""Splitting texts into ordered sentences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetext.operators.embedding import of_worker


#: Periods after these don't end a sentence; nor do those after a single capital letter.
ABBREVIATIONS = "Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|vs|etc|approx|cf|Fig|No|Vol|Inc|Ltd|Co|Corp|dept|e\\.g|i\\.e|a\\.m|p\\.m|U\\.S"
#: In this order: hold periods of abbreviations and initials, mark the ends (closing marks and quotes before white space).
HOLD = (rf"(^|[^\p{{L}}\p{{N}}])({ABBREVIATIONS}|\p{{Lu}})\.", "$1$2\u0001")
MARK = (r"([.!?]+[\"'”’»)\]]*)\s+", "$1\u0002")


def regex_sentences(text: Column) -> Column:
    """Runs up to and with ``.``, ``!`` or ``?`` before white space or the end, white space collapsed and trimmed; runs without a
    letter or digit are dropped. Decimals, initials and common abbreviations don't end a sentence."""
    held = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(HOLD[0]), F.lit(HOLD[1]))
    found = F.split(F.regexp_replace(held, F.lit(MARK[0]), F.lit(MARK[1])), "\u0002")
    said = F.transform(found, lambda s: F.replace(F.trim(F.regexp_replace(s, F.lit(r"\s+"), F.lit(" "))), F.lit("\u0001"), F.lit(".")))
    return F.filter(said, lambda s: F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")))


def parser_sentences(model: str = "en_core_web_sm", load=None) -> Callable[[Column], Column]:
    """A splitter that asks a parser, loaded once in each Python worker: ``load()`` gives a function from a text to its sentences.

    Without ``load`` the named spaCy model is taken, where that package is installed on the workers.
    """

    @F.pandas_udf("array<string>")
    def ask(texts: pd.Series) -> pd.Series:
        parsers = of_worker("parsers")
        if model not in parsers:
            if load is None:
                import spacy

                nlp = spacy.load(model)
                parsers[model] = lambda t: [s.text for s in nlp(t).sents]
            else:
                parsers[model] = load()
        return texts.fillna("").map(lambda t: [s.strip() for s in parsers[model](t) if s.strip()])

    return ask


def split(docs: DataFrame, splitter: Callable[[Column], Column] = regex_sentences, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, pos, sentence): ``splitter`` makes an array of sentences of a text column; any other one can take its place."""
    return docs.select(*keys, F.posexplode(splitter(F.col(text))).alias("pos", "sentence"))
