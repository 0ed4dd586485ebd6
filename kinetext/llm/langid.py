"""Language identification by bit-sliced Bloom filters over character n-grams.

Training counts the n-grams (four bytes, taken as they are) of all training rows by language, on Spark. A language keeps an n-gram
that makes up at least ``MIN_RATE`` of its n-grams there and at least ``dominance`` of the highest rate in any language. The kept n-grams
of all languages go into one filter whose slots are bitmasks over the languages: a query ANDs the masks of its slots and learns at
once which languages hold the n-gram. A text's hits are counted by language, corrected for the filter's false positives (their rate is
measured with keys that no n-gram has), and the largest count decides.

The driver gets the filter in pieces of ``PIECE`` slots and a row per language: bounded by ``MOST_LANGS`` and ``MOST_SLOTS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetext.llm.common import batch, map_arrow, materialize, mix, table

N = 4
#: Languages at most (those with most n-grams; others are never predicted), slots at least and at most, slots of a piece, hash functions.
MOST_LANGS, LEAST_SLOTS, MOST_SLOTS, PIECE, HASHES = 512, 1 << 16, 1 << 22, 1 << 12, 3
#: An n-gram is kept from so many occurrences on, and from such a share on: a language keeps at most 1 / MIN_RATE of them.
MIN_COUNT, MIN_RATE, DOMINANCE = 3, 1e-6, 0.5
#: Counts that a task holds before it sends them on, and keys that measure the rate of false positives.
HELD, PROBES = 1_000_000, 1 << 17

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (four bytes of lower-cased words with their edges) of all texts, and how many each text has."""
    raw = [t.lower().encode() for t in texts]
    buf = _FOLD[np.frombuffer(b"   " + b"   ".join(raw) + b"   ", np.uint8)]
    n = len(buf) - N + 1
    key = buf[:n].astype(np.uint32)
    for i in range(1, N):
        key |= buf[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    good = (buf[1 : n + 1] != 0x20) & (buf[2 : n + 2] != 0x20)  # at most the edges are beyond the word
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes + 3)
    at = np.concatenate([[0], np.cumsum(good)])
    per = np.diff(at[np.concatenate([[0], np.minimum(ends, n)])])
    return key[good][: int(per.sum())], per


def _rows(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters."""
    start, size = 0, 0
    for i, t in enumerate(column):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column)


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows with a language; counted in each task first."""
    out = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def total() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            new, at = np.unique(key, return_inverse=True)
            return new, np.bincount(at, weights=n, minlength=len(new)).astype(np.int64)

        def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            said = np.array(list(names), object)
            for a in range(0, len(key), 100_000):
                k = key[a : a + 100_000]
                yield batch(out, lang=said[(k >> np.uint64(32)).astype(np.int64)], gram=(k & np.uint64(0xFFFFFFFF)).astype(np.int64), n=n[a : a + 100_000])

        for b in batches:
            for i, j in _rows(b.column(1)):
                of = np.array([names.setdefault(x, len(names)) for x in b.column(0).slice(i, j - i).to_pylist()], np.uint64)
                ids, per = gram_ids([t or "" for t in b.column(1).slice(i, j - i).to_pylist()])
                held.append(np.unique(np.repeat(of, per) << np.uint64(32) | ids, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [total()]
                if len(held[0][0]) > HELD // 2:
                    yield from rows(*held[0])
                    held = []
        if held:
            yield from rows(*total())

    pairs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return map_arrow(pairs, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages (sorted), for each 64 of them a filter of bitmasks, the measured rate of false positives of each, and the commonest one."""

    langs: list[str]
    slots: np.ndarray  # (words of 64 languages, slots: a power of two)
    common: str

    def __post_init__(self):
        # Keys over 32 bits: no n-gram has them.
        keys = np.arange(PROBES, dtype=np.uint64) | np.uint64(1 << 40)
        masks = self.masks(keys)
        self.rate = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / PROBES for k in range(len(self.langs))])

    def masks(self, ids: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that hold it, as bits; a row for each 64 languages."""
        at = places(ids, self.slots.shape[1])
        out = self.slots[:, at[0]]
        for k in range(1, HASHES):
            out &= self.slots[:, at[k]]
        return out

    @staticmethod
    def fit(counts: DataFrame, min_count: int = MIN_COUNT, min_rate: float = MIN_RATE, dominance: float = DOMINANCE) -> Model:
        """From all counts (lang, gram, n); which n-grams a language keeps is decided on Spark."""
        counts = materialize(counts, "grams")
        found = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
        langs = sorted(r.lang for r in found)
        if not langs:
            return Model([], np.zeros((1, LEAST_SLOTS), np.uint64), "und")
        spark = counts.sparkSession
        totals = spark.createDataFrame([(r.lang, langs.index(r.lang), r.n) for r in found], "lang string, k int, total bigint")
        share = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
        kept = share.withColumn("best", F.max("share").over(Window.partitionBy("gram"))).filter((F.col("n") >= min_count) & (F.col("share") >= min_rate) & (F.col("share") >= dominance * F.col("best")))
        kept = materialize(kept.select("gram", "k"), "kept")
        n = kept.agg(F.count_distinct("gram").alias("n")).first().n
        size = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (6 * n).bit_length()))
        slots = np.zeros((-(-len(langs) // 64), size), np.uint64)
        for r in _pieces(kept, size).collect():
            slots[r.word, r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.masks, np.uint64)
        return Model(langs, slots, found[0].lang)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (the winner's share of all corrected hits), evidence (its share of the n-grams) and the number of n-grams."""
        ids, per = gram_ids([t or "" for t in texts])
        first = np.concatenate([[0], np.cumsum(per)])
        hits = np.zeros((len(self.langs), len(texts)))
        for w, mask in enumerate(self.masks(ids.astype(np.uint64)) if self.langs else []):
            for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                bit = (mask >> np.uint64(k % 64)) & np.uint64(1)
                found = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                hits[k] = np.diff(found[first])
        hits = np.maximum(0.0, (hits - per * self.rate[:, None]) / np.maximum(1e-9, 1 - self.rate[:, None])) if self.langs else hits
        best = hits.argmax(axis=0) if self.langs else np.zeros(len(texts), int)
        top = hits.max(axis=0) if self.langs else np.zeros(len(texts))
        total = hits.sum(axis=0)
        langs = [("und" if not has_letter(t) else self.langs[b] if h > 0 else self.common) for t, b, h in zip(texts, best, top, strict=True)]
        und = np.array([x == "und" for x in langs], bool)
        score = np.where((total > 0) & ~und, top / np.maximum(total, 1e-9), 0.0)
        return langs, np.clip(score, 0, 1), np.where(und, 0.0, np.clip(top / np.maximum(per, 1), 0, 1)), per


def places(ids: np.ndarray, slots: int) -> np.ndarray:
    """The filter's slots of each key (64 bits), one row per hash function."""
    a = mix(ids + np.uint64(1))
    b = mix(ids ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return np.stack([((a + np.uint64(k) * b) >> np.uint64(65 - slots.bit_length())).astype(np.int64) for k in range(HASHES)])


def _pieces(kept: DataFrame, size: int) -> DataFrame:
    """(word, piece, masks): the filter of ``kept`` (gram, k), by pieces of PIECE slots that hold anything."""
    sent = pa.schema([("word", pa.int32()), ("piece", pa.int32()), ("slots", pa.binary()), ("masks", pa.binary())])
    whole = pa.schema([("word", pa.int32()), ("piece", pa.int32()), ("masks", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(1).to_numpy().astype(np.int64)
            at = places(b.column(0).to_numpy().astype(np.uint64), size).ravel()
            word, mask = np.tile(k // 64, HASHES), np.tile(np.uint64(1) << (k % 64).astype(np.uint64), HASHES)
            order = np.lexsort((at, word))
            at, word, mask = at[order], word[order], mask[order]
            cut = np.append(np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (at[1:] // PIECE != at[:-1] // PIECE)]), len(at)).tolist() if len(at) else [0]
            own = list(zip(cut[:-1], cut[1:], strict=True))
            yield batch(sent, word=[int(word[x]) for x, _ in own], piece=[int(at[x] // PIECE) for x, _ in own], slots=[(at[x:y] % PIECE).astype(np.uint16).tobytes() for x, y in own], masks=[mask[x:y].tobytes() for x, y in own])

    def union(group: pa.Table) -> pa.Table:
        masks = np.zeros(PIECE, np.uint64)
        for s, m in zip(group["slots"].to_pylist(), group["masks"].to_pylist(), strict=True):
            np.bitwise_or.at(masks, np.frombuffer(s, np.uint16), np.frombuffer(m, np.uint64))
        return pa.table({"word": group["word"][:1], "piece": group["piece"][:1], "masks": pa.array([masks.tobytes()], pa.binary())}, schema=whole)

    return map_arrow(kept.select("gram", "k"), place, "word int, piece int, slots binary, masks binary", rows=0).groupBy("word", "piece").applyInArrow(union, "word int, piece int, masks binary")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that training never sees: crc32 of doc_id as text is a multiple of ``folds`` (a null doc_id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame) -> Model:
    """Fits on all rows of ``docs`` (lang, text) with a language; without any, the model says "und" for every text."""
    return Model.fit(count_grams(docs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, evidence and n_grams; "und" for null texts and texts without a letter, with score 0.

    Whole texts are read. Columns of those names are replaced; ties go to the first language in order; texts with letters but
    without a known n-gram get the commonest language with score 0; repeated rows stay; empty tables stay empty.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "evidence", "n_grams")]
    schema = docs.select(*kept).schema
    at = kept.index("text")
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", lang_pred string, score double, evidence double, n_grams bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _rows(b.column(at)):
                part = b.slice(i, j - i)
                langs, score, evidence, n = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(evidence, pa.float64()), pa.array(n, pa.int64())], names=[*part.schema.names, "lang_pred", "score", "evidence", "n_grams"])

    return map_arrow(docs.select(*kept), run, spec)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = train(docs.filter(~out).select("lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "evidence", "n_grams")
