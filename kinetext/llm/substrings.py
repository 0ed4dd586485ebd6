"""Removal of word windows that repeat anywhere in the corpus, with a count-min prefilter.

A window is ``width`` consecutive words. Its anchor is the smallest hash among the runs of ``anchor`` words in it, so equal windows have
equal anchors, and a window occurs at most as often as its anchor: counting anchors bounds the counts of all windows from above
with a tenth of the entries.

Pass 1: each task counts its anchors in a count-min sketch of its own, sparse and cut into shards of cells; shards add the
tasks' sketches cell by cell, and each bucket of documents gets those of its cells that count 2 or more. Two equal anchors raise
the same cells of both rows, so the estimate never counts too few and no repeated window is lost. The sketches' width follows the
bytes of all texts, and no key or place travels.
Pass 2: buckets of documents test their anchors against the merged cells and send the windows of suspect anchors only, which are
grouped exactly (by 96 bits of hash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm import repeats
from kinetext.llm.common import SECOND_BASE, aside, gram_hashes, key_of, map_arrow, materialize, minimizers, runs_of_rows, ship, shuffle_partitions, table, texts_of, word_bounds, word_hashes

WIDTH, ANCHOR = 35, 18
#: Entries that a task holds before it sends them on, and bytes of text in a bucket of documents.
HELD, BUCKET = 1_000_000, 1 << 23


class Words:
    """The words of a run of texts, their windows and each window's anchor."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, width: int, anchor: int):
        starts, ends = word_bounds(buf, off[:-1][off[:-1] < len(buf)])
        self.h = word_hashes(buf, starts, ends)
        self.first = np.searchsorted(starts, off)  # of each text, and the end
        self.grams = gram_hashes(self.h, anchor)
        at = minimizers(self.grams, width - anchor + 1)
        n = np.maximum(np.diff(self.first) - width + 1, 0)  # windows of each text
        self.doc = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.window = self.first[:-1][self.doc] + self.place
        self.anchor = at[self.window] if len(self.window) else np.zeros(0, np.int64)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    ids = b.column("doc_id").cast(pa.int64()).fill_null(int(repeats.NULL_ID)).to_numpy(zero_copy_only=False)
    return np.stack([ids, b.column("_h").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)


def _keys(b: pa.RecordBatch, i: int, j: int) -> np.ndarray:
    ids = b.column(0).slice(i, j - i).cast(pa.int64()).fill_null(int(repeats.NULL_ID)).to_numpy(zero_copy_only=False)
    return np.stack([ids, b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """Every row of ``docs`` with ``kept`` (words that no repeated window covers, joined by one space), n_words and n_removed.

    Null and empty texts have no words; texts under ``width`` words keep all; null doc_ids and repeated rows take part like any other
    (a repeated row repeats all its windows); other columns stay, those named kept, n_words or n_removed are replaced;
    empty tables stay empty.
    """
    plain, back = aside(docs, "doc_id", "text")
    spark = docs.sparkSession
    ship(spark)
    shards = shuffle_partitions(spark)
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    # Buckets are read as a whole; several to a partition, so that partitions are of equal size.
    buckets = max(4 * shards, size // BUCKET)
    # An anchor per half a window of words, of six bytes each.
    cells = repeats.Sketch.width_for(size / (6 * (width - anchor + 2) / 2) / shards)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(repeats.NULL_ID))), "_h")
    base = key_of(plain).withColumn("_bucket", F.pmod(key, F.lit(buckets)).cast("int"))
    keep = plain.columns

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = repeats.Sketch(shards, cells)
        for b in batches:
            buf, off = texts_of(b.column(0))
            bucket = b.column(1).to_numpy()
            for i, j in runs_of_rows(off, 1 << 20):
                w = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], width, anchor)
                if len(w.anchor):
                    own = w.anchor[np.r_[True, w.anchor[1:] != w.anchor[:-1]]]
                    # texts without words share a first word with the next one
                    held.add(w.grams[own], bucket[i:j][np.searchsorted(w.first, own, "right") - 1])
                if held.size >= HELD:
                    yield from held.rows(buckets)
                    held = repeats.Sketch(shards, cells)
        yield from held.rows(buckets)

    def windows(rows: pa.Table, merged: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        held, by = repeats.Entries(), []
        suspect = repeats.Sketch(shards, cells).suspects(merged) if merged.num_rows else None
        for b in rows.to_batches() if suspect else []:
            buf, off = texts_of(b.column("text"))
            ids = _ids(b)
            for i, j in runs_of_rows(off, 1 << 20):
                w = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], width, anchor)
                own = np.flatnonzero(suspect(w.grams)[w.anchor]) if len(w.anchor) else []
                if len(own):
                    at = w.window[own]
                    held.add(ids[i:j], gram_hashes(w.h, width)[at], gram_hashes(w.h, width, SECOND_BASE)[at] >> np.uint64(32), w.doc[own], w.place[own])
                    by.append(w.grams[w.anchor[own]])  # equal windows have equal anchors; neighbours mostly share one
                if held.size >= HELD:
                    out += held.rows(shards, sharding=by)
                    held, by = repeats.Entries(), []
        if by:
            out += held.rows(shards, sharding=by)
        return pa.Table.from_batches(out, schema=repeats.ARROW)

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", kept string, n_words bigint, n_removed bigint"

    def apply(rows: pa.Table, starts: pa.Table) -> pa.Table:
        runs = repeats.runs_of(starts)
        out: list[pa.RecordBatch] = []
        for b in rows.to_batches():
            kept, n, gone = [], [], []
            for t, i in zip(b.column("text"), map(tuple, _ids(b).tolist()), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                n.append(len(words))
                if i in runs:
                    cover = repeats.covered([runs[i]], len(words), width)
                    words = [w for w, o in zip(words, cover.tolist(), strict=True) if not o]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            out.append(pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, "kept", "n_words", "n_removed"]))
        return pa.Table.from_batches(out)

    by_bucket = lambda df: df.groupBy("_bucket")
    sketches = map_arrow(base.select("text", "_bucket"), sketch, repeats.Sketch.SCHEMA)
    merged = materialize(sketches.groupBy("shard").applyInArrow(lambda g: repeats.Sketch.merge(g, cells), repeats.Sketch.MERGED), "merged").withColumnRenamed("bucket", "_bucket")
    entries = by_bucket(base).cogroup(by_bucket(merged)).applyInArrow(windows, repeats.SCHEMA)
    starts = repeats.sent(entries, repeats.exact, buckets).withColumnRenamed("bucket", "_bucket")
    return back(by_bucket(base).cogroup(by_bucket(starts)).applyInArrow(apply, spec), "kept", "n_words", "n_removed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
