"""Finding keys that occur more than once in the corpus, without gathering a key's occurrences anywhere.

A task first looks at its own batch: keys that repeat there are decided at once, and one entry with count 2 tells the others. Of all other
keys it sends one entry each to the shard of the key's hash. A shard thus gets at most one entry per batch and key, however
often a key occurs, and answers to the documents whose single entries repeat elsewhere.

Entries travel packed: a row holds one batch's entries of one shard as binary arrays, with its documents as a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from kinetext.llm.common import pack_runs, shuffle_partitions, xxhash64

#: kind 0: entries of a shard; kind 1: positions already decided, on their way to their document.
SCHEMA = "shard int, kind int, n int, hashes binary, more binary, times binary, docs binary, codes binary, places binary"
ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("hashes", "more", "times", "docs", "codes", "places")]])
FOUND = "doc_id bigint, _h bigint, runs binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("runs", pa.binary())])
#: Packed answers on their way to the documents: documents, how many places each has, and the places.
SENT = "bucket int, docs binary, numbers binary, places binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("docs", "numbers", "places")]])
NULL_ID = np.iinfo(np.int64).min


class Entries:
    """A batch's entries: hash, second hash, document and place."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.n_docs = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, docs: np.ndarray, h: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
        """docs: (n, 2) of doc_id and _h; ``doc`` counts within them."""
        self.docs.append(docs)
        self.parts.append((h, more.astype(np.uint32), (doc + self.n_docs).astype(np.uint32), place.astype(np.uint32)))
        self.n_docs += len(docs)
        self.size += len(h)

    def rows(self, shards: int, shard_of: Callable[[np.ndarray], np.ndarray] | None = None, sharding: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """The batch's rows. ``sharding``: values that equal keys share, where the shard shouldn't follow from the hash."""
        if not self.size:
            return
        docs = np.concatenate(self.docs)
        h, more, doc, place = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        by = np.concatenate(sharding) if sharding is not None else h
        order = np.lexsort((more, h))
        hs, ms = h[order], more[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ms[1:] != ms[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(hs)))
        many = np.repeat(times > 1, times)
        own = order[first]
        shard = ((by[own] >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        yield from _rows(0, shard, docs, h[own], more[own], np.minimum(times, 2).astype(np.uint8), doc[own], place[own])
        known = order[many]
        if len(known):
            target = (docs[doc[known], 1].view(np.uint64) % np.uint64(shards)).astype(np.int64)
            none = np.zeros(0)
            yield from _rows(1, target, docs, none, none, none, doc[known], place[known])


def _rows(kind: int, shard: np.ndarray, docs: np.ndarray, h: np.ndarray, more: np.ndarray, times: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((place, doc, shard))
    shard, doc, place = shard[order], doc[order], place[order]
    if kind == 0:
        h, more, times = h[order], more[order], times[order]
    bounds = np.append(np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard))
    rows: list[tuple] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        used, codes = np.unique(doc[a:b], return_inverse=True)
        rows.append((int(shard[a]), kind, b - a, h[a:b].tobytes(), more[a:b].tobytes(), times[a:b].tobytes(), docs[used].tobytes(), codes.astype(np.uint32).tobytes(), place[a:b].tobytes()))
        if len(rows) == 64:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def answer(entries: DataFrame, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, _h, runs): for each document with repeated keys their places, as pairs (first, number) of uint32."""
    return gather(sent(entries, decide, shuffle_partitions(entries.sparkSession)))


def bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each document (doc_id, _h); the same as pmod(xxhash64(doc_id, _h), buckets) on Spark, with NULL_ID for nulls."""
    return np.mod(xxhash64(docs[:, 0], docs[:, 1]), buckets)


def sent(entries: DataFrame, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], buckets: int) -> DataFrame:
    """Packed places of repeated keys, by bucket of documents.

    ``decide`` gets a shard's hashes, second hashes and times, and says which of its entries repeat.
    """

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        cols = {c: group[c].to_pylist() for c in group.column_names if c != "shard"}
        own = [k for k, kind in enumerate(cols["kind"]) if kind == 0]
        if own:
            join = lambda c, t: np.frombuffer(b"".join(cols[c][k] for k in own), t)
            times = join("times", np.uint8)
            hit = decide(join("hashes", np.uint64), join("more", np.uint32), times) & (times == 1)
            at = 0
            for k in own:
                m = hit[at : at + cols["n"][k]]
                at += cols["n"][k]
                if m.any():
                    docs = np.frombuffer(cols["docs"][k], np.int64).reshape(-1, 2)
                    out.append((docs[np.frombuffer(cols["codes"][k], np.uint32)[m]], np.frombuffer(cols["places"][k], np.uint32)[m]))
        for k, kind in enumerate(cols["kind"]):
            if kind == 1:
                docs = np.frombuffer(cols["docs"][k], np.int64).reshape(-1, 2)
                out.append((docs[np.frombuffer(cols["codes"][k], np.uint32)], np.frombuffer(cols["places"][k], np.uint32)))
        return _sent(out, buckets)

    return entries.groupBy("shard").applyInArrow(run, SENT)


def _sent(parts: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    """Packed answers, one row per bucket of documents: a document's answers come from many shards."""
    rows: list[tuple] = []
    if parts:
        docs, place = np.concatenate([d for d, _ in parts]), np.concatenate([p for _, p in parts])
        bucket = bucket_of(docs, buckets)
        order = np.lexsort((place, docs[:, 1], docs[:, 0], bucket))
        docs, place, bucket = docs[order], place[order], bucket[order]
        new = np.r_[True, (docs[1:] != docs[:-1]).any(axis=1)]
        cut = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            first = np.flatnonzero(new[a:b])
            rows.append((int(bucket[a]), docs[a:b][first].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), place[a:b].tobytes()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def gather(packed: DataFrame) -> DataFrame:
    """One row per answered document: (doc_id, _h, runs)."""

    def run(group: pa.Table) -> pa.Table:
        found = runs_of(group)
        ids = [None if i == NULL_ID else i for i, _ in found]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "_h": [h for _, h in found], "runs": pa.array(found.values(), pa.binary())}, schema=FOUND_ARROW)

    return packed.groupBy("bucket").applyInArrow(run, FOUND)


def runs_of(packed: pa.Table) -> dict[tuple[int, int], bytes]:
    """The places of each document (doc_id, _h) of a bucket, as runs."""
    docs = np.concatenate([np.zeros((0, 2), np.int64), *[np.frombuffer(v, np.int64).reshape(-1, 2) for v in packed["docs"].to_pylist()]])
    join = lambda c: np.frombuffer(b"".join(packed[c].to_pylist()), np.uint32)
    docs, place = np.repeat(docs, join("numbers"), axis=0), join("places")
    order = np.lexsort((place, docs[:, 1], docs[:, 0]))
    docs, place = docs[order], place[order]
    bounds = np.append(np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]).any(axis=1)]), len(place)).tolist() if len(place) else [0]
    out = {}
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[int(docs[a, 0]), int(docs[a, 1])] = np.stack(pack_runs(np.unique(place[a:b]).astype(np.int64)), axis=1).astype(np.uint32).tobytes()
    return out


def exact(h: np.ndarray, more: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Entries whose key (both hashes) occurs at least twice."""
    order = np.lexsort((more, h))
    hs, ms = h[order], more[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ms[1:] != ms[:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=times[order])
    out = np.empty(len(hs), bool)
    out[order] = total[group] >= 2
    return out


class Sketch:
    """A task's count-min sketch, sparse: for each shard of the keys ``DEPTH`` rows of ``width`` cells, of which the used ones travel.

    Cells are listed by bucket of the documents that hold their keys, which is where the merged counts go. Keys themselves never travel.
    """

    SCHEMA = "shard int, row int, buckets binary, sizes binary, cells binary, counts binary"
    ARROW = pa.schema([("shard", pa.int32()), ("row", pa.int32()), *[(c, pa.binary()) for c in ("buckets", "sizes", "cells", "counts")]])
    #: Cells with a merged count of 2 or more, on their way to the documents' bucket.
    MERGED = "bucket int, shard int, row int, cells binary"
    MERGED_ARROW = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("row", pa.int32()), ("cells", pa.binary())])
    DEPTH, LOAD = 2, 8
    _MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]

    def __init__(self, shards: int, width: int):
        self.shards, self.width = shards, width
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    @staticmethod
    def width_for(keys: float) -> int:
        """A power of two of LOAD cells per key that a shard is expected to get; more keys than expected only raise the estimates."""
        return 1 << min(31, max(10, int(Sketch.LOAD * keys).bit_length()))

    def shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int64)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return ((h * self._MULTIPLIERS[row]) >> np.uint64(65 - self.width.bit_length())).astype(np.uint32)

    def add(self, h: np.ndarray, bucket: np.ndarray) -> None:
        self.parts.append((h, bucket))
        self.size += len(h)

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        h, bucket = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        spot = (self.shard(h) * buckets + bucket).astype(np.uint64) << np.uint64(32)
        rows: list[tuple] = []
        for row in range(self.DEPTH):
            key, n = np.unique(spot | self.cells(h, row), return_counts=True)
            at, cell, n = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), np.minimum(n, 2).astype(np.uint8)
            cut = np.append(np.flatnonzero(np.r_[True, at[1:] // buckets != at[:-1] // buckets]), len(at)).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                first = np.flatnonzero(np.r_[True, at[a + 1 : b] != at[a : b - 1]])
                rows.append((int(at[a] // buckets), row, (at[a:b][first] % buckets).astype(np.uint32).tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), cell[a:b].tobytes(), n[a:b].tobytes()))
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 64], strict=True), self.ARROW, strict=True)], schema=self.ARROW)

    @staticmethod
    def merge(group: pa.Table, width: int) -> pa.Table:
        """Adds up the sketches of all tasks for one shard; gives each bucket those of its cells that count 2 or more."""
        rows: list[tuple] = []
        for row in range(Sketch.DEPTH):
            own = group.filter(pa.compute.equal(group["row"], row))
            join = lambda c, d: np.frombuffer(b"".join(own[c].to_pylist()), d)  # noqa: B023, E731
            cells, table = join("cells", np.uint32), np.zeros(width, np.uint32)
            np.add.at(table, cells, join("counts", np.uint8).astype(np.uint32))
            bucket = np.repeat(join("buckets", np.uint32), join("sizes", np.uint32))
            hit = table[cells] >= 2
            key = np.unique(bucket[hit].astype(np.uint64) << np.uint64(32) | cells[hit])
            at, cell = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
            cut = np.append(np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)).tolist() if len(at) else [0]
            rows += [(int(at[a]), int(own["shard"][0].as_py()), row, cell[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, Sketch.MERGED_ARROW, strict=True)], schema=Sketch.MERGED_ARROW)

    def suspects(self, merged: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
        """Of a bucket's merged cells: a function that tells which keys have an estimate of 2 or more."""
        known = []
        for row in range(self.DEPTH):
            own = merged.filter(pa.compute.equal(merged["row"], row))
            known.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(c, np.uint32) | np.uint64(s) << np.uint64(32) for s, c in zip(own["shard"].to_pylist(), own["cells"].to_pylist(), strict=True)]])))

        def test(h: np.ndarray) -> np.ndarray:
            hit = np.ones(len(h), bool)
            shard = self.shard(h).astype(np.uint64) << np.uint64(32)
            for row, cells in enumerate(known):
                key = shard | self.cells(h, row)
                at = np.searchsorted(cells, key)
                hit &= np.append(cells, np.uint64(0))[at] == key if len(cells) else False
            return hit

        return test


def covered(runs: list[bytes], n: int, width: int) -> np.ndarray:
    """Which of ``n`` items lie in a window of ``width`` that starts at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        pairs = np.frombuffer(r, np.uint32).reshape(-1, 2).astype(np.int64)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, np.minimum(pairs[:, 0] + pairs[:, 1] - 1 + width, n), -1)
    return np.cumsum(edge[:n]) > 0
