"""Removal of byte strings that started earlier in the corpus, by a hash-compared suffix sort.

Remove each byte that a ``WIDTH``-byte string covers which also starts earlier (smaller doc_id, or the same document and an earlier byte).

1. Anchors. A window's anchor is the smallest hash among its grams of ``GRAM`` bytes; equal windows have equal anchors at equal
   offsets, and each anchor owns the windows that chose it. Its surroundings are all bytes that these windows can reach; anchors of one
   gram and one hash of surroundings (64 bits each) are a class. Tasks send one entry per class. A class that occurs again gets the
   code CLASS everywhere; of a gram with several classes, the first of each class gets PART as well.
2. Classes. Every member of a class sends its surroundings (once per task), and members are compared byte by byte with the class's
   first: all windows of equal later ones are repeats. No hash decides that alone.
3. Suffix sort. The texts of the classes of one gram meet. Their suffixes from the anchor on, and their reversed prefixes
   before it, are mergesorted; a comparison finds the common extension by binary search over prefix polynomial hashes,
   and the extensions of neighbours are verified byte by byte. Two texts share the window that starts ``t`` bytes
   before the anchor if they fall into one interval of extension ``WIDTH`` - t to the right and t to the left.
4. Grams with very many classes (one passage in very many places) are split: instead of by gram, their windows meet by a hash of the
   window (code SPREAD), which finds the same repeats; a window that occurs again is a class of its own, verified as in 2.

Equal keys of a task are settled inside it first, so no shard receives a key more often than there are tasks. Order is by
(doc_id, hash of the text, place); rows equal in both are one document and no repeats of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm import repeats
from kinetext.llm.common import _B1, _B2, _LUT, inverse, key_of, map_arrow, materialize, mix, powers, runs_of_rows, shuffle_partitions, table, texts_of
from kinetext.llm.substrings import _keys

WIDTH, GRAM = 100, 32
HELD, SEGMENT, HOT, MANY = 1_000_000, 1 << 21, 64, 4096
#: Surroundings that a task holds before it sends them on, and the bytes of one: offset of the anchor, length, and the text.
HELD_TEXTS, ROW = 1 << 16, 2 + 2 * WIDTH - GRAM
CLASS, PART, SPREAD = 1, 2, 4
#: Kinds of rows in the second exchange: texts of parts, classes, windows that are settled.
PARTS, CLASSES, SETTLED = 0, 1, 2
_POS = np.uint64((1 << 22) - 1)

ENTRY = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("hashes", "more", "flags", "docs", "codes", "places", "shapes", "texts")]])
ENTRY_DDL = "shard int, kind int, n int, hashes binary, more binary, flags binary, docs binary, codes binary, places binary, shapes binary, texts binary"


class Segment:
    """Windows of some texts (or of a part of one long text) and their anchors; positions count from the texts' starts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, shift: int = 0, first: int = 0, windows: int | None = None):
        """``shift``: where ``buf`` starts in its text; windows start at ``first`` at least, ``windows`` of them at most."""
        self.buf, self.off, self.shift = buf, off, shift
        lens = np.diff(off)
        n = np.maximum(lens - WIDTH + 1, 0)
        start = np.zeros(len(n), np.int64)
        if windows is not None:
            start[:] = first
            n = np.minimum(np.maximum(n - first, 0), windows)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + (off[:-1] + start)[doc]
        if not len(at):
            self.anchor = np.zeros(0, np.int64)
            return
        v = _LUT[buf]
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(v * powers(inverse(_B1), len(buf)), out=self.prefix[1:])
        m = len(buf) - GRAM + 1
        g = mix((self.prefix[GRAM:] - self.prefix[:-GRAM]) * powers(_B1, m))
        w = WIDTH - GRAM + 1
        best, size = (g & ~_POS) | np.arange(m, dtype=np.uint64), 1
        while size * 2 <= w:
            best, size = np.minimum(best[:-size], best[size:]), size * 2
        k = m - w + 1
        chosen = (np.minimum(best[:k], best[w - size : w - size + k])[at] & _POS).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])])
        self.anchor, self.doc = chosen[edge], doc[edge]
        self.low, self.high = at[edge], at[np.r_[edge[1:], len(at)] - 1]  # its first and last own window
        self.gram = g[self.anchor]
        self.place = self.anchor - off[:-1][self.doc] + shift

    def reach(self, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of all bytes that windows with the anchors ``at`` can reach, cut at the text's ends."""
        anchor, doc = self.anchor[at], self.doc[at]
        return np.maximum(anchor - (WIDTH - GRAM), self.off[:-1][doc]), np.minimum(anchor + WIDTH, self.off[1:][doc])

    def surroundings(self) -> np.ndarray:
        """A 64-bit hash of the bytes within reach (by another polynomial than the gram's)."""
        lo, hi = self.reach()
        second = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_LUT[self.buf] * powers(inverse(_B2), len(self.buf)), out=second[1:])
        h = (second[hi] - second[lo]) * powers(_B2, len(self.buf) + 1)[lo]
        return mix(h + (hi - lo).astype(np.uint64) * _B1 + (self.anchor - lo).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))

    def windows(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of all windows of the anchors ``own``, and whose each is."""
        n = self.high[own] - self.low[own] + 1
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.low[own], n), np.repeat(own, n)

    def rows(self, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """The bytes from ``lo`` to ``hi`` as rows of ROW bytes, after the anchor's offset and the length."""
        at = lo[:, None] + np.arange(ROW - 2)
        text = np.where(at < hi[:, None], self.buf[np.minimum(at, len(self.buf) - 1)], 0).astype(np.uint8)
        return np.concatenate([np.stack([anchor - lo, hi - lo], axis=1).astype(np.uint8), text], axis=1)


def segments(b: pa.RecordBatch) -> Iterator[tuple[int, int, Segment]]:
    """Rows i to j and their segment. Texts over SEGMENT bytes are read in parts that reach as far as the surroundings."""
    buf, off = texts_of(b.column(1))
    for i, j in runs_of_rows(off, min(1 << 20, SEGMENT)):
        size = int(off[j] - off[i])
        if size <= SEGMENT:
            yield i, j, Segment(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            continue
        text, reach = buf[off[i] : off[j]], WIDTH
        for a in range(0, size - WIDTH + 1, SEGMENT // 2):
            lo, hi = max(0, a - reach), min(size, a + SEGMENT // 2 + WIDTH + reach)
            yield i, j, Segment(text[lo:hi], np.array([0, hi - lo]), lo, a - lo, SEGMENT // 2)


def packed(text: bytes) -> bytes:
    """Texts on their way to a shard: their length (8 bytes) and their bytes, compressed."""
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True) if text else b""


def unpacked(sent: bytes) -> bytes:
    return pa.decompress(sent[8:], int.from_bytes(sent[:8], "little"), "zstd", asbytes=True) if sent else b""


def _pack(kind: int, shard: np.ndarray, docs: np.ndarray, doc: np.ndarray, place: np.ndarray, h: np.ndarray | None = None, more: np.ndarray | None = None, flags: np.ndarray | None = None, shapes: np.ndarray | None = None, texts: list[bytes] | np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    order = np.lexsort((place, doc, shard))
    shard, doc, place = shard[order], doc[order], place[order]
    cut = np.append(np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)).tolist()
    rows: list[tuple] = []
    part = lambda x, a, b: b"" if x is None else x[order[a:b]].tobytes()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        used, codes = np.unique(doc[a:b], return_inverse=True)
        rows.append((int(shard[a]), kind, b - a, part(h, a, b), part(more, a, b), part(flags, a, b), docs[used].tobytes(), codes.astype(np.uint32).tobytes(), place[a:b].astype(np.uint32).tobytes(), part(shapes, a, b), packed(b"".join([texts[k] for k in order[a:b].tolist()]) if isinstance(texts, list) else part(texts, a, b))))
        if len(rows) == 32:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _home(docs: np.ndarray, doc: np.ndarray, shards: int) -> np.ndarray:
    return (docs[doc, 1].view(np.uint64) % np.uint64(shards)).astype(np.int64)


def _ranks(docs: np.ndarray) -> np.ndarray:
    """Dense ranks of documents by (doc_id, _h); equal ones share a rank."""
    order = np.lexsort((docs[:, 1], docs[:, 0]))
    new = np.r_[False, (docs[order][1:] != docs[order][:-1]).any(axis=1)] if len(docs) else np.zeros(0, bool)
    rank = np.empty(len(docs), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _unpack(group: pa.Table, kind: int) -> dict | None:
    """All entries of a kind in a shard: arrays, with ``docs`` as (doc_id, _h) of each entry."""
    t = group.filter(pa.compute.equal(group["kind"], kind))
    if not t.num_rows:
        return None
    col = lambda c, d: np.frombuffer(b"".join(t[c].to_pylist()), d)
    docs = np.concatenate([np.frombuffer(d, np.int64).reshape(-1, 2)[np.frombuffer(c, np.uint32)] for d, c in zip(t["docs"].to_pylist(), t["codes"].to_pylist(), strict=True)])
    return {"docs": docs, "place": col("places", np.uint32).astype(np.int64), "h": col("hashes", np.uint64), "more": col("more", np.uint64), "flags": col("flags", np.uint8), "shapes": col("shapes", np.uint8).reshape(-1, 4), "text": b"".join(map(unpacked, t["texts"].to_pylist()))}


def _order_keys(docs: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (_ranks(docs).astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)


def settle(h: np.ndarray, more: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts entries by (h, more, rank): the order, starts of groups of h, starts of classes (h, more), and which entries come after their class's first."""
    order = np.lexsort((rank, more, h))
    hs, ms, rs = h[order], more[order], rank[order]
    g = np.r_[True, hs[1:] != hs[:-1]]
    c = g.copy()
    c[1:] |= ms[1:] != ms[:-1]
    later = rs > rs[np.flatnonzero(c)][np.cumsum(c) - 1]
    return order, g, c, later


def anchor_entries(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs: list[np.ndarray] = []
        n_docs = size = 0
        for b in batches:
            for i, j, s in segments(b):
                if len(s.anchor):
                    docs.append(_keys(b, i, j))
                    held.append((s.gram, s.surroundings(), (s.doc + n_docs).astype(np.int32), s.place.astype(np.int32)))
                    n_docs += j - i
                    size += len(s.anchor)
                if size >= HELD:
                    yield from flush(docs, held)
                    held, docs, n_docs, size = [], [], 0, 0
        if held:
            yield from flush(docs, held)

    def flush(docs: list[np.ndarray], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(docs)
        g, c, doc, place = (np.concatenate([x[k] for x in held]) for k in range(4))
        held.clear()
        rank = (_ranks(keys)[doc].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
        order, new_g, new_c, later = settle(g, c, rank)
        group, kind = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
        hot = (np.bincount(group, weights=new_c) > HOT)[group]
        again = (np.bincount(kind, weights=later) > 0)[kind]
        # Of a hot gram one entry tells all shards; its classes are settled here.
        send = np.flatnonzero(new_c & ~hot | new_g & hot)
        own = order[send]
        yield from _pack(0, _shard(g[own], shards), keys, doc[own], place[own], g[own], c[own], np.where(hot, 2, again)[send].astype(np.uint8))
        code = np.where(new_c & hot, SPREAD, 0) | np.where(later | new_c & hot & again, CLASS, 0)
        known = np.flatnonzero(code)
        own = order[known]
        yield from _pack(1, _home(keys, doc[own], shards), keys, doc[own], place[own], flags=code[known].astype(np.uint8))

    return run


TOLD = "doc_id bigint, _h bigint, anchors binary, spread binary"
TOLD_ARROW = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("anchors", pa.binary()), ("spread", pa.binary())])


def codes(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """Documents and answers (place and code) for the entries of a shard."""
    hot_grams = np.unique(x["h"][x["flags"] == 2])
    x = {k: x[k][x["flags"] < 2] for k in ("docs", "place", "h", "more", "flags")}
    if not len(x["h"]):
        return x["docs"], x["place"]
    order, new_g, new_c, _ = settle(x["h"], x["more"], _order_keys(x["docs"], x["place"]))
    group, kind = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
    kinds = np.bincount(group, weights=new_c)[group]
    hot = (kinds > MANY) | np.isin(x["h"][order], hot_grams)
    again = (np.bincount(kind) > 1) | (np.bincount(kind, weights=x["flags"][order]) > 0)
    code = np.where(again[kind], CLASS, 0) | np.where(new_c, np.where(hot, SPREAD, np.where(kinds > 1, PART, 0)), 0)
    say = order[code > 0]
    return x["docs"][say], x["place"][say] << 3 | code[code > 0]


def answers(entries: DataFrame) -> DataFrame:
    """(doc_id, _h, anchors, spread): each document's suspect anchors as pairs (place, code) of uint32, and those that are spread again (none: null)."""
    buckets = shuffle_partitions(entries.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        parts = []
        if x := _unpack(group, 0):
            parts.append(codes(x))
        if x := _unpack(group, 1):
            parts.append((x["docs"], x["place"] << 3 | x["flags"]))
        return _send(parts, buckets)

    def shape(v: np.ndarray) -> tuple[bytes, bytes | None]:
        new = np.flatnonzero(np.r_[True, v[1:] >> 3 != v[:-1] >> 3])
        code = np.bitwise_or.reduceat(v & 7, new)
        pairs = np.stack([v[new] >> 3, code], axis=1).astype(np.uint32)
        return pairs.tobytes(), pairs[code & SPREAD > 0].tobytes() or None

    return _gather(entries.groupBy("shard").applyInArrow(run, repeats.SENT), shape, TOLD, TOLD_ARROW)


def _send(parts: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    rows: list[tuple] = []
    parts = [(d, v) for d, v in parts if len(v)]
    if parts:
        docs, value = np.concatenate([d for d, _ in parts]), np.concatenate([v for _, v in parts])
        bucket = (mix(docs[:, 0].view(np.uint64) ^ docs[:, 1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((value, docs[:, 1], docs[:, 0], bucket))
        docs, value, bucket = docs[order], value[order], bucket[order]
        new = np.r_[True, (docs[1:] != docs[:-1]).any(axis=1)]
        cut = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            first = np.flatnonzero(new[a:b])
            rows.append((int(bucket[a]), docs[a:b][first].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), value[a:b].astype(np.int64).tobytes()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, repeats.SENT_ARROW, strict=True)], schema=repeats.SENT_ARROW)


def _gather(sent: DataFrame, shape, ddl: str = repeats.FOUND, schema: pa.Schema = repeats.FOUND_ARROW) -> DataFrame:
    """One row per document: doc_id, _h and what ``shape`` makes of its sorted values."""

    def run(group: pa.Table) -> pa.Table:
        join = lambda c, d: np.frombuffer(b"".join(group[c].to_pylist()), d)
        docs = np.repeat(join("docs", np.int64).reshape(-1, 2), join("numbers", np.uint32), axis=0)
        value = join("places", np.int64)
        order = np.lexsort((value, docs[:, 1], docs[:, 0]))
        docs, value = docs[order], value[order]
        cut = np.append(np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]).any(axis=1)]), len(docs)).tolist()
        ids = [None if k == repeats.NULL_ID else k for k in docs[cut[:-1], 0].tolist()]
        made = zip(*[shape(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True)
        return pa.table([pa.array(c, f.type) for c, f in zip([ids, docs[cut[:-1], 1], *made], schema, strict=True)], schema=schema)

    return sent.groupBy("bucket").applyInArrow(run, ddl)


def _told(s: Segment, lists: list[bytes | None]) -> np.ndarray:
    """The codes of the anchors of a segment, of the answers to its texts."""
    told = [np.frombuffer(r or b"", np.uint32).reshape(-1, 2).astype(np.int64) for r in lists]
    of = np.concatenate([(np.full(len(t), k) << 33) | t[:, 0] for k, t in enumerate(told)])
    if not len(of):
        return np.zeros(len(s.anchor), np.int64)
    code = np.concatenate([t[:, 1] for t in told])
    mine = (s.doc << 33) | s.place
    at = np.minimum(np.searchsorted(of, mine), len(of) - 1)
    return np.where(of[at] == mine, code[at], 0)


def _in_runs(doc: np.ndarray, at: np.ndarray, lists: list[bytes | None]) -> np.ndarray:
    """Whether places ``at`` of texts ``doc`` lie in the runs (start, number) of their texts."""
    runs = [np.frombuffer(r or b"", np.uint32).reshape(-1, 2).astype(np.int64) for r in lists]
    first = np.concatenate([(np.full(len(r), k) << 33) | r[:, 0] for k, r in enumerate(runs)])
    if not len(first):
        return np.zeros(len(at), bool)
    end = first + np.concatenate([r[:, 1] for r in runs])
    mine = (doc << 33) | at
    k = np.searchsorted(first, mine, "right") - 1
    return (k >= 0) & (mine < end[np.maximum(k, 0)])


def _window_hashes(s: Segment, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that start at ``w``."""
    second = np.zeros(len(s.buf) + 1, np.uint64)
    np.cumsum(_LUT[s.buf] * powers(inverse(_B2), len(s.buf)), out=second[1:])
    return mix((s.prefix[w + WIDTH] - s.prefix[w]) * powers(_B1, len(s.buf))[w]), mix((second[w + WIDTH] - second[w]) * powers(_B2, len(s.buf))[w])


def spread_entries(shards: int):
    """For documents with spread anchors: their windows, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = repeats.Entries()
        for b in batches:
            for i, j, s in segments(b):
                if not len(s.anchor):
                    continue
                own = np.flatnonzero(_told(s, b.column(3).slice(i, j - i).to_pylist()) & SPREAD)
                if len(own):
                    w, k = s.windows(own)
                    h, more = _window_hashes(s, w)
                    held.add(_keys(b, i, j), h, more >> np.uint64(32), s.doc[k], w - s.off[:-1][s.doc[k]] + s.shift)
                if held.size >= HELD:
                    yield from held.rows(shards)
                    held = repeats.Entries()
        yield from held.rows(shards)

    return run


class Held:
    """The classes of a task: both hashes, document, place of the anchor, first window, number of windows and the row of bytes."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n_docs = self.size = 0

    def add(self, docs: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> None:
        for h, more, doc, place, first, n, rows in parts:
            self.parts.append((h, more, doc + self.n_docs, place, first, n, rows))
            self.size += len(h)
        self.docs.append(docs)
        self.n_docs += len(docs)

    def rows(self, shards: int) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        docs = np.concatenate(self.docs)
        h, more, doc, place, first, n, text = (np.concatenate([p[k] for p in self.parts]) for k in range(7))
        rank = (_ranks(docs)[doc].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
        order, head, later = equal_rows(h, more, rank, first, text)
        known = order[later]
        if len(known):
            yield from _pack(SETTLED, _home(docs, doc[known], shards), docs, doc[known], first[known], flags=n[known].astype(np.uint8))
        own = order[head & ~later]
        shapes = np.stack([place[own] - first[own], n[own], n[own], n[own]], axis=1).astype(np.uint8)
        yield from _pack(CLASSES, _shard(h[own] ^ mix(more[own]), shards), docs, doc[own], first[own], h[own], more[own], shapes=shapes, texts=text[own])


def equal_rows(h: np.ndarray, more: np.ndarray, rank: np.ndarray, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of class, rank and first window; which of them stand for themselves, and which have the same bytes as an earlier one.

    An entry stands for itself if no earlier one of its class has its bytes, or if that one is of its own anchor (a long text's
    parts may share an anchor) and has other windows. Classes whose bytes differ (equal hashes) fall apart here.
    """
    order = np.lexsort((first, rank, more, h))
    later, head = np.zeros(len(order), bool), np.zeros(len(order), bool)
    hs, ms, rs, fs = h[order], more[order], rank[order], first[order]
    todo = np.arange(len(order))
    while len(todo):
        new = np.r_[True, (hs[todo][1:] != hs[todo][:-1]) | (ms[todo][1:] != ms[todo][:-1])]
        top = todo[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = (text[order[todo]] == text[order[top]]).all(axis=1)
        own = same & (rs[todo] == rs[top])
        head[todo[own]] = np.r_[True, (fs[todo[own]][1:] != fs[todo[own]][:-1]) | (top[own][1:] != top[own][:-1])] if own.any() else False
        later[todo[same & ~own]] = True
        todo = todo[~same]
    return order, head, later


def window_entries(shards: int):
    """For documents with answers (anchors) and repeated windows (starts): the texts to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for b in batches:
            docs: list[np.ndarray] = []
            part: list[tuple] = []
            texts: list[bytes] = []
            n_docs = 0
            for i, j, s in segments(b):
                if not len(s.anchor):
                    continue
                keys = _keys(b, i, j)
                docs.append(keys)
                code = _told(s, b.column(3).slice(i, j - i).to_pylist())
                begin = s.off[:-1][s.doc] - s.shift
                classes = []
                own = np.flatnonzero(code & CLASS)
                if len(own):
                    lo, hi = s.reach(own)
                    classes.append((s.gram[own], s.surroundings()[own], s.doc[own], s.place[own], s.low[own] - begin[own], s.high[own] - s.low[own] + 1, s.rows(lo, hi, s.anchor[own])))
                if b.column(4).null_count < len(b):
                    starts = b.column(4).slice(i, j - i).to_pylist()
                    w, k = s.windows(np.flatnonzero(code & SPREAD))
                    at = w - begin[k]
                    hit = _in_runs(s.doc[k], at, starts)
                    w, k, at = w[hit], k[hit], at[hit]
                    if len(w):
                        h, more = _window_hashes(s, w)
                        classes.append((h, more, s.doc[k], at, at, np.ones(len(w), np.int64), s.rows(w, w + WIDTH, w)))
                held.add(keys, classes)
                if held.size >= HELD_TEXTS:
                    yield from held.rows(shards)
                    held = Held()
                own = np.flatnonzero(code & PART)
                if len(own):
                    left, short = s.anchor[own] - s.low[own], s.anchor[own] - s.high[own]  # t of the first and of the last own window
                    raw = s.buf.tobytes()
                    texts += [raw[a - t : a + WIDTH - u] for a, t, u in zip(s.anchor[own].tolist(), left.tolist(), short.tolist(), strict=True)]
                    part.append((s.doc[own] + n_docs, s.place[own], s.gram[own], np.stack([left, short, left, short], axis=1).astype(np.uint8)))
                n_docs += j - i
            if part:
                keys = np.concatenate(docs)
                join = lambda x, k: np.concatenate([p[k] for p in x])
                doc, g = join(part, 0), join(part, 2)
                yield from _pack(PARTS, _shard(g, shards), keys, doc, join(part, 1), g, None, None, join(part, 3), texts)
        yield from held.rows(shards)

    return run


class Suffixes:
    """Strings (rows of a matrix, with lengths) of some groups, sorted within their groups by hash-compared mergesort."""

    def __init__(self, chars: np.ndarray, size: np.ndarray, group: np.ndarray):
        m, width = chars.shape
        self.chars, self.size = chars, size
        self.hash = np.zeros((m, width + 1), np.uint64)
        for k in range(width):
            self.hash[:, k + 1] = self.hash[:, k] * _B1 + _LUT[chars[:, k]]
        order = np.argsort(group, kind="stable")
        new = np.r_[True, group[order][1:] != group[order][:-1]] if m else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        n = np.diff(np.append(self.start, m))
        self.order = self._mergesort(order, np.repeat(self.start, n), np.repeat(n, n))
        # neighbours' common extensions, verified byte by byte; 0 at a group's first
        a, b = self.order[:-1], self.order[1:]
        ext = self.extension(a, b)
        same = self.chars[a] == self.chars[b]
        same |= np.arange(width)[None, :] >= ext[:, None]
        ext = np.where(same.all(axis=1), ext, same.argmin(axis=1))
        self.common = np.r_[0, ext] if m else np.zeros(0, np.int64)
        self.common[self.start] = 0
        self.new = new

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b]).astype(np.int64)
        while True:
            mid = (lo + hi + 1) >> 1
            if not (lo < hi).any():
                return lo
            equal = self.hash[a, mid] == self.hash[b, mid]
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string a sorts before string b."""
        k = self.extension(a, b)
        last = self.chars.shape[1] - 1
        ca = np.where(k < self.size[a], self.chars[a, np.minimum(k, last)].astype(np.int64), -1)
        cb = np.where(k < self.size[b], self.chars[b, np.minimum(k, last)].astype(np.int64), -1)
        return ca < cb

    def _mergesort(self, order: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bottom-up, all groups at once: an element's place in the merged run is its own plus its rank in the other run."""
        width = 1
        while True:
            act = np.flatnonzero(n > width)
            if not len(act):
                return order
            s, size, i = start[act], n[act], act - start[act]
            run = i // width
            left = run % 2 == 0
            lo = np.minimum((run ^ 1) * width, size)
            base, hi = lo.copy(), np.minimum(lo + width, size)
            own = order[act]
            while (lo < hi).any():
                open_ = np.flatnonzero(lo < hi)
                mid = (lo[open_] + hi[open_]) >> 1
                other = order[s[open_] + mid]
                # of equal strings those of the left run come first
                up = np.where(left[open_], self.before(other, own[open_]), ~self.before(own[open_], other))
                lo[open_], hi[open_] = np.where(up, mid + 1, lo[open_]), np.where(up, hi[open_], mid)
            place = s + np.minimum(run, run ^ 1) * width + (i - run * width) + (lo - base)
            order = order.copy()
            order[place] = own
            width *= 2

    def intervals(self, depth: int) -> np.ndarray:
        """For each string a number that strings of its group share if they agree in ``depth`` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum((self.common < depth) | self.new)
        return out


def compare(x: dict, most: int = 60_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents and starts of repeated windows among the texts of a shard."""
    rank, found = _order_keys(x["docs"], x["place"]), []
    left, short = x["shapes"][:, 0].astype(np.int64), x["shapes"][:, 1].astype(np.int64)
    size = left + WIDTH - short
    begin = np.cumsum(size) - size
    raw = np.frombuffer(x["text"], np.uint8)
    order = np.argsort(x["h"], kind="stable")
    edge = np.flatnonzero(np.r_[True, x["h"][order][1:] != x["h"][order][:-1]])
    cuts = np.append(edge[np.unique(np.searchsorted(edge, np.arange(0, len(order), most)).clip(max=len(edge) - 1))], len(order)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        if b - a < 2:
            continue
        n_right, n_left = WIDTH - short[own], left[own]
        anchor = begin[own] + n_left
        k = np.arange(WIDTH)
        right = np.where(k[None, :] < n_right[:, None], raw[np.minimum(anchor[:, None] + k, len(raw) - 1)], 0).astype(np.uint8)
        k = np.arange(WIDTH - GRAM)
        back = np.where(k[None, :] < n_left[:, None], raw[np.maximum(anchor[:, None] - 1 - k, 0)], 0).astype(np.uint8)
        after, ahead = Suffixes(right, n_right, x["h"][own]), Suffixes(back, n_left, x["h"][own])
        for t in range(WIDTH - GRAM + 1):
            q = np.flatnonzero((short[own] <= t) & (t <= n_left))
            if len(q) > 1:
                key = after.intervals(WIDTH - t)[q].astype(np.uint64) << np.uint64(32) | ahead.intervals(t)[q].astype(np.uint64)
                by, _, _, later = settle(key, np.zeros(len(q), np.uint32), rank[own[q]])
                hit = own[q[by[later]]]
                if len(hit):
                    found.append((x["docs"][hit], x["place"][hit] - t))
    return found


def found(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents and their repeated windows (start and number) of a shard."""
    parts = []
    if x := _unpack(group, PARTS):
        parts += [(docs, place << 8 | 1) for docs, place in compare(x)]
    if x := _unpack(group, CLASSES):
        place = x["place"] + x["shapes"][:, 0]
        order, _, later = equal_rows(x["h"], x["more"], _order_keys(x["docs"], place), x["place"], np.frombuffer(x["text"], np.uint8).reshape(-1, ROW))
        own = order[later]
        parts.append((x["docs"][own], x["place"][own] << 8 | x["shapes"][own, 1]))
    if x := _unpack(group, SETTLED):
        parts.append((x["docs"], x["place"] << 8 | x["flags"]))
    return parts


def earlier_windows(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, _h, starts): the windows of ``docs`` (doc_id, text, _h) that started earlier, as runs of starts."""
    shards = shards or shuffle_partitions(docs.sparkSession)
    buckets = shuffle_partitions(docs.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        return _send(found(group), buckets)

    told = materialize(answers(map_arrow(docs, anchor_entries(shards), ENTRY_DDL)), "anchors")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d._h") == F.col("s._h"))
    # Not materialized: all three joins with the texts then read one exchange of them.
    spread = told.filter("spread is not null").select("doc_id", "_h", "spread")
    some = docs.alias("d").join(spread.alias("s"), same).select("d.doc_id", "d.text", "d._h", "s.spread")
    again = repeats.answer(map_arrow(some, spread_entries(shards), repeats.SCHEMA), repeats.exact)
    t, w = told.alias("t"), again.alias("w")
    asked = t.join(w, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t._h") == F.col("w._h")), "left").select("t.doc_id", "t._h", "anchors", F.col("runs").alias("windows"))
    some = docs.alias("d").join(asked.alias("s"), same).select("d.doc_id", "d.text", "d._h", "s.anchors", "s.windows")
    sent = map_arrow(some, window_entries(shards), ENTRY_DDL).groupBy("shard").applyInArrow(run, repeats.SENT)
    return _gather(sent, lambda v: (np.stack([np.unique(v) >> 8, np.unique(v) & 255], axis=1).astype(np.uint32).tobytes(),)).withColumnRenamed("runs", "starts")


def remove_earlier(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with kept (the remaining bytes), n_bytes, n_removed and n_spans.

    Null and empty texts have no bytes; texts under WIDTH bytes keep all; null doc_ids come before all others; rows that share doc_id
    and text are one document, so none is a repeat of the other; rows that share a doc_id only are ordered by a hash of
    their texts; other columns are dropped first; an empty table gives no rows.
    """
    base = key_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    starts = earlier_windows(base)
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d._h") == F.col("s._h"))
    both = base.alias("d").join(starts.alias("s"), same, "left").select("d.doc_id", "d.text", "s.starts")
    out = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = texts_of(b.column(1))
            rows: list[tuple] = []
            for k, (doc, runs) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                text = buf[off[k] : off[k + 1]]
                if runs:
                    gone = repeats.covered([runs], len(text), WIDTH)
                    spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
                    rows.append((doc, text[~gone].tobytes(), len(text), int(gone.sum()), spans))
                else:
                    rows.append((doc, text.tobytes(), len(text), 0, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return map_arrow(both, apply, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_earlier(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
