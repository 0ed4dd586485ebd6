"""Hierarchical multi-length packing of tokenised documents into context windows.

Each document is cut into full windows of the largest tier; what is left of it is routed to the smallest tier that holds it.
Tiers are packed from the longest down: an item opens a window, the window's gap takes the longest items of the
shorter tiers that fit, and at last the front of a longer one, so that every window is full. Only the last
window of a packing group can stay open; it is parted into windows of falling powers of two. Sequences
of one window size form step groups whose attention costs (sum of squared piece lengths) are balanced.

A packing group is what one task has read, ``group_tokens`` at a time: no shuffle, memory bounded by the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm.common import batch, map_arrow, table
from kinetext.llm.tokens import CACHE, PieceEncoder, public_path

TIERS = (2048, 1024, 512, 256)
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, window int, step_group bigint, step_cost bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_group", pa.int64()), ("step_cost", pa.int64())])


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Packs documents of these lengths: (window, [(document, start, length), ...]) for each sequence.

    Every sequence but at most one holds exactly its window's number of tokens; all windows are tiers, or smaller powers
    of two at the tail. Each token of each document is in exactly one piece.
    """
    top = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    bins: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]  # by length: (document, start)
    mask = 0  # bit n: bins[n] has items
    for doc, n in enumerate(lengths):
        full = n - n % top
        windows += [(top, [(doc, a, top)]) for a in range(0, full, top)]
        if n > full:
            bins[n - full].append((doc, full))
            mask |= 1 << (n - full)
    for tier in tiers:
        while mask and (n := (mask & ((1 << (tier + 1)) - 1)).bit_length() - 1) > 0:
            if n <= tier // 2 and tier != tiers[-1]:
                break  # what is left belongs to shorter tiers
            pieces, gap = [], tier
            while gap and mask:
                n = (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1
                if n > 0:
                    doc, start = bins[n].pop()
                    take = n
                else:  # no item fits: the front of the shortest fills the gap
                    n = (mask & -mask).bit_length() - 1
                    doc, start = bins[n].pop()
                    take = gap
                    bins[n - gap].append((doc, start + gap))
                    mask |= 1 << (n - gap)
                if not bins[n]:
                    mask &= ~(1 << n)
                pieces.append((doc, start, take))
                gap -= take
            if not gap:
                windows.append((tier, pieces))
            else:
                windows += _tail(pieces)
    return windows


def _tail(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Parts an open window into full ones of falling powers of two."""
    left = sum(n for _, _, n in pieces)
    todo, out = pieces[::-1], []
    while left:
        size = 1 << (left.bit_length() - 1)
        own, gap = [], size
        while gap:
            doc, start, n = todo.pop()
            take = min(n, gap)
            own.append((doc, start, take))
            if take < n:
                todo.append((doc, start + take, n - take))
            gap -= take
        out.append((size, own))
        left -= size
    return out


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> tuple[list[int], list[int]]:
    """Deals the sequences of each window size, by falling attention cost and in a snake, to step groups of about ``step_tokens``.

    Returns the group of each sequence and the cost of each sequence.
    """
    cost = [sum(n * n for _, _, n in own) for _, own in windows]
    groups, first = [0] * len(windows), 0
    for size in sorted({w for w, _ in windows}, reverse=True):
        own = sorted((k for k, (w, _) in enumerate(windows) if w == size), key=lambda k: (-cost[k], k))
        n = -(-len(own) // max(1, step_tokens // size))
        for rank, k in enumerate(own):
            lap, at = divmod(rank, n)
            groups[k] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return groups, cost


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65536, group_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", pieces: int = CACHE) -> DataFrame:
    """One row per piece: document, start, length, token ids (little-endian uint32), sequence, offset, window and step group.

    Null texts are empty (one end id); a null ``doc_id`` stays null; repeated rows are packed once each; other columns are
    dropped first, so their names can't clash; an empty table gives no rows. Ties between items of one length are
    taken last in, first out. A worker keeps about ``pieces`` encoded pieces of text (200 bytes each); fewer only cost time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(tokenizer, "word", most=pieces)
        end = np.asarray([end_id], "<u4").tobytes()
        counter = [TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36]
        ids, held, total = [], [], 0
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                for doc, e in zip(part.column(0).to_pylist(), enc.encode_many([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids.append(doc)
                    held.append(e + end)
                    total += len(e) // 4 + 1
                    if total >= group_tokens:
                        yield from emit(ids, held, counter)
                        ids, held, total = [], [], 0
        yield from emit(ids, held, counter)

    def emit(ids: list, held: list[bytes], counter: list[int]) -> Iterator[pa.RecordBatch]:
        windows = plan_windows([len(h) // 4 for h in held], tiers)
        groups, cost = step_groups(windows, step_tokens)
        rows: list[tuple] = []
        for k, (size, own) in enumerate(windows):
            offset = 0
            for doc, start, n in own:
                rows.append((ids[doc], start, n, held[doc][4 * start : 4 * (start + n)], len(held[doc]) // 4, counter[0] + k, offset, size, counter[1] + groups[k], cost[k]))
                offset += n
            if len(rows) >= 2000:
                yield batch(_ARROW, **dict(zip(_ARROW.names, map(list, zip(*rows, strict=True)), strict=True)))
                rows = []
        counter[0] += len(windows)
        counter[1] += max(groups, default=-1) + 1
        if rows:
            yield batch(_ARROW, **dict(zip(_ARROW.names, map(list, zip(*rows, strict=True)), strict=True)))

    return map_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA, keep=True)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group", "step_cost")
