"""Token ids in binary files, coded by a static range asymmetric numeral system.

One frequency table is counted over the whole corpus and shared by all files. A file holds consecutive documents in ascending
order as independent blocks; in a block the tokens are dealt to lanes that are coded side by side (numpy steps all
lanes at once). A checkpoint every ``CHECK_ROWS`` rows keeps all lane states and the place in the words, so
a block can be decoded from any checkpoint, in parallel; checksums cover payload and tokens.

File: header (magic, version, table's checksum, documents, tokens, blocks), zlib index of documents (ids, validity, lengths),
then the blocks. Integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetext.llm.common import batch, map_arrow, materialize, new_path, qualified, table
from kinetext.llm.tokens import PieceEncoder, load, public_path

MAGIC, VERSION = b"KTXRANS1", 1
LOW = np.uint64(1 << 31)
LANES, BLOCK, CHECK_ROWS, FILE_TOKENS = 4096, 1 << 20, 128, 1 << 22
_HEAD, _BLOCK = struct.Struct("<8sIIQQII"), struct.Struct("<IIIIII")


@dataclass
class Table:
    """Frequencies that sum to 2 ** bits, at least 1 for each id of the vocabulary, so that any text can be coded."""

    freq: np.ndarray
    bits: int

    def __post_init__(self):
        # small types: the tables are read at random places and should stay in the processor's own cache
        self.cum = (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint32)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 65536 else np.uint32), self.freq)
        return self._slots

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        """Scales counts; the rounding's rest goes to the most frequent id (the smallest of equal ones)."""
        n = len(counts)
        bits = min(28, max(16, int(np.ceil(np.log2(max(n, 2)))) + 3))
        total = max(1, int(counts.sum()))
        freq = 1 + (counts.astype(object) * ((1 << bits) - n) // total).astype(np.int64)
        freq[int(np.argmax(counts))] += (1 << bits) - int(freq.sum())
        return Table(freq.astype(np.uint32), bits)

    def dump(self) -> bytes:
        body = zlib.compress(self.freq.astype("<u4").tobytes())
        return struct.pack("<8sIII", MAGIC, self.bits, len(self.freq), self.crc) + body

    @staticmethod
    def parse(data: bytes) -> Table:
        magic, bits, n, crc = struct.unpack_from("<8sIII", data)
        t = Table(np.frombuffer(zlib.decompress(data[20:]), "<u4", n).astype(np.uint32), bits)
        if magic != MAGIC or t.crc != crc:
            raise ValueError("the frequency table is damaged")
        return t


def encode_block(ids: np.ndarray, t: Table) -> bytes:
    n = len(ids)
    lanes = min(LANES, n)
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    full, room, s32, low32 = np.uint64(1 << t.bits), np.uint64(63 - t.bits), np.uint64(32), np.uint64(0xFFFFFFFF)
    words, checks, emitted = [], [], 0
    for r in range(rows - 1, -1, -1):
        sym = ids[r * lanes : (r + 1) * lanes]
        y = x[: len(sym)]
        f = t.freq[sym].astype(np.uint64)
        over = y >= f << room
        if over.any():
            w = y[over]
            words.append((w & low32).astype("<u4"))
            emitted += len(w)
            y = np.where(over, y >> s32, y)
        x[: len(sym)] = y + (y // f) * (full - f) + t.cum[sym]
        if r % CHECK_ROWS == 0:
            checks.append((emitted, x.copy()))
    checks.reverse()
    stream = b"".join(w.tobytes() for w in reversed(words))
    # a checkpoint: words that lie before it, and the states
    points = b"".join(struct.pack("<I", emitted - at) + st.astype("<u8").tobytes() for at, st in checks)
    body = points + stream
    return _BLOCK.pack(n, lanes, emitted, len(checks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(data: memoryview, t: Table, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
    """The ids of one block from ``data``'s start and the block's size; ``first`` and ``last``: checkpoints to decode between."""
    n, lanes, emitted, n_checks, crc, body_crc = _BLOCK.unpack_from(data)
    step = 4 + 8 * lanes
    size = _BLOCK.size + n_checks * step + 4 * emitted
    body = data[_BLOCK.size : size]
    if zlib.crc32(body) != body_crc:
        raise ValueError("a block's payload is damaged")
    words = np.frombuffer(body, "<u4", emitted, n_checks * step).astype(np.uint64)
    pos = struct.unpack_from("<I", body, first * step)[0]
    x = np.frombuffer(body, "<u8", lanes, first * step + 4).astype(np.uint64)
    lo = first * CHECK_ROWS * lanes
    hi = n if last is None else min(n, last * CHECK_ROWS * lanes)
    out = np.empty(hi - lo, np.uint32)
    bits, mask, s32 = np.uint64(t.bits), np.uint64((1 << t.bits) - 1), np.uint64(32)
    slots, freq, cum = t.slots, t.freq, t.cum
    for a in range(lo, hi, lanes):
        m = min(lanes, hi - a)
        y = x[:m]
        slot = y & mask
        sym = slots[slot]
        out[a - lo : a - lo + m] = sym
        y = freq[sym] * (y >> bits) + (slot - cum[sym])
        under = y < LOW
        k = int(np.count_nonzero(under))
        if k:
            y[under] = (y[under] << s32) | words[pos : pos + k]
            pos += k
        x[:m] = y
    if lo == 0 and hi == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's tokens are damaged")
    return out, size


def encode_file(doc_ids: list[int | None], docs: list[np.ndarray], t: Table) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    index = zlib.compress(np.asarray([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray([d is not None for d in doc_ids], np.uint8).tobytes() + np.asarray([len(d) for d in docs], "<u8").tobytes())
    blocks = [encode_block(ids[a : a + BLOCK], t) for a in range(0, len(ids), BLOCK)]
    return _HEAD.pack(MAGIC, VERSION, t.crc, len(docs), len(ids), len(blocks), len(index)) + index + b"".join(blocks)


def decode_file(data: bytes, t: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all token ids."""
    magic, version, crc, n_docs, n_tokens, n_blocks, n_index = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or crc != t.crc:
        raise ValueError("not a file of this format and table")
    raw = zlib.decompress(data[_HEAD.size : _HEAD.size + n_index])
    keys, valid, lens = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs), np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    view, at, parts = memoryview(data), _HEAD.size + n_index, []
    for _ in range(n_blocks):
        part, size = decode_block(view[at:], t)
        parts.append(part)
        at += size
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_tokens:
        raise ValueError("a file has lost blocks")
    return [int(k) if v else None for k, v in zip(keys, valid, strict=True)], lens, ids


# --- on Spark --------------------------------------------------------------------------------------------------------


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, two bytes for small vocabularies, with the end id) of every whole text; null: the end id only.

    Each task adds one row with n_tokens -1, whose ids are its counts of all ids (int64).
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    vocabulary = load(tokenizer).get_vocab_size()
    wide = "<u2" if vocabulary <= 65536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        enc = PieceEncoder(tokenizer, "byte", wide)
        end = np.asarray([end_id], wide).tobytes()
        for b in batches:
            got = [e + end for e in enc.encode_column(b.column(1))]
            total += np.bincount(np.frombuffer(b"".join(got), wide), minlength=vocabulary)
            yield batch(out, doc_id=b.column(0), n_tokens=[len(g) // len(end) for g in got], ids=got)
        yield batch(out, doc_id=[None], n_tokens=[-1], ids=[total.tobytes()])

    return map_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, n_tokens bigint, ids binary", keep=True)


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the whole corpus; what reaches the driver is bounded by the vocabulary."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_buffer(), np.int64)
        ids = np.flatnonzero(total)
        yield batch(out, id=ids, n=total[ids])

    counts = np.zeros(vocabulary, np.int64)
    for r in map_arrow(tokens.filter("n_tokens < 0").select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write_files(tokens: DataFrame, folder: str, t: Table, vocabulary: int, partitions: int) -> DataFrame:
    """Writes ``folder``/<partition>-<number>.ktx in ascending doc_id order; returns the manifest (file, order, documents, tokens).

    A file appears under its name by one rename after all its bytes are there; a task that runs again writes the same bytes.
    """
    out = pa.schema([("file", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
    folder = qualified(tokens.sparkSession, folder)
    wide, freq, bits = "<u2" if vocabulary <= 65536 else "<u4", t.freq, t.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        coder, ctx = Table(freq, bits), TaskContext.get()
        part, number = ctx.partitionId(), 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{part:08d}-{number:06d}.ktx"
            data = encode_file(keys, held, coder)
            where.create_dir(f"{root}/tmp", recursive=True)
            temp = f"{root}/tmp/{name}.{ctx.taskAttemptId()}"
            with where.open_output_stream(temp) as f:
                f.write(data)
            # an earlier attempt of this task may have left the file: the same bytes, unless it was cut short
            there = where.get_file_info(f"{root}/{name}")
            if there.type == fs.FileType.File and there.size == len(data):
                where.delete_file(temp)
            else:
                if there.type == fs.FileType.File:
                    where.delete_file(f"{root}/{name}")
                where.move(temp, f"{root}/{name}")
            return batch(out, file=[name], part=[part], number=[number], n_docs=[len(keys)], n_tokens=[size], n_bytes=[len(data)])

        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(v.as_buffer(), wide).astype(np.uint32)
                keys.append(key)
                held.append(ids)
                size += len(ids)
                if size >= FILE_TOKENS:
                    yield flush()
                    keys, held, size, number = [], [], 0, number + 1
        if keys:
            yield flush()

    ranged = tokens.filter("n_tokens >= 0").select("doc_id", "ids").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    written = map_arrow(ranged, run, "file string, part bigint, number bigint, n_docs bigint, n_tokens bigint, n_bytes bigint")
    return materialize(written.repartition(partitions // 256 + 1), "manifest")  # a row per file: else as many tables' files as files


def read_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Decodes all files of a folder: file, doc_id, tokens before it in the file, n_tokens, ids (little-endian uint32; null if not asked for) and ids_crc32 of these bytes."""
    t = Table.parse(bytes(spark.read.format("binaryFile").load(f"{folder}/table.ktt").select("content").first()[0]))
    freq, bits = t.freq, t.bits
    out = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Table(freq, bits)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, lens, ids = decode_file(content.as_buffer().to_pybytes(), coder)
                ends, data = np.cumsum(lens), memoryview(ids.astype("<u4").tobytes())
                for a in range(0, len(keys), 1000):
                    own = [data[4 * i : 4 * j] for i, j in zip((ends - lens)[a : a + 1000].tolist(), ends[a : a + 1000].tolist(), strict=True)]
                    yield batch(
                        out, file=[path.rpartition("/")[2]] * len(own), doc_id=keys[a : a + 1000], before=(ends - lens)[a : a + 1000], n_tokens=lens[a : a + 1000],
                        ids=[x.tobytes() if with_ids else None for x in own], ids_crc32=[zlib.crc32(x) for x in own],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ktx").load(folder).select("path", "content")
    return map_arrow(files, run, "file string, doc_id bigint, before bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def write_table(spark: SparkSession, folder: str, t: Table) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/table.ktt")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(t.dump()))
    stream.close()


def write_corpus(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Tokenises, counts, writes table and files; returns the manifest with each file's first token number (``base``).

    Null texts hold the end id only; rows with a null or equal doc_id stay, nulls first, equal ones ordered by their ids;
    other columns are dropped first; an empty table gives a table file and an empty manifest.
    """
    spark = docs.sparkSession
    vocabulary = load(tokenizer).get_vocab_size()
    tokens = materialize(tokenize(docs, tokenizer, end_id), "tokens", **{"parquet.enable.dictionary": "false"})
    counts = count_ids(tokens, vocabulary)
    t = Table.of_counts(counts)
    write_table(spark, folder, t)
    manifest = write_files(tokens, folder, t, vocabulary, max(1, int(counts.sum()) // FILE_TOKENS + 1))
    w = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def op3_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "rans")
    manifest = write_corpus(table(spark, sf_dir, "documents"), folder, public_path("byte_bpe_50k.json"))
    back = read_files(spark, folder, with_ids=False).drop("ids")
    return back.join(manifest.select("file", "base"), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
