"""What the operators share: shared folders, Arrow map helpers, vectorised hashing of words and bytes."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that map functions get at a time (texts are long rows), and the setting that bounds the batches that Spark makes.
ROWS, BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_PACKAGE = Path(__file__).resolve().parent.parent
_lock = threading.Lock()
_shipped: set[str] = set()
_roots: dict[str, str] = {}
_small: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the session -----------------------------------------------------------------------------------------------------


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python workers can import it.

    Where the application leaves BATCH unset it becomes ROWS, until ``cleanup``: Arrow batches of long texts take much memory
    beside the heap, and the setting is read when a plan runs, long after an operator has returned. A value that is set stays.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, str(ROWS))
        _small.add(spark.sparkContext.applicationId)
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        if zipfile.is_zipfile(_PACKAGE.parent):  # already running from a shipped archive
            _shipped.add(app)
            return
        home = tempfile.mkdtemp(prefix="kinetext-")  # the driver serves the archive from here until it ends
        atexit.register(shutil.rmtree, home, ignore_errors=True)
        out = os.path.join(home, "kinetext_pkg.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        spark.sparkContext.addPyFile(out)
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, removed when the driver ends.

    Without that setting only a local master may go on (with a folder of its own); a cluster has to name one.
    """
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _roots:
            base = spark.conf.get("spark.checkpoint.dir", None)
            if not base:
                master = spark.sparkContext.master
                if not (master == "local" or master.startswith("local[")):
                    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
                base = tempfile.mkdtemp(prefix="kinetext-shared-")
            _roots[app] = f"{base.rstrip('/')}/kinetext-{uuid.uuid4().hex}"
            atexit.register(_remove, spark, _roots[app])
        return _roots[app]


def cleanup(spark: SparkSession) -> None:
    """Removes this application's intermediate tables, and BATCH if ``ship`` has set it; results that still read them must have been written before."""
    if spark.sparkContext.applicationId in _small:
        _small.discard(spark.sparkContext.applicationId)
        spark.conf.unset(BATCH)
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root is not None:
        _remove(spark, root)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, as other libraries need it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that ``materialize`` wrote; nothing may read it any more."""
    _remove(df.sparkSession, df._written)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ROWS, keep: bool = False) -> DataFrame:
    """``mapInArrow`` with batches of at most ``rows`` rows (0: as they come).

    Workers live on from stage to stage: each task first gives back what earlier ones have left, unless it is to ``keep`` their caches.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            relieve()
        yield from fn(_short(batches, rows) if rows else batches)
        if not keep:
            relieve()

    return df.mapInArrow(run, schema)


#: Caches of a worker, by purpose.
caches: dict[tuple, dict] = {}


def relieve() -> None:
    """Empties the worker's caches and gives freed memory back to the system."""
    caches.clear()
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def _short(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


# --- texts as bytes --------------------------------------------------------------------------------------------------


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and the offsets of its rows (nulls: empty)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def runs_of_rows(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Splits rows into consecutive runs of about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses one of ``doc_starts``."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_WS[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = ~word[1:] | ~word[:-1]
    cut[doc_starts] = True
    return np.flatnonzero(word & cut[:-1]), np.flatnonzero(word & cut[1:]) + 1


_rng = np.random.default_rng(20240607)
_LUT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept and extended as longer ones are asked for."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1024, 1 << max(0, n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[int(base)] = have = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 17
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        lens = e - s
        first = np.cumsum(lens) - lens
        total = int(lens.sum())
        at = np.arange(total) - np.repeat(first, lens)
        v = _LUT[buf[at + np.repeat(s, lens)]] * powers(_B1, int(lens.max()))[at]
        out[a : a + step] = mix(np.add.reduceat(v, first) + lens.astype(np.uint64) * _M2)
    return out


def gram_hashes(values: np.ndarray, k: int, base: np.uint64 = _B1) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive values (uint64), by prefix sums of a polynomial."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(inverse(base), len(values)), out=prefix[1:], dtype=np.uint64)
    return mix((prefix[k:] - prefix[:-k]) * powers(base, n))


SECOND_BASE = _B2


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` consecutive hashes the position of its smallest (leftmost of equal ones)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # sparse-table doubling: the minimum over w by two overlapping runs of a power of two
    best, arg, size = h, np.arange(len(h)), 1
    while size * 2 <= w:
        left, right = best[:-size], best[size:]
        take = right < left
        best, arg, size = np.where(take, right, left), np.where(take, arg[size:], arg[:-size]), size * 2
    rest = w - size
    if rest:
        left, right = best[:n], best[rest : rest + n]
        arg = np.where(right < left, arg[rest : rest + n], arg[:n])
    return arg[:n]


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` makes of columns of longs without nulls, as int64."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = (h + p5 + np.uint64(8)) ^ (_rotl(c.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = _rotl(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def pack_runs(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions as maximal runs: starts and lengths."""
    if not len(positions):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.diff(positions) != 1) + 1
    first = np.r_[0, breaks]
    return positions[first], np.diff(np.r_[first, len(positions)])


def aside(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with all columns but ``keep`` under names of no meaning, so that they clash with none; and what gives them their names and order back.

    The second takes columns to add (names that ``df`` has already are replaced by them).
    """
    names = {c: c if c in keep else f"_x{k}" for k, c in enumerate(df.columns)}
    plain = df.toDF(*names.values())

    def back(out: DataFrame, *add: str) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in add], *add)

    return plain, back


def key_of(df: DataFrame) -> DataFrame:
    """Adds ``_h``, a fingerprint of the text: rows that share doc_id and text count as repeats of one document."""
    return df.withColumn("_h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
