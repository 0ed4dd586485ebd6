"""Substring and suffix deduplication against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetext.llm import repeats, substrings, suffixes


def words_brute(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def bytes_brute(rows):
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    seen, out = set(), {}
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            else:
                seen.add(b[i : i + 100])
        spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(b) else 0
        out[rows[k][0]] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b"")
    return out


@pytest.mark.parametrize("width", [35, 20])
def test_words(docs, texts, width):
    out = substrings.remove_repeats(docs, width)
    assert out.columns == [c for c in docs.columns if c != "kept"] + ["kept", "n_words", "n_removed"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()}
    assert got == dict(enumerate(words_brute(list(enumerate(texts)), width)))


def test_words_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(odd).collect())
    assert got == Counter((rows[k][0], *x) for k, x in enumerate(words_brute(rows, 35)))
    assert substrings.remove_repeats(none).count() == 0


def test_small_batches(docs, texts, monkeypatch):
    import kinetext.llm.common as common

    monkeypatch.setattr(substrings, "HELD", 50)
    assert common.runs_of_rows(np.array([0, 5, 9, 100, 101]), 10).__next__() == (0, 2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()}
    assert got == dict(enumerate(words_brute(list(enumerate(texts)), 35)))


def test_bytes(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_earlier(docs).collect()}
    assert got == bytes_brute(list(enumerate(texts)))


@pytest.mark.parametrize("settings_", [{"HOT": 1}, {"MANY": 2}, {"HOT": 1, "MANY": 2, "HELD": 300}, {"HELD": 100, "HELD_TEXTS": 40, "SEGMENT": 1 << 11}, {"HOT": 2, "HELD_TEXTS": 1, "SEGMENT": 1 << 9}])
def test_bytes_other_ways(texts, monkeypatch, settings_):
    for k, v in settings_.items():
        monkeypatch.setattr(suffixes, k, v)
    # functions sent to workers carry the module by name: run the task functions here
    import pyarrow as pa

    def pairs(parts):
        out: dict = {}
        for docs_, value in parts:
            for d, v in zip(docs_, value, strict=True):
                out.setdefault(int(d[0]), []).append(int(v))
        return out

    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([hash(t) for t in texts], pa.int64())], names=["doc_id", "text", "_h"])
    half = [b.slice(0, 25), b.slice(25)]  # two tasks
    entries = pa.Table.from_batches([e for x in half for e in suffixes.anchor_entries(1)(iter([x]))])
    parts = [suffixes.codes(suffixes._unpack(entries, 0))]
    if x := suffixes._unpack(entries, 1):
        parts.append((x["docs"], x["place"] << 3 | x["flags"]))
    told: dict = {}
    for d, values in pairs(parts).items():
        for v in values:
            told.setdefault(d, {}).setdefault(v >> 3, 0)
            told[d][v >> 3] |= v & 7
    spread = {d for d, x in told.items() if any(c & suffixes.SPREAD for c in x.values())}
    assert spread or not {"HOT", "MANY"} & set(settings_)

    def asked(x, starts):
        some = [k for k, d in enumerate(x.column(0).to_pylist()) if d in told]
        at = pa.array(some, pa.int64())
        ids = [x.column(0)[k].as_py() for k in some]
        cols = [x.column(0).take(at), x.column(1).take(at), x.column(2).take(at), pa.array([np.array(sorted(told[d].items()), np.uint32).tobytes() for d in ids], pa.binary()), pa.array([starts.get(d) for d in ids], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "_h", "anchors", "windows"])

    windows: dict = {}
    e = pa.Table.from_batches([y for x in half for y in suffixes.spread_entries(1)(iter([asked(x, {})]))], schema=repeats.ARROW)
    for row in e.to_pylist():
        docs_ = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)[np.frombuffer(row["codes"], np.uint32)]
        h, more, times = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["more"], np.uint32), np.frombuffer(row["times"], np.uint8)
        for k, place in enumerate(np.frombuffer(row["places"], np.uint32).tolist()):
            key = (int(h[k]), int(more[k])) if row["kind"] == 0 else None
            windows.setdefault(key, []).append((int(docs_[k, 0]), place, int(times[k]) if row["kind"] == 0 else 2))
    again: dict = {}
    for key, own in windows.items():
        if key is None or sum(n for _, _, n in own) > 1:
            for d, place, _ in own:
                again.setdefault(d, set()).add(place)
    starts = {d: np.stack(repeats.pack_runs(np.array(sorted(x))), axis=1).astype(np.uint32).tobytes() for d, x in again.items()}

    table = pa.Table.from_batches([y for x in half for y in suffixes.window_entries(1)(iter([asked(x, starts)]))])
    got = {d: np.stack([np.array(v) >> 8, np.array(v) & 255], axis=1).astype(np.uint32).tobytes() for d, v in pairs(suffixes.found(table)).items()}
    want = bytes_brute(list(enumerate(texts)))
    for k, t in enumerate(texts):
        n = len((t or "").encode())
        gone = repeats.covered([got[k]], n, 100) if k in got else np.zeros(n, bool)
        assert int(gone.sum()) == want[k][1]


@pytest.mark.parametrize("n, parts", [(70, 1), (1000, 3), (250_000, 4)])
def test_bytes_one_string_everywhere(spark, n, parts):
    """Texts around one common string of 32 bytes: nothing repeats but 20 copies, of which nothing stays."""
    rng = np.random.default_rng(n)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-", np.uint8)
    raw = letters[rng.integers(0, 64, (n, 168))]
    raw[:, 68:100] = letters[:32]
    texts = [r.tobytes().decode() for r in raw]
    copies = sorted(rng.choice(n // 2, 20, replace=False).tolist())
    rows = list(enumerate(texts + [texts[k] for k in copies]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = {r.doc_id: r.n_removed for r in suffixes.remove_earlier(df).filter("n_removed > 0").collect()}
    if n <= 1000:
        assert got == {k: x[1] for k, x in bytes_brute(rows).items() if x[1]}
    assert got == {n + k: 168 for k in range(20)}


def test_bytes_equal_hashes_are_compared():
    """Entries whose hashes are equal and whose bytes differ are no repeats of each other."""
    text = np.zeros((4, suffixes.ROW), np.uint8)
    text[2:, 5] = 1
    h = np.full(4, 7, np.uint64)
    order, head, later = suffixes.equal_rows(h, h, np.array([3, 1, 0, 2], np.uint64), np.arange(4), text)
    assert order.tolist() == [2, 1, 3, 0] and head.tolist() == [True, True, False, False] and later.tolist() == [False, False, True, True]


def test_bytes_odd(odd, none):
    rows = odd.collect()
    got = {(r.doc_id, r.n_bytes): r for r in suffixes.remove_earlier(odd).collect()}
    n = len(rows[0].text.encode())
    if n >= 100:
        assert got[None, n].n_removed == 0 and got[1, n].n_removed == n and got[2, n].n_removed == n
    assert suffixes.remove_earlier(odd).count() == len(rows) and suffixes.remove_earlier(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text(alphabet="ab", max_size=12)), min_size=1, max_size=40))
def test_suffix_sort(rows):
    group = np.array([g for g, _ in rows], np.uint64)
    size = np.array([len(t) for _, t in rows])
    chars = np.zeros((len(rows), 12), np.uint8)
    for k, (_, t) in enumerate(rows):
        chars[k, : len(t)] = np.frombuffer(t.encode(), np.uint8)
    s = suffixes.Suffixes(chars, size, group)
    got = [rows[k] for k in s.order]
    assert got == sorted(rows)
    for depth in (1, 3):
        ids = s.intervals(depth)
        for i, (g, t) in enumerate(rows):
            for j, (h, u) in enumerate(rows):
                if len(t) >= depth and len(u) >= depth:
                    assert (ids[i] == ids[j]) == (g == h and t[:depth] == u[:depth])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200), st.integers(1, 4), st.sampled_from([2, 16, 1024]))
def test_sketch_never_counts_too_few(keys, tasks, width):
    """Sketches of several tasks, merged by shard: every repeated key is suspect in its bucket, whatever the width."""
    import pyarrow as pa

    k = np.array(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = np.array(keys) % 3
    rows = []
    for t in range(tasks):
        s = repeats.Sketch(2, width)
        s.add(k[t::tasks], bucket[t::tasks])
        rows += s.rows(3)
    sent = pa.Table.from_batches(rows, schema=repeats.Sketch.ARROW)
    assert not set(sent.column_names) & {"hashes", "docs", "places"}
    merged = pa.concat_tables([repeats.Sketch.merge(sent.filter(pa.compute.equal(sent["shard"], x)), width) for x in set(sent["shard"].to_pylist())])
    for x in range(3):
        own = np.flatnonzero(bucket == x)
        got = repeats.Sketch(2, width).suspects(merged.filter(pa.compute.equal(merged["bucket"], x)))(k[own])
        assert all(g or keys.count(keys[i]) < 2 for g, i in zip(got, own.tolist(), strict=True))
    assert (repeats.exact(k, np.zeros(len(k), np.uint32), np.ones(len(k), np.uint8)) == [keys.count(x) >= 2 for x in keys]).all()


def test_sketch_drops_most_single_keys():
    import pyarrow as pa

    k = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    s = repeats.Sketch(1, repeats.Sketch.width_for(20_000))
    s.add(k, np.zeros(len(k), np.int64))
    merged = repeats.Sketch.merge(pa.Table.from_batches(list(s.rows(1))), s.width)
    assert s.suspects(merged)(k).mean() < 0.05


def test_bucket_is_the_one_of_spark(spark):
    from pyspark.sql import functions as F

    rows = [(1, 5), (-3, 1 << 62), (repeats.NULL_ID, -9), (0, 0), ((1 << 63) - 1, 7)]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in rows], "a bigint, b bigint").select(F.pmod(F.xxhash64("a", "b"), F.lit(37)).alias("x"))
    assert [r.x for r in df.collect()] == repeats.bucket_of(np.array(rows, np.int64), 37).tolist()


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([k for k, _ in rows], words_brute(rows, 35), strict=True))
    for r in substrings.op5_substring_dedup(spark, sf).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    want = bytes_brute(rows)
    for r in suffixes.op10_suffix_dedup(spark, sf).collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
