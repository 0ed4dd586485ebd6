"""Packing and token files against the tokenizers library; exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetext.llm import packing, rans
from kinetext.llm.common import new_path
from kinetext.llm.merges import LONGEST, Merges, merges_of
from kinetext.llm.tokens import PieceEncoder, load, public_path

WORD, BYTE = public_path("word_bpe_49k.json"), public_path("byte_bpe_50k.json")


def whole(path, texts):
    return [e.ids for e in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="\x85\xa0\u2003\u3000\x1caBé'sTΣİ .,!?\n\t\x7f\x00 ́9_œ🙂", max_size=25), max_size=8))
def test_pieces_equal_whole(texts):
    for path, kind, width in ((WORD, "word", "<u4"), (BYTE, "byte", "<u2")):
        got = [np.frombuffer(b, width).tolist() for b in PieceEncoder(path, kind, width).encode_many(texts)]
        assert got == whole(path, texts)


def test_small_cache(texts):
    got = PieceEncoder(BYTE, "byte", "<u2", most=5).encode_many([t or "" for t in texts])
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == whole(BYTE, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_windows(lengths):
    seen = defaultdict(list)
    for size, own in packing.plan_windows(lengths):
        assert sum(n for _, _, n in own) == size and size & (size - 1) == 0 and size <= 2048
        for d, a, n in own:
            seen[d].append((a, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(seen[d]):
            assert a == at and k > 0
            at += k
        assert at == n


def test_step_groups_balance():
    w = packing.plan_windows([100 + 37 * k % 3000 for k in range(400)])
    groups, cost = packing.step_groups(w, 16 * 2048)
    full = defaultdict(list)
    for (size, _), g, c in zip(w, groups, cost, strict=True):
        if size == 2048:
            full[g].append(c)
    sums = [sum(v) for v in full.values() if len(v) == max(map(len, full.values()))]
    assert max(sums) <= 1.15 * min(sums)


def check_pieces(rows, texts_by_row):
    ids = {}
    seqs = defaultdict(list)
    for r in rows:
        ids.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_pack(spark, docs, texts, none, odd):
    rows = packing.pack(docs, WORD, group_tokens=3000).collect()
    check_pieces(rows, texts)
    want = [i + [1] for i in whole(WORD, texts)]
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id]) and r.length == len(r.ids) // 4
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start : r.start + r.length]
        at[r.doc_id] += r.length
    assert [at[k] for k in range(len(texts))] == list(map(len, want))
    assert packing.pack(none, WORD).count() == 0
    assert packing.pack(odd, WORD).agg(F.sum("length")).first()[0] == sum(len(i) + 1 for i in whole(WORD, [r.text for r in odd.collect()]))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=3000), st.integers(1, 64))
def test_blocks(ids, lanes):
    a = np.array(ids, np.uint32)
    if not len(a):
        return
    old = rans.LANES, rans.CHECK_ROWS
    rans.LANES, rans.CHECK_ROWS = lanes, 3
    try:
        t = rans.Table.of_counts(np.bincount(a[: len(a) // 2], minlength=300))
        assert int(t.freq.sum()) == 1 << t.bits and t.freq.min() >= 1
        data = rans.encode_block(a, rans.Table.parse(t.dump()))
        out, size = rans.decode_block(memoryview(data), t)
        assert (out == a).all() and size == len(data)
        rows = -(-len(a) // min(lanes, len(a)))
        for c in range(-(-rows // 3)):  # from every checkpoint
            part, _ = rans.decode_block(memoryview(data), t, c, c + 1)
            lo = c * 3 * min(lanes, len(a))
            assert (part == a[lo : lo + 3 * min(lanes, len(a))]).all()
        with pytest.raises(ValueError):
            rans.decode_block(memoryview(data[:-1] + bytes([data[-1] ^ 1])), t)
    finally:
        rans.LANES, rans.CHECK_ROWS = old


def test_files(spark, docs, texts, none, odd):
    folder = new_path(spark, "files")
    manifest = rans.write_corpus(docs, folder, BYTE).collect()
    back = {r.doc_id: r for r in rans.read_files(spark, folder).collect()}
    at, base = 0, {m.file: m.base for m in manifest}
    for k, ids in enumerate(whole(BYTE, texts)):
        r = back[k]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids + [0] and base[r.file] + r.before == at and r.n_tokens == len(ids) + 1
        at += r.n_tokens
    assert sum(m.n_tokens for m in manifest) == at
    empty = new_path(spark, "files")
    assert rans.write_corpus(none, empty, BYTE).count() == 0
    some = new_path(spark, "files")
    rans.write_corpus(odd, some, BYTE).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in rans.read_files(spark, some).collect())
    want = sorted((r.doc_id is not None, r.doc_id or 0, np.array(i + [0], "<u4").tobytes()) for r, i in zip(odd.collect(), whole(BYTE, [r.text for r in odd.collect()]), strict=True))
    assert got == want


def test_queries(spark, sf):
    p = packing.op1_packing(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(p.columns)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(texts, whole(BYTE, texts.values()), strict=True))
    at = 0
    for r in rans.op3_rans(spark, sf).orderBy("doc_id").collect():
        own = np.array(ids[r.doc_id] + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_second_attempt(spark, docs, texts, tmp_path):
    """Files that an earlier attempt has left, whole or cut short, don't stop a task that runs again."""
    folder = str(tmp_path / "corpus")
    rows = lambda: sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.read_files(spark, folder, with_ids=False).collect())
    rans.write_corpus(docs, folder, public_path("byte_bpe_50k.json"))
    want = rows()
    file = next((tmp_path / "corpus").glob("*.ktx"))
    for data in (file.read_bytes(), file.read_bytes()[:-7]):
        file.write_bytes(data)
        rans.write_corpus(docs, folder, public_path("byte_bpe_50k.json"))
        assert rows() == want and len(want) == len(texts)


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_many_runs_equal_whole(name, kind):
    """Thousands of different words, merged many at a time, with accents, punctuation and line feeds, against the whole text at once."""
    rng = np.random.default_rng(3)
    letters = np.array(list("etaoinshrdlucmfwypvbgkjqxz" * 4 + "éèñüßçÄÖ日本жд"))
    words = ["".join(rng.choice(letters, rng.integers(1, 15))) for _ in range(9000)]
    text = " ".join(w + ("", ".", ",", "\nx", "?!")[i % 5] for i, w in enumerate(words))
    enc = PieceEncoder(public_path(name), kind)
    enc._empty()
    assert np.frombuffer(enc.encode_many([text])[0], "<u4").tolist() == load(public_path(name)).encode(text, add_special_tokens=False).ids
    import gc

    assert gc.isenabled()


def test_few_pieces_for_many_words():
    """A word with marks, digits or a line feed around it takes no encoding of its own; before, each such form was a piece."""
    words = ["lo" * k + c + "é" for k in range(1, 9) for c in "bcdfghjklmnp"]
    text = " ".join(w + m for m in (".", ",", "?!", ";", ":", ")", ".\nand", "7", "") for w in words)
    enc = PieceEncoder(BYTE, "byte", "<u2")
    enc._empty()
    assert np.frombuffer(enc.encode_many([text])[0], "<u2").tolist() == whole(BYTE, [text])[0]
    assert len(enc.kept["sizes"]) < len(words) + 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abSstdmé×÷ªßﬁǅʰ́ \x85\xa0\x1f\x7f\x00٣²½日🙂  \n\n\t\r''''.,-<|>7", max_size=40), max_size=6))
def test_cuts(texts):
    """Cuts of bytes at every mixture of letters, apostrophes, signs and white space, over a column with nulls and an offset."""
    column = pa.array(["cut off", *texts, None, *texts]).slice(1)
    got = [np.frombuffer(b, "<u4").tolist() for b in PieceEncoder(BYTE, "byte").encode_column(column)]
    want = whole(BYTE, texts)
    assert got == [*want, [], *want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aaehintsTé日", min_size=1, max_size=LONGEST // 3), min_size=1, max_size=40))
def test_merges_side_by_side(words):
    """Runs of letters, repeated ones too, merged in numpy against the library."""
    raw = [w.encode() for w in words]
    sizes = np.array(list(map(len, raw)))
    order, n, ids = merges_of(BYTE).ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    got = dict(zip(order.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True))
    assert [got[k].tolist() for k in range(len(words))] == whole(BYTE, words)


def test_merges_by_hand():
    """Pairs by rank, the leftmost first; a vocabulary whose tokens end or go on differently isn't merged so."""
    m = Merges(np.array([[98, 99], [97, 97], [256, 257], [97, 256]]), np.array([256, 257, 258, 259]), np.arange(256))
    raw = b"aaabcbcaabca"
    order, n, ids = m.ids(np.frombuffer(raw + b"a" * 32, np.uint8), np.array([0, 12]), np.array([12, 32]))
    assert (order.tolist(), n.tolist()) == ([0, 1], [5, 16])
    assert ids.tolist() == [257, 259, 258, 256, 97] + [257] * 16
    assert merges_of(WORD) is None


def test_small_manifest(spark, docs, texts):
    """The manifest of many files is few files itself."""
    folder = new_path(spark, "files")
    tokens = rans.tokenize(docs, BYTE)
    vocabulary = load(BYTE).get_vocab_size()
    manifest = rans.write_files(tokens, folder, rans.Table.of_counts(np.ones(vocabulary, np.int64)), vocabulary, 7)
    assert sum(r.n_docs for r in manifest.collect()) == len(texts) and manifest.count() > 3
    assert len(manifest.inputFiles()) == 1
