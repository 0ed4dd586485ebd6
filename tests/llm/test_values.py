"""Values of the registered queries on the smallest tables: against their SQL in DuckDB, and against brute force where SQL has no words for it."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinetext.llm import multi_index, packing, registry, simhash
from tests.llm.test_groups import closure, plain

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(registry.ORACLES[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == sorted(df.columns)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([value(r[have.index(c)]) for c in sorted(have)]) for r in cur.fetchall())
    assert sorted(repr([value(r[c]) for c in sorted(have)]) for r in df.collect()) == want and want


def test_neighbours_sql_finds_links(spark, tmp_path):
    """The SQL of all pairs and the index on vectors that do link; the smallest tables hold none."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:30] + 0.05 * rng.normal(size=(30, 16)), 2 * x[:5]])
    rows = [(k, e.tolist()) for k, e in enumerate(x)] + [(200, None), (201, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["op6_multi_index"]).fetchall())
    assert sum(r[1] for r in want) > 60
    assert sorted(map(tuple, multi_index.op6_multi_index(spark, str(tmp_path)).collect())) == want


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    fps = [plain(t) for _, t in rows]
    low = closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    want = {k: (f"{f:016x}", rows[c][0]) for (k, _), f, c in zip(rows, fps, low, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, sf).collect()} == want


def test_packing_query(spark, sf):
    """Every id in one piece, checksums, gapless sequences, padding only below a power of two."""
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op1_packing(spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, own in by_doc.items():
        ids = np.array([*tok.encode(texts[k], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0 and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * total
