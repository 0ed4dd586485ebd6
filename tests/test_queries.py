"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from kinetext.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, sf, name):
    df = core.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(core.ORACLES[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == names
    order = [have.index(c) for c in names]
    want = sorted(repr([_plain(r[i]) for i in order]) for r in cur.fetchall())
    assert sorted(repr([_plain(r[c]) for c in names]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, sf, name):
    assert core.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_all_documents_compared(spark, sf):
    """Every document against the one before it in its source, with the pairs made by hand."""
    from kinetext.operators.embedding import HashBackend
    from kinetext.plans import api

    rows = sorted(((r.source or "", r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda r: r[:2])
    pairs = [(b[1], a[2] if a and a[0] == b[0] else None, b[2]) for a, b in zip([None, *rows], rows)]
    want = api.compare_trajectories(spark.createDataFrame(pairs, "pair_id bigint, golden_text string, synthetic_text string"), HashBackend())
    plain = lambda df: {r.pair_id: (r.error, _plain(r.fitness_score)) for r in df.collect()}
    got = plain(core.QUERIES["compare_documents"](spark, sf))
    assert set(got) == {r[1] for r in rows} and got == plain(want)


def test_all_items_compared(spark, sf):
    """Word sets of all documents and all items by brute force."""
    sets = lambda name, key: [(r[0], frozenset(r[1])) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, core.tx.word_set(core.F.col("text"))).collect()]
    docs, items = sets("documents", "doc_id"), sets("benchmark", "item_id")
    want = {(i, j): round(len(x & y) / len(x | y), 5) for i, x in docs for j, y in items if x & y}
    got = {(r.doc_id, r.item_id): r.jaccard for r in core.QUERIES["jaccard_benchmark"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
