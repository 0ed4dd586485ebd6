"""The public tools, sources, sinks, cache, registry and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from kinetext.operators import classify, drift
from kinetext.functions import sql
from kinetext.operators.embedding import EmbeddingCache, HashBackend, ModelBackend, TableBackend, get_backend
from kinetext.plans import api
from kinetext.sources import pairs as src
from kinetext.streaming import trajectories


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_analyze(spark):
    d = docs(spark, "One two. Three four! Five? Six seven.", "Alone.", "", None, "...")
    r = {x.doc_id: x for x in api.analyze_trajectory(d, HashBackend(), include_sentences=True).collect()}
    assert r[0].n_sentences == 4 and r[0].error is None and r[0].sentences == ["One two.", "Three four!", "Five?", "Six seven."] and len(r[0].velocity_profile) == 3
    assert r[1].error == "Need at least 2 sentences, got 1" and r[1].mean_velocity is None
    assert r[2].error == r[3].error == "No text provided" and r[4].error == "Need at least 2 sentences, got 0"


def test_embed(spark):
    r = {x.doc_id: x for x in api.embed_text(docs(spark, "a b", "", "x" * 120), HashBackend(8), model="named").collect()}
    assert r[0].dimensions == 8 and len(r[0].embedding_preview) == 8 and r[0].model == "named" and r[0].note
    assert r[1].error == "No text provided" and r[2].text_preview == "x" * 100 + "..."
    full = api.embed_text(docs(spark, "a"), HashBackend(16), full_vector=True).first()
    assert len(full.embedding) == 16 and abs(sum(v * v for v in full.embedding) - 1) < 1e-12


def test_drift_and_bulk(spark, tmp_path):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("z", [0.0, 0.0])], "text string, e array<double>").select(F.substring(F.sha2("text", 256), 1, 16).alias("text_key"), "e")
    p = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "")], "text_a string, text_b string")
    r = api.calculate_drift(p, TableBackend(vec)).orderBy("text_b").collect()
    assert r[0].error == "Both text_a and text_b are required"
    assert (r[1].drift, r[1].interpretation) == (0.2, "Similar (related semantics)") and r[2].drift == 1.0
    path = tmp_path / "pairs.jsonl"
    path.write_text('{"text_a":"x","text_b":"y"}\n\nnot json\n{"text_a":"x"}\n[1]')
    lines = src.read_pairs(spark, str(path))
    out = drift.bulk(lines, HashBackend())
    got = {x.line: x for x in out.collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1].drift is not None
    assert all(got[k].interpretation == "Invalid JSON or missing fields" and got[k].text_a_preview == "(invalid)" and got[k].drift is None for k in (3, 4, 5))
    assert drift.status(out).first().status == "Processed 4 pairs (1 valid)"
    assert drift.status(out.limit(0)).first().status == "No valid pairs found in file"
    src.write_csv(out, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == "line,text_a_preview,text_b_preview,drift,interpretation" and len(text) == 5
    assert json.loads(src.to_json(out).first().json)["line"] in got


def test_classify(spark):
    cats = spark.createDataFrame([("first", 1, "alpha beta"), ("second", 2, "alpha beta"), ("empty", 3, ""), ("other", 4, "gamma")], "category string, ordinal int, exemplar string")
    r = {x.doc_id: x for x in api.classify_document(docs(spark, "alpha beta", "gamma delta", "", "gamma " * 600), cats, HashBackend()).collect()}
    assert r[0].best_match == "first" and r[0].confident and [s.category for s in r[0].all_similarities][:2] == ["first", "second"]
    assert r[1].best_match == "other" and not r[1].confident and r[2].error == "No content provided" and r[3].content_truncated
    none = classify.nearest(docs(spark, "a").withColumn("e", F.array(F.lit(1.0))), cats.limit(0).withColumn("e", F.array(F.lit(1.0)))).first()
    assert none.error == "No valid category exemplars provided"


def test_many_categories(spark, monkeypatch):
    """More categories than a broadcast may hold give the same answers, in several passes."""
    cats = spark.createDataFrame([(f"c{k}", k, [float(k % 4), 1.0, float(k)]) for k in range(23)], "category string, ordinal int, e array<double>")
    d = spark.createDataFrame([(k, [float(k), 2.0, 1.0]) for k in range(9)], "doc_id bigint, e array<double>")
    want = sorted(map(str, classify.nearest(d, cats).collect()))
    monkeypatch.setattr(classify, "MOST_CATEGORIES", 5)
    assert sorted(map(str, classify.nearest(d, cats).collect())) == want


def test_compare(spark):
    p = spark.createDataFrame([(1, "A b. C d. E f. G.", "A b. C d. E f. G."), (2, "", "x"), (3, "x. y.", None), (4, "One.", "A. B.")], "pair_id int, golden_text string, synthetic_text string")
    r = {x.pair_id: x for x in api.compare_trajectories(p, HashBackend()).collect()}
    assert r[1].acceleration_dtw == 0.0 and r[1].error is None and r[1].fitness_score > 0 and r[1].reference_summary == r[1].comparison_summary
    assert r[2].error == "No golden_text provided" and r[3].error == "No synthetic_text provided" and r[4].error == "Need at least 2 sentences, got 1"


def test_models_and_cache(spark, tmp_path):
    m = api.Models(spark, cache_path=str(tmp_path / "cache"))
    assert m.model_status() == {"backend": "hash", "cache_size": 0, "model_name": "not initialized", "is_loaded": False, "dimensions": "unknown"}
    assert m.model_unload()["status"] == "no model was loaded"
    assert m.model_load("hash", dimensions=8) == {"status": "loaded", "backend": "hash", "model_name": "hash-md5", "is_loaded": True}
    out = m.cache.embed(docs(spark, "a", "a", "b", None), m.backend())
    assert out.filter("e is not null").count() == 3 and m.cache.size() == 2
    m.cache.embed(docs(spark, "a", "c"), m.backend()).count()
    assert m.cache.size() == 3 and m.status_line() == "hash | hash-md5 | loaded | 8d | cache: 3"
    assert m.model_unload() == {"status": "unloaded", "cache_entries_cleared": 3} and m.cache.size() == 0
    with pytest.raises(ValueError):
        get_backend("nothing")
    assert api.call(m, "nothing") == {"error": "Unknown tool: nothing"}
    assert EmbeddingCache(spark).embed(docs(spark, "a"), HashBackend(4)).first().e is not None


def test_tool_schemas():
    tools = {t["name"]: t["inputSchema"] for t in api.list_tools()}
    assert sorted(tools) == sorted(["embed_text", "calculate_drift", "classify_document", "analyze_trajectory", "compare_trajectories", "model_status", "model_load", "model_unload"])
    assert tools["analyze_trajectory"]["required"] == ["text"] and tools["compare_trajectories"]["required"] == ["golden_text", "synthetic_text"]
    p = tools["analyze_trajectory"]["properties"]
    assert p["acceleration_threshold"]["type"] == "number" and p["acceleration_threshold"]["default"] == 0.3 and p["include_sentences"]["default"] is False
    assert tools["classify_document"]["properties"]["threshold"]["default"] == 0.85 and tools["classify_document"]["properties"]["categories"]["additionalProperties"] == {"type": "string"}
    assert "required" not in tools["model_load"] and tools["model_unload"]["properties"]["clear_cache"]["default"] is True
    assert all(x["description"] and x["type"] for t in tools.values() for x in t["properties"].values())


def test_calls(spark):
    m = api.Models(spark)
    assert api.call(m, "model_status")["model_name"] == "not initialized"
    assert api.call(m, "model_load", {"backend": "hash"})["status"] == "loaded"
    r = api.call(m, "analyze_trajectory", {"text": "One two. Three four! Five? Six seven.", "include_sentences": True})
    assert r["n_sentences"] == 4 and len(r["velocity_profile"]) == 3 and "error" not in r
    assert api.call(m, "calculate_drift", {"text_a": "a b", "text_b": "a b"})["drift"] == 0.0
    assert api.call(m, "embed_text", {"text": "a"})["dimensions"] == 64
    assert api.call(m, "classify_document", {"content": "alpha", "categories": {"x": "alpha", "y": "beta"}})["best_match"] == "x"
    assert api.call(m, "compare_trajectories", {"golden_text": "A b. C d.", "synthetic_text": "A b. C d."})["fitness_score"] > 0
    for tool, arguments, error in (
        ("analyze_trajectory", {}, "No text provided"), ("analyze_trajectory", {"text": "One."}, "Need at least 2 sentences, got 1"), ("analyze_trajectory", {"text": 5}, "text has to be of type string"),
        ("analyze_trajectory", {"words": "x"}, "analyze_trajectory has no parameter words"), ("classify_document", {"content": "x"}, "No categories provided"), ("calculate_drift", {"text_a": "x"}, "Both text_a and text_b are required"),
        ("model_load", {"backend": "nothing"}, None), ("unknown", {}, "Unknown tool: unknown"),
    ):
        got = api.call(m, tool, arguments)
        assert list(got) == ["error"] and (error is None or got["error"] == error)


def test_environment(spark):
    m = api.Models.from_conf(spark, environ={"EMBEDDING_BACKEND": "lmstudio", "EMBEDDING_SERVER_URL": "http://somewhere:9/v1", "EMBEDDING_MODEL": "named"})
    assert (m.backend().base_url, m.backend().model_name) == ("http://somewhere:9/v1", "named")
    assert api.Models.from_conf(spark, environ={"EMBEDDING_SERVER_URL": "http://x"}).backend().model_name == "hash-md5"
    b = get_backend("nv_embed")
    assert (b.batch_size, b.half, b.unload_after_use, b.dimensions) == (8, True, True, 4096) and get_backend("lmstudio").base_url == "http://localhost:1234/v1"


def test_each_sentence_is_embedded_once(spark, tmp_path):
    """Counted where it happens, and by the Python evaluations of the plan."""
    log = str(tmp_path / "embedded")

    def load():
        def encode(texts):
            with open(log, "a") as f:
                f.writelines("x\n" for _ in texts)
            return [[len(t), 1.0, t.count("a")] for t in texts]

        return encode

    b = ModelBackend("counted", load=load)
    d = docs(spark, "One two. Three four! Five? Six seven.", "Alone.", "A b. C d.")
    for sentences in (False, True):
        df = api.analyze_trajectory(d, b, include_sentences=sentences)
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython") == 1
        open(log, "w").close()
        assert df.count() == 3
        df.collect()
    assert len(open(log).read().split()) <= 14  # 7 sentences by count(), if it needs them, and by collect()


def test_model_is_loaded_once_per_worker(spark):
    import os

    def load():
        loaded = [0]
        loaded[0] += 1
        return lambda texts: [[float(os.getpid()), float(id(loaded))] for _ in texts]

    b = ModelBackend("once", load=load)
    df = spark.range(40).repartition(8).selectExpr("id as doc_id", "cast(id as string) as text")
    seen = {tuple(r.e) for _ in range(2) for r in b.embed(df).collect()}
    assert len(seen) == len({pid for pid, _ in seen})


def test_model_backend(spark):
    b = ModelBackend("lengths", load=lambda: lambda texts: [[len(t), 1] for t in texts], batch_size=2)
    assert [r.e for r in b.embed(docs(spark, "a", "bbb", None)).orderBy("doc_id").collect()] == [[1.0, 1.0], [3.0, 1.0], [0.0, 1.0]]


def test_configuration(spark):
    spark.conf.set("spark.kinetext.embedding.backend", "hash")
    spark.conf.set("spark.kinetext.embedding.dimensions", "12")
    assert api.Models.from_conf(spark).backend().dimensions == 12
    spark.conf.unset("spark.kinetext.embedding.backend")
    spark.conf.unset("spark.kinetext.embedding.dimensions")
    assert api.Models.from_conf(spark).name == "hash"


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("select kx_dot(array(1D, 2D), array(3D, 4D)) d, kx_norm(array(3D, 4D)) n, kx_cosine_distance(array(1D, 0D), array(0.8D, 0.6D)) c, kx_cosine_similarity(array(0D), array(1D)) z, kx_text_key('hello') k, kx_jaccard('the cat sat', 'the dog sat') j, kx_preview('abcd', 3) p").first()
    assert (r.d, r.n, round(r.c, 12), r.z, r.k, r.j, r.p) == (11.0, 5.0, 0.2, 0.0, "2cf24dba5fb0a30e", 0.5, "abc...")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [3.0, 4.0]), (1, 2, [3.0, 5.0]), (2, 0, [1.0, 1.0])], "key bigint, pos int, e array<double>").write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = spark.readStream.schema("key bigint, pos int, e array<double>").parquet(str(tmp_path / "in"))
    trajectories.motion(s).writeStream.format("memory").queryName("motion").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.place): (r.v, r.a) for r in spark.table("motion").collect()}
    assert got == {(1, 0): (None, None), (1, 1): (5.0, None), (1, 2): (1.0, 4.0), (2, 0): (None, None)}
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 03:00:00', 'a', 3.0D").write.parquet(str(tmp_path / "ev"))
    w = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    trajectories.windowed_counts(w).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 1]
    if old is not None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


#: The counts of both pairs have scalar products 17 and 42 and squares 34, 34 and 98, 72: cosines of exactly a half.
HALF = [
    ("Inenre. Thedatin toanthhesh, from, tionti tiheha that anre blent for thedea thesinnd.\nStheea, ththerble orst, theaat ther of. As thesed the. Helyble inoner thanerth the, ernt.",
     "Ontionen of estiing thin thblent ofthintion thtish anreen ouen anhare thst tiinst. Erble inedhe esennt rein is, hesttion. It st inges, re was esha the attian."),
    ("Of, onanat and, reerntanhe rendat and from, ing ed ananoued thes to ou a, ntes eringre tion innd edwhnd thlyble wh ntat this to re. Inouat the thontier ofatntnd is ersttion a renting. A.\nTist.\nOn. Thhaoution erreesing. Oferststsh ating a st, is that whtion that.",
     "A with anshing threwhin the onan ennden. Ndble lyly haheat thhatian from onan tiansh this ersttition. Thinwh onin this thties onorer is inator thtiontion thhe, ofenerly thndtionhe thed in eaingon edsh thbleat inou oueren thes and whesha oninges erertionble it heat that."),
]


def test_drift_at_a_limit(spark):
    """A drift of exactly 0.5 isn't under 0.5, whatever the last bits of the sums say."""
    rows = drift.between(spark.createDataFrame(HALF, "text_a string, text_b string"), HashBackend()).collect()
    assert [(r.drift, r.interpretation) for r in rows] == [(0.5, "Significant drift (different semantics)")] * 2
    limits = spark.createDataFrame([(x - y,) for x in (0.1, 0.3, 0.5, 0.7) for y in (0.0, 1e-16, 1e-9)], "z double").select(drift.interpretation(F.col("z")).alias("i")).collect()
    assert [r.i.split(" (")[0] for r in limits] == ["Similar", "Similar", "Very similar", "Moderate drift", "Moderate drift", "Similar", "Significant drift", "Significant drift", "Moderate drift", "High drift", "High drift", "Significant drift"]


def test_bulk_drift_at_a_limit(spark):
    """The same through JSON lines."""
    lines = spark.createDataFrame([(i, json.dumps({"text_a": a, "text_b": b})) for i, (a, b) in enumerate(HALF)], "line bigint, value string")
    out = drift.bulk(src.parse_lines(lines), HashBackend()).collect()
    assert [(r.drift, r.interpretation) for r in out] == [(0.5, "Significant drift (different semantics)")] * 2


def test_drift_halfway(spark):
    """Drifts of exactly 7/32, 5/32 and 1/32 go up at 4 places; their sums end a bit below."""
    words = {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64: w for w in (f"w{i}" for i in range(1000))}
    text = lambda *counts: " ".join(words[i] for i, n in enumerate(counts) for _ in range(n))
    pairs = [(text(2, 1, 1, 5, 1), text(1, 3, 3, 3, 2)), (text(1, 1, 2, 1, 5), text(1, 2, 3, 3, 3)), (text(1, 3, 3, 2, 3), text(1, 3, 3, 3, 2))]
    assert [r.drift for r in drift.between(spark.createDataFrame(pairs, "text_a string, text_b string"), HashBackend()).collect()] == [0.2188, 0.1563, 0.0313]
    lines = spark.createDataFrame([(i, json.dumps({"text_a": a, "text_b": b})) for i, (a, b) in enumerate(pairs)], "line bigint, value string")
    assert [r.drift for r in drift.bulk(src.parse_lines(lines), HashBackend()).collect()] == [0.2188, 0.1563, 0.0313]
