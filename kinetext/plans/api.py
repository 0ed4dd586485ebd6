"""The public tools as DataFrame functions. Bad input gives a row with an ``error``, never a failed job."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.functions import text as tx
from kinetext.functions import vectors as vx
from kinetext.operators import classify, compare, drift, scores, sentences
from kinetext.operators import kinematics as km
from kinetext.operators.embedding import Backend, EmbeddingCache, get_backend

#: Fixed names of the settings in the environment.
ENVIRONMENT = {"backend": "EMBEDDING_BACKEND", "base_url": "EMBEDDING_SERVER_URL", "model_name": "EMBEDDING_MODEL"}
NOTE = "Use full_vector=true for complete embedding"


def embed_text(df: DataFrame, backend: Backend, full_vector: bool = False, model: str | None = None, cache: EmbeddingCache | None = None) -> DataFrame:
    """``df`` (doc_id, text): preview, dimensions and the first ten values or the whole vector. ``model`` is only repeated in the result."""
    rows = df.select("doc_id", "text", (F.coalesce("text", F.lit("")) == "").alias("_empty"))
    t = cache.embed(rows, backend) if cache is not None else backend.embed(rows)
    ok = lambda c, name: F.when(~F.col("_empty"), c).alias(name)
    tail = [ok(F.col("e"), "embedding")] if full_vector else [ok(F.slice("e", 1, 10), "embedding_preview"), ok(F.lit(NOTE), "note")]
    return t.select("doc_id", ok(tx.preview(F.col("text"), 100), "text_preview"), F.lit(model or backend.model_name).alias("model"), ok(F.size("e"), "dimensions"), *tail, F.when(F.col("_empty"), F.lit("No text provided")).alias("error"))


def calculate_drift(pairs: DataFrame, backend: Backend) -> DataFrame:
    return drift.between(pairs, backend)


def classify_document(docs: DataFrame, categories: DataFrame, backend: Backend, threshold: float = classify.THRESHOLD) -> DataFrame:
    return classify.classify(docs, categories, backend, threshold)


def passages(docs: DataFrame, backend: Backend, splitter=sentences.regex_sentences) -> DataFrame:
    """(doc_id, pos, sentence, e) of all sentences.

    The exchange by document that the measures need comes before embedding: it moves sentences instead of vectors, and all that
    follows needs no other and reads each vector once.
    """
    return backend.embed(sentences.split(docs, splitter).repartition(F.col("doc_id")), "sentence", "e")


def analyze_trajectory(docs: DataFrame, backend: Backend, acceleration_threshold: float = 0.3, include_sentences: bool = False, splitter=sentences.regex_sentences) -> DataFrame:
    """``docs`` (doc_id, text): all metrics of each passage; with ``include_sentences`` also the sentences and the three profiles. Each sentence is embedded once."""
    seq = passages(docs.select("doc_id", "text"), backend, splitter)
    more = {"sentences": km.in_order("sentence")} | {name: km.in_order(c, 4) for name, c in km.PROFILES.items()} if include_sentences else {}
    out = scores.report(scores.measure(seq, acceleration_threshold, keep=("sentence",) if include_sentences else (), **more), also=tuple(more))
    none = F.coalesce("text", F.lit("")) == ""
    error = F.when(none, F.lit("No text provided")).when(F.col("n_sentences").isNull(), F.lit("Need at least 2 sentences, got 0")).otherwise(F.col("error"))
    return docs.select("doc_id", "text").join(out, "doc_id", "left").withColumn("error", error).drop("text")


def compare_trajectories(pairs: DataFrame, backend: Backend, acceleration_threshold: float = 0.3, splitter=sentences.regex_sentences) -> DataFrame:
    """``pairs`` (pair_id, golden_text, synthetic_text): comparison of each. Every distinct text is split, embedded and measured once."""
    keyed = pairs.select("pair_id", "golden_text", "synthetic_text", tx.text_key(F.col("golden_text")).alias("golden_id"), tx.text_key(F.col("synthetic_text")).alias("synthetic_id"))
    texts = keyed.select(F.explode(F.array(F.struct(F.col("golden_id").alias("doc_id"), F.col("golden_text").alias("text")), F.struct(F.col("synthetic_id").alias("doc_id"), F.col("synthetic_text").alias("text")))).alias("x")).select("x.*").filter(F.coalesce("text", F.lit("")) != "").dropDuplicates(["doc_id"])
    known = compare.profile_of(passages(texts, backend, splitter), acceleration_threshold)
    done = compare.compare(keyed.select("golden_id", "synthetic_id").distinct(), known, known)
    lost = F.when(F.coalesce("golden_text", F.lit("")) == "", F.lit("No golden_text provided")).when(F.coalesce("synthetic_text", F.lit("")) == "", F.lit("No synthetic_text provided"))
    out = keyed.join(done, ["golden_id", "synthetic_id"], "left")
    error = F.coalesce(lost, F.col("error"), F.when(F.col("fitness_score").isNull(), F.lit("Need at least 2 sentences, got 0")))
    return out.withColumn("error", error).drop("golden_id", "synthetic_id", "golden_text", "synthetic_text")


class Models:
    """The backend in use and its cache: status, load, unload. Lives on the driver; options belong to a backend's constructor."""

    def __init__(self, spark: SparkSession, backend: str = "hash", cache_path: str | None = None, **options):
        self.spark, self.name, self.options = spark, backend, {backend: options}
        self.cache = EmbeddingCache(spark, cache_path)
        self.active: Backend | None = None

    @classmethod
    def from_conf(cls, spark: SparkSession, cache_path: str | None = None, environ: Mapping[str, str] = os.environ) -> Models:
        """Backend and options from ``spark.kinetext.embedding.backend`` and ``spark.kinetext.embedding.<option>``; what these
        don't name, from the driver's environment (ENVIRONMENT)."""
        prefix = "spark.kinetext.embedding."
        have = {option: environ[name] for option, name in ENVIRONMENT.items() if environ.get(name)}
        have |= {k.removeprefix(prefix): v for k, v in spark.conf.getAll.items() if k.startswith(prefix)}
        name = have.pop("backend", "hash")
        if name in ("hash", "table"):
            have.pop("base_url", None)
        return cls(spark, name, cache_path, **{k: int(v) if v.isdigit() else v for k, v in have.items()})

    def backend(self) -> Backend:
        if self.active is None:
            self.active = get_backend(self.name, **self.options.get(self.name, {}))
        return self.active

    def model_status(self) -> dict:
        a = self.active
        base = {"backend": self.name, "cache_size": self.cache.size()}
        if a is None:
            return base | {"model_name": "not initialized", "is_loaded": False, "dimensions": "unknown"}
        return base | {"model_name": a.model_name, "is_loaded": a.is_loaded, "dimensions": a.dimensions if a.dimensions is not None else "unknown (model not loaded)"}

    def model_load(self, backend: str | None = None, **options) -> dict:
        """Switching the backend empties the cache; a backend's earlier options stay unless given anew."""
        if backend and backend != self.name:
            get = self.options.setdefault(backend, {})
            self.active, self.name = None, backend
            self.cache.clear()
            get.update(options)
        elif options:
            self.options.setdefault(self.name, {}).update(options)
            self.active = None
        a = self.backend()
        return {"status": "loaded", "backend": self.name, "model_name": a.model_name, "is_loaded": a.is_loaded}

    def model_unload(self, clear_cache: bool = True) -> dict:
        cleared = self.cache.clear() if clear_cache else 0
        if self.active is None:
            return {"status": "no model was loaded", "cache_entries_cleared": cleared}
        self.active.unload()
        self.active = None
        return {"status": "unloaded", "cache_entries_cleared": cleared}

    def status_line(self) -> str:
        s = self.model_status()
        return f"{s['backend']} | {s['model_name']} | {'loaded' if s['is_loaded'] else 'not loaded'} | {s['dimensions']}d | cache: {s['cache_size']}"


@dataclass(frozen=True)
class Tool:
    """A tool as a client sees it: what it does, and its parameters as (type, description, default); without a default it is required."""

    name: str
    description: str
    parameters: dict[str, tuple]

    def schema(self) -> dict:
        properties = {}
        for name, (kind, text, *default) in self.parameters.items():
            properties[name] = {"type": kind, "description": text} | ({"default": default[0]} if default and default[0] is not None else {})
            if kind == "object":
                properties[name]["additionalProperties"] = {"type": "string"}
        required = [name for name, x in self.parameters.items() if len(x) == 2]
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": properties} | ({"required": required} if required else {})}


_THRESHOLD = ("number", "Accelerations from here on are spikes", 0.3)
TOOLS = {t.name: t for t in (
    Tool("embed_text", "The embedding of a text: its first ten values, or all of them", {"text": ("string", "Text to embed"), "full_vector": ("boolean", "Give the whole vector", False), "model": ("string", "Name of the model to report", "nomic-embed-text-v1.5")}),
    Tool("calculate_drift", "Cosine distance between the embeddings of two texts", {"text_a": ("string", "One text"), "text_b": ("string", "The other text")}),
    Tool("classify_document", "The category whose exemplar a text is most similar to; the first 2000 characters count", {"content": ("string", "Text to classify"), "categories": ("object", "Exemplar text of each category, in order of preference"), "threshold": ("number", "Similarity from which a match is confident", 0.85)}),
    Tool("analyze_trajectory", "Motion of a passage through embedding space: velocity, acceleration, curvature, spikes and the scores made of them", {"text": ("string", "Passage of two sentences or more"), "acceleration_threshold": _THRESHOLD, "include_sentences": ("boolean", "Give the sentences and the profiles too", False)}),
    Tool("compare_trajectories", "Structural comparison of two passages; a lower fitness is a better match", {"golden_text": ("string", "Passage that sets the structure"), "synthetic_text": ("string", "Passage to compare with it"), "acceleration_threshold": _THRESHOLD}),
    Tool("model_status", "Backend, model, dimensions, whether it is loaded, and the size of the cache", {}),
    Tool("model_load", "Makes the backend ready; a named one becomes the backend first", {"backend": ("string", "Backend to switch to", None), "base_url": ("string", "Address of an embedding endpoint", None), "model_name": ("string", "Model to use", None)}),
    Tool("model_unload", "Gives the model's memory back", {"clear_cache": ("boolean", "Empty the cache too", True)}),
)}
_TYPES = {"string": str, "number": (int, float), "boolean": bool, "object": Mapping}


def list_tools() -> list[dict]:
    """All tools with the schemas of their parameters."""
    return [t.schema() for t in TOOLS.values()]


def call(models: Models, tool: str, arguments: Mapping | None = None) -> dict:
    """One call of a tool as a client makes it. Unknown tools, bad arguments and failures give a result with ``error``, never an exception."""
    if tool not in TOOLS:
        return {"error": f"Unknown tool: {tool}"}
    try:
        given = _checked(TOOLS[tool], dict(arguments or {}))
        if tool.startswith("model_"):
            return getattr(models, tool)(**{k: v for k, v in given.items() if v is not None})
        return _one(models, tool, given)
    except Exception as e:  # noqa: BLE001  whatever went wrong is the answer
        return {"error": str(e)}


def _checked(tool: Tool, given: dict) -> dict:
    """Arguments with defaults filled in. Missing texts count as empty ones, whose error the tool itself gives."""
    unknown = sorted(set(given) - set(tool.parameters))
    if unknown:
        raise ValueError(f"{tool.name} has no parameter {', '.join(unknown)}")
    out = {}
    for name, (kind, _, *default) in tool.parameters.items():
        value = given.get(name, default[0] if default else ({} if kind == "object" else ""))
        if value is not None and (not isinstance(value, _TYPES[kind]) or kind == "number" and isinstance(value, bool)):
            raise ValueError(f"{name} has to be of type {kind}")
        out[name] = value
    return out


def _one(models: Models, tool: str, a: dict) -> dict:
    spark, backend = models.spark, models.backend()
    text = lambda x: spark.createDataFrame([(0, x)], "doc_id bigint, text string")
    if tool == "embed_text":
        out = embed_text(text(a["text"]), backend, a["full_vector"], a["model"], models.cache)
    elif tool == "calculate_drift":
        out = calculate_drift(spark.createDataFrame([(a["text_a"], a["text_b"])], "text_a string, text_b string"), backend).drop("text_a", "text_b")
    elif tool == "classify_document":
        if not a["categories"]:
            return {"error": "No content provided" if not a["content"] else "No categories provided"}
        cats = spark.createDataFrame([(k, n, v) for n, (k, v) in enumerate(a["categories"].items())], "category string, ordinal int, exemplar string")
        out = classify_document(text(a["content"]), cats, backend, a["threshold"])
    elif tool == "analyze_trajectory":
        out = analyze_trajectory(text(a["text"]), backend, a["acceleration_threshold"], a["include_sentences"])
    else:
        out = compare_trajectories(spark.createDataFrame([(0, a["golden_text"], a["synthetic_text"])], "pair_id bigint, golden_text string, synthetic_text string"), backend, a["acceleration_threshold"])
    row = out.drop("doc_id", "pair_id").first().asDict(recursive=True)
    error = row.pop("error", None)
    return {"error": error} if error else row


def as_sequence(embeddings: DataFrame) -> DataFrame:
    """The embeddings table as sequences: label as key, vec_id as order."""
    return embeddings.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), vx.double(F.col("embedding")).alias("e"))
