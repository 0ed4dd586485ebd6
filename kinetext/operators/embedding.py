"""Embedding backends behind one interface, their registry, and the cache of embedded texts.

``hash`` (the default) needs no model: lower-cased tokens fall into buckets by their MD5, counts are normalised to unit length. ``table``
joins vectors computed before. ``http`` asks an endpoint of the common embeddings API, whole batches at a time.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.functions import text as tx
from kinetext.functions import vectors as vx


class Backend(ABC):
    """Adds a vector column to a table of texts."""

    model_name: str
    dimensions: int | None
    is_loaded = True

    @abstractmethod
    def embed(self, df: DataFrame, text: str = "text", out: str = "e") -> DataFrame: ...

    def unload(self) -> None:
        """Nothing to give back unless a backend says so."""


class HashBackend(Backend):
    def __init__(self, dimensions: int = 64, model_name: str = "hash-md5"):
        self.dimensions, self.model_name = dimensions, model_name

    def vector(self, text: Column) -> Column:
        """Stays in the JVM: buckets of all tokens, counted, at unit length; no tokens: zeros."""
        buckets = F.transform(tx.tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % self.dimensions)
        # sorted buckets, and one fold over them that appends each bucket's count when the next one begins
        state = F.struct(F.array().cast("array<double>").alias("counts"), F.lit(0.0).alias("run"))
        ends = F.concat(F.array_sort(buckets), F.array(F.lit(self.dimensions).cast("bigint")))

        def step(s: Column, x: Column) -> Column:
            at = F.size(s["counts"]).cast("bigint")
            grown = F.concat(s["counts"], F.array(s["run"]), F.array_repeat(F.lit(0.0), (x - at - 1).cast("int")))
            return F.when(x == at, F.struct(s["counts"].alias("counts"), (s["run"] + 1).alias("run"))).otherwise(F.struct(grown.alias("counts"), F.lit(1.0).alias("run")))

        return vx.once(F.aggregate(ends, state, step, lambda s: s["counts"]), vx.normalize)

    def embed(self, df: DataFrame, text: str = "text", out: str = "e") -> DataFrame:
        return df.withColumn(out, self.vector(F.col(text)))


class TableBackend(Backend):
    """Vectors from a table (text_key, e); texts that it lacks get null."""

    def __init__(self, vectors: DataFrame, model_name: str = "table"):
        self.vectors, self.model_name, self.dimensions = vectors, model_name, None

    def embed(self, df: DataFrame, text: str = "text", out: str = "e") -> DataFrame:
        known = self.vectors.select("text_key", vx.double(F.col("e")).alias(out))
        return df.withColumn("text_key", tx.text_key(F.col(text))).join(known, "text_key", "left").drop("text_key")


class HttpBackend(Backend):
    """POSTs {"model", "input": [...]} to base_url/embeddings; one request per ``batch_size`` texts, answers in order."""

    def __init__(self, base_url: str, model_name: str, dimensions: int | None = None, batch_size: int = 32, timeout: float = 60.0):
        self.base_url, self.model_name, self.dimensions, self.batch_size, self.timeout = base_url.rstrip("/"), model_name, dimensions, batch_size, timeout

    def embed(self, df: DataFrame, text: str = "text", out: str = "e") -> DataFrame:
        url, model, size, timeout = f"{self.base_url}/embeddings", self.model_name, self.batch_size, self.timeout

        @F.pandas_udf("array<double>")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from urllib.request import Request, urlopen

            for s in batches:
                got: list[list[float]] = []
                for a in range(0, len(s), size):
                    body = json.dumps({"model": model, "input": s.iloc[a : a + size].fillna("").tolist()}).encode()
                    with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                        got += [x["embedding"] for x in sorted(json.load(r)["data"], key=lambda x: x["index"])]
                yield pd.Series(got)

        return df.withColumn(out, ask(F.col(text)))


def of_worker(kind: str) -> dict:
    """A dictionary that lives as long as the Python process, also where this package comes along by value only."""
    import sys
    import types

    return sys.modules.setdefault(f"_kinetext_{kind}", types.ModuleType(f"_kinetext_{kind}")).__dict__


class ModelBackend(Backend):
    """A local model: ``load`` is called once in each Python worker (and model name) and gives a function from a list of texts to a list of vectors.

    Without ``load`` the named ``sentence_transformers`` model is taken, where that package is installed on the workers; with ``half``
    in half precision, at unit length unless ``normalize`` is off. ``unload_after_use`` gives the model back at
    the end of each task instead of keeping it for the worker's next one.
    """

    def __init__(self, model_name: str, load=None, dimensions: int | None = None, batch_size: int = 32, normalize: bool = True, half: bool = False, unload_after_use: bool = False):
        self.model_name, self.load, self.dimensions, self.batch_size = model_name, load, dimensions, batch_size
        self.normalize, self.half, self.unload_after_use = normalize, half, unload_after_use

    def embed(self, df: DataFrame, text: str = "text", out: str = "e") -> DataFrame:
        name, load, size, unit, half, drop = self.model_name, self.load, self.batch_size, self.normalize, self.half, self.unload_after_use

        @F.pandas_udf("array<double>")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            models = of_worker("models")
            if name not in models:
                if load is None:
                    from sentence_transformers import SentenceTransformer

                    model = SentenceTransformer(name)
                    model = model.half() if half else model
                    models[name] = lambda texts: model.encode(texts, batch_size=size, normalize_embeddings=unit).tolist()
                else:
                    models[name] = load()
            for s in batches:
                texts = s.fillna("").tolist()
                yield pd.Series([[float(v) for v in e] for a in range(0, len(texts), size) for e in models[name](texts[a : a + size])])
            if drop:
                models.pop(name)

        return df.withColumn(out, ask(F.col(text)))


def local_server(model_name: str = "text-embedding-nomic-embed-text-v1.5", base_url: str = "http://localhost:1234/v1", **options) -> HttpBackend:
    """An endpoint on this machine, with the usual defaults."""
    return HttpBackend(base_url, model_name, **options)


def large_model(model_name: str = "nvidia/NV-Embed-v2", **options) -> ModelBackend:
    """A model of 4096 dimensions that needs small batches, half precision, and its memory back after use."""
    return ModelBackend(model_name, **({"dimensions": 4096, "batch_size": 8, "half": True, "unload_after_use": True} | options))


#: Fixed names: backends, and the names under which callers know them.
_REGISTRY: dict[str, Callable[..., Backend]] = {
    "hash": HashBackend, "table": TableBackend, "http": HttpBackend, "model": ModelBackend,
    "lmstudio": local_server, "nv_embed": large_model, "sentence_transformers": ModelBackend,
}


def register(name: str, kind: Callable[..., Backend]) -> None:
    _REGISTRY[name] = kind


def get_backend(name: str = "hash", **options) -> Backend:
    if name not in _REGISTRY:
        raise ValueError(f"unknown backend: {name}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**options)


class EmbeddingCache:
    """Vectors by (model, text key), as a Parquet table if ``path`` is given. Each distinct text is embedded once."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame | None:
        if self.path is None:
            return None
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:  # the table doesn't exist yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return None
            raise

    def size(self) -> int:
        have = self.entries()
        return 0 if have is None else have.count()

    def embed(self, df: DataFrame, backend: Backend, text: str = "text", out: str = "e") -> DataFrame:
        """Adds ``out``: known texts are looked up, each distinct unknown one is embedded once and kept."""
        keyed = df.withColumn("text_key", tx.text_key(F.col(text)))
        distinct = keyed.filter(F.col(text).isNotNull()).dropDuplicates(["text_key"]).select("text_key", F.col(text).alias("_text"))
        have = self.entries()
        if have is not None:
            have = have.filter(F.col("model") == backend.model_name).select("text_key", "e")
            distinct = distinct.join(have, "text_key", "left_anti")
        new = backend.embed(distinct, "_text", "e").select("text_key", "e")
        if self.path is not None:
            new.withColumn("model", F.lit(backend.model_name)).write.mode("append").parquet(self.path)
            new = self.spark.read.parquet(self.path).filter(F.col("model") == backend.model_name).select("text_key", "e")
        elif have is not None:
            new = new.unionByName(have)
        return keyed.join(new.withColumnRenamed("e", out), "text_key", "left").drop("text_key")

    def clear(self) -> int:
        n = self.size()
        if n and self.path is not None:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return n
