"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells. Each vector is stored in the cell of its nearest centroids
and visits cells in the multi-sequence order (rising sum of its distances to the two centroids). How many cells it has to
visit is measured: for vectors of the sample, neighbours are drawn at exactly the threshold's angle, in random
directions, and the number is the one at which ``recall`` of them are met from either side. Cosines of what
meets are then computed in double precision; no link is kept without that.

Bounds: the codebooks and the number of visits are fitted on at most ``SAMPLE`` distinct vectors; k, the size of a codebook, grows with the
square root of the vectors up to ``MOST_CENTROIDS``, so that cells keep their size up to half a billion vectors. Cells with many vectors or
visitors are cut into blocks, so no task gathers a cell as a whole. Equal vectors are one node. Vectors of another length are
indexed apart. Components travel as they came (single precision stays single), and cosines are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm.common import batch, map_arrow, materialize, ship, table
from kinetext.llm.graph import components, local_components

THRESHOLD, RECALL, SAMPLE, BLOCK = 0.95, 0.995, 1 << 18, 2048
#: Vectors of a cell aimed at, centroids of a codebook at most, and sampled vectors per centroid (LEAST_SAMPLE at least).
CELL, MOST_CENTROIDS, PER_CENTROID, LEAST_SAMPLE = 32, 4096, 64, 16_384


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly taken rows; an empty cluster takes the row that lies farthest from its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = distances(x, c)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d.min(axis=1))[: len(empty)]]
    return c


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def __post_init__(self):
        # Of the pairs (i, j) of ranks, only those with (i + 1) (j + 1) <= visits can be among the first ``visits``.
        many = np.minimum(len(self.second), self.visits // np.arange(1, min(len(self.first), self.visits) + 1))
        i = np.repeat(np.arange(len(many)), many)
        self.ranks = i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return distances(x[:, :h], self.first).argmin(axis=1) * len(self.second) + distances(x[:, h:], self.second).argmin(axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The first ``visits`` cells of each row in multi-sequence order."""
        h = x.shape[1] // 2
        a, b = distances(x[:, :h], self.first), distances(x[:, h:], self.second)
        ai, bi = a.argsort(axis=1), b.argsort(axis=1)
        i, j = self.ranks
        total = np.take_along_axis(a, ai, 1)[:, i] + np.take_along_axis(b, bi, 1)[:, j]
        best = total.argsort(axis=1, kind="stable")[:, : self.visits]
        return ai[:, i][np.arange(len(x))[:, None], best] * len(self.second) + bi[:, j][np.arange(len(x))[:, None], best]

    @staticmethod
    def fit(sample: np.ndarray, k: int, threshold: float, recall: float) -> Index:
        x = units(sample)
        h = x.shape[1] // 2
        k = min(k, len(x))
        index = Index(kmeans(x[:, :h], k), kmeans(x[:, h:], k), 1)
        rng = np.random.default_rng(7)
        probe = x[rng.permutation(len(x))[:1024]]
        u = rng.standard_normal(probe.shape)
        u = units(u - (u * probe).sum(axis=1, keepdims=True) * probe) if x.shape[1] > 1 else probe
        other = units(threshold * probe + np.sqrt(1 - threshold**2) * u)
        ranks = np.minimum(index._rank(probe, other), index._rank(other, probe))
        return Index(index.first, index.second, int(min(k * k, max(1, np.ceil(np.quantile(ranks, recall)) + 1))))

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells come before that of ``y`` in the order of ``x``: for each centroid of one half, a search among those of the other."""
        h, k = x.shape[1] // 2, len(self.second)
        a, b = distances(x[:, :h], self.first), distances(x[:, h:], self.second)
        i, j = np.divmod(self.cells(y), k)
        own = np.arange(len(x))
        last = a[own, i] + b[own, j]
        b.sort(axis=1)
        return np.array([np.searchsorted(b[r], last[r] - a[r] - 1e-12, "left").sum() for r in own])


_DEALT = pa.schema([("cell", pa.int64()), ("sub", pa.int32()), ("visitor", pa.bool_()), ("rep", pa.int64()), ("times", pa.int64()), ("vector", pa.binary()), ("visits", pa.binary())])
_MET = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding): n_links, component_id and kept.

    Linked are rows whose cosine is at least ``threshold`` and that meet in the index. Rows whose vec_id is null, whose vector is null,
    empty, zero, or holds null or non-finite components link with nothing and are their own component; so do vectors of different
    lengths with each other. Equal vectors link with each other; rows that share a vec_id count as one node; other columns are dropped
    first; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    nodes = materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")).withColumn("d", F.size("embedding")), "vectors")
    # One index for each length; hardly ever more than one.
    met = [_links(nodes.filter(F.col("d") == r.d), r.n, kind, threshold, recall, sample) for r in nodes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()]
    if not met:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = materialize(reduce(DataFrame.unionByName, met), "met")
    comp = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "rep", "left").join(comp, nodes.rep == comp.node, "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    out = rows.join(named, (rows.embedding == named.embedding) & rows.vec_id.isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def codebook(total: int) -> int:
    """Centroids of each half: cells of about CELL vectors as long as MOST_CENTROIDS allow."""
    return int(np.clip(np.sqrt(total / CELL), 2, MOST_CENTROIDS))


def _links(nodes: DataFrame, total: int, kind: str, threshold: float, recall: float, sample: int) -> DataFrame:
    """(rep, links, root) of the ``total`` distinct vectors (embedding, rep, times) of one length."""
    k = codebook(total)
    drawn = np.array([r.embedding for r in nodes.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(min(sample, max(LEAST_SAMPLE, PER_CENTROID * k))).collect()])
    index = Index.fit(drawn, k, threshold, recall)
    cells, form = len(index.first) * len(index.second), np.float32 if kind == "float" else np.float64
    # Blocks of stored vectors and of visitors: twice what a cell has on the average, BLOCK at least.
    most = np.maximum(BLOCK, 2 * np.array([total, total * index.visits]) // cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for b in batches:
            x = _vectors(b.column(0))
            for a in range(0, len(x), 512):
                u = units(x[a : a + 512])
                n.append(np.unique(np.concatenate([index.cells(u) * 2, index.order(u).ravel() * 2 + 1]), return_counts=True))
            if len(n) > 200:
                n = [_added(n)]
        key, times = _added(n)
        yield pa.RecordBatch.from_pydict({"key": key, "n": times})

    # Only cells that are cut reach the driver: at most half of all.
    counted = map_arrow(nodes.select("embedding"), count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    cut = {r.key: r.n for r in counted.filter(F.col("n") > F.when(F.col("key") % 2 == 0, int(most[0])).otherwise(int(most[1]))).collect()}
    hot = np.array(sorted(cut), np.int64)
    blocks = np.array([-(-cut[c] // int(most[c % 2])) for c in hot.tolist()], np.int64)

    def parts(cell: np.ndarray, visitor: int) -> np.ndarray:
        """Blocks of stored vectors (0) or visitors (1) of each cell."""
        if not len(hot):
            return np.ones(len(cell), np.int64)
        at = np.minimum(np.searchsorted(hot, cell * 2 + visitor), len(hot) - 1)
        return np.where(hot[at] == cell * 2 + visitor, blocks[at], 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rep, times = _vectors(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for a in range(0, len(x), 512):
                u = units(x[a : a + 512])
                r, t = rep[a : a + 512], times[a : a + 512]
                spread = (r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                own, seen = index.cells(u), index.order(u)
                vec = [v.tobytes() for v in x[a : a + 512].astype(form)]
                packed = [v.tobytes() for v in seen.astype(np.uint32)]
                i = np.concatenate([np.arange(len(u)), np.repeat(np.arange(len(u)), seen.shape[1])])
                cell = np.concatenate([own, seen.ravel()])
                visitor = np.arange(len(i)) >= len(u)
                of = parts(cell, 0), parts(cell, 1)
                # a stored vector has one block and goes to all blocks of visitors, a visitor the other way round
                mine = (spread[i] % np.where(visitor, of[1], of[0]).astype(np.uint64)).astype(np.int64)
                many = np.where(visitor, of[0], of[1])
                j = np.repeat(np.arange(len(i)), many)
                other = np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many)
                sub = np.where(visitor[j], other * of[1][j] + mine[j], mine[j] * of[1][j] + other)
                for c in range(0, len(j), 20_000):
                    q = j[c : c + 20_000]
                    k = i[q]
                    yield batch(_DEALT, cell=cell[q], sub=sub[c : c + 20_000].astype(np.int32), visitor=visitor[q], rep=r[k], times=t[k], vector=[vec[m] for m in k], visits=[None if w else packed[m] for m, w in zip(k, visitor[q], strict=True)])

    def meet(group: pa.Table) -> pa.Table:
        visitor = group["visitor"].to_numpy()
        x = units(np.frombuffer(b"".join(group["vector"].to_pylist()), form).reshape(len(visitor), -1))
        rep, times = group["rep"].to_numpy(), group["times"].to_numpy()
        s, v = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        if not len(s) or not len(v):
            return pa.table({"rep": [], "links": [], "root": []}, schema=_MET)
        seen = np.frombuffer(b"".join(group["visits"].filter(pa.array(~visitor)).to_pylist()), np.uint32).reshape(len(s), -1)
        home = index.cells(x[v])
        names, at = np.unique(rep, return_inverse=True)
        links, label = np.zeros(len(names), np.int64), np.arange(len(names))
        for a in range(0, len(v), 1024):
            i, j = np.nonzero(x[v[a : a + 1024]] @ x[s].T >= threshold)
            i += a
            differ = rep[v[i]] != rep[s[j]]
            i, j = i[differ], j[differ]
            if not len(i):
                continue
            np.add.at(links, at[v[i]], times[s[j]])
            # the pair counts once for either side: here too, unless the stored vector visits the other's cell in turn
            back = (seen[j] == home[i][:, None]).any(axis=1)
            np.add.at(links, at[s[j[~back]]], times[v[i[~back]]])
            label = local_components(len(names), np.concatenate([np.arange(len(names)), at[v[i]]]), np.concatenate([label, at[s[j]]]))
        hit = links > 0
        return pa.table({"rep": names[hit], "links": links[hit], "root": names[label][hit]}, schema=_MET)

    dealt = map_arrow(nodes.select("embedding", "rep", "times"), deal, "cell bigint, sub int, visitor boolean, rep bigint, times bigint, vector binary, visits binary")
    return dealt.groupBy("cell", "sub").applyInArrow(meet, "rep bigint, links bigint, root bigint")


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate([c[k] for c in counts]) for k in (0, 1))
    new, at = np.unique(key, return_inverse=True)
    return new, np.bincount(at, weights=n, minlength=len(new)).astype(np.int64)


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
