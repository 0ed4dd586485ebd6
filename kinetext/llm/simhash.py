"""SimHash near-duplicates: all pairs of fingerprints within a Hamming radius, by vantage-point trees.

The upper part of the tree is built on the driver from a bounded sample of fingerprints; its leaves are the shards. A node parts by the
distance to its vantage point at ``mu``. A fingerprint is a member of the one shard that it falls into; where it lies so
near to a boundary that a partner within the radius may lie beyond (triangle inequality), it also enters
the shards beyond as a query. In each shard the tree goes on, down to small blocks whose distances are
counted bit by bit. Shards return a spanning forest of their links, not pairs.

Growth: on fingerprints without structure a level of the tree lets a query of radius 2 into both children in two cases of five, so that rows
per fingerprint grow by about the power 0.4 of the shards: 4 rows at 64 shards, 8 at 320, 13 at 1024. Hence shards grow
first: up to FEW of them are small, and more are made from ``SHARD`` fingerprints each on. A dense group of fingerprints that no vantage
point parts falls into one shard; a shard of far more rows than the others is cut into blocks that meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from kinetext.llm.common import aside, batch, map_arrow, materialize, mix, shuffle_partitions, ship, table
from kinetext.llm.graph import components, local_components

RADIUS, SHINGLE, SEED = 2, 3, 42
#: The most fingerprints of the sample that the upper tree is built from (8 per shard, 8192 at least), and fingerprints per shard aimed at.
SAMPLE, SHARD = 1 << 19, 500_000
#: Shards that may be smaller, down to so many fingerprints; and rows of a block at least, where a shard is cut.
FEW, SMALL, LEAST_BLOCK = 64, 2_000, 4_096
#: For links by similarity: bands of two minima each, nodes of a block, bits of a parity map at most.
BANDS, CHUNK, MOST_BITS = 8, 512, 1 << 17
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(77).integers(1 << 62, 1 << 63, 2 * BANDS)]


def shingle_hashes(text: bytes, k: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all k-word shingles of a lower-cased text (fewer words: of the whole sequence), in pieces of bounded size."""
    words = text.split()
    n = len(words) - k + 1
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for a in range(0, n, 50_000):
        own = words[a : a + 50_000 + k - 1]
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        m = len(own) - k + 1
        yield np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:m].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, m)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The bits that are set in over half of the shingle hashes of a text (bytes, lower-cased here in A-Z); 0 without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text.lower(), k):
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and _key (a hash of doc_id and text) of every row; null and empty texts: 0."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), k) if t.is_valid else 0 for t in b.column(1)), np.uint64, b.num_rows)
            yield batch(out, doc_id=b.column(0), fp=got.view(np.int64), _key=b.column(2))

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), row_key().alias("_key")), run, "doc_id bigint, fp bigint, _key bigint")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())


def distance(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point).astype(np.int16)


def build(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, mu, left, right) of the upper tree; a negative child -k - 1 is leaf k. Empty: one leaf."""
    nodes: list[tuple[int, int, int, int]] = []
    made = [0]

    def grow(own: np.ndarray, want: int) -> int:
        if want > 1 and len(own) > 1:
            point = own[0]
            d = distance(own, point)
            mu = int(np.median(d))
            left = d <= mu
            if left.all():
                mu = int(d.max()) - 1
                left = d <= mu
            if left.any() and not left.all():
                at = len(nodes)
                nodes.append((0, 0, 0, 0))
                a = grow(own[left][1:] if own[left][0] == point else own[left], want // 2)
                b = grow(own[~left], want - want // 2)
                nodes[at] = (int(point), mu, a, b)
                return at
        made[0] += 1
        return -made[0]

    grow(sample, leaves)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their leaves, and whether they enter as a query: one member row for each fingerprint, queries for shards beyond near boundaries."""
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), bool)
    out: list[tuple[np.ndarray, int, bool]] = []
    todo = [(0, np.arange(len(fps)), False)]
    while todo:
        at, rows, query = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, -at - 1, query))
            continue
        point, mu, a, b = nodes[at]
        d = distance(fps[rows], np.uint64(point))
        if query:
            todo += [(a, rows[d - radius <= mu], True), (b, rows[d + radius > mu], True)]
        else:
            todo += [(a, rows[d <= mu], False), (b, rows[d > mu], False), (b, rows[(d <= mu) & (d + radius > mu)], True)]
    return np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), k) for r, k, _ in out]), np.concatenate([np.full(len(r), q) for r, _, q in out])


def links(members: np.ndarray, queries: np.ndarray, radius: int, block: int = 256, inner: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) within the radius: of members i < j (if ``inner``), and of query i (numbered after the members) and member j."""
    fps = np.concatenate([members, queries])
    todo = [(np.arange(len(members)), np.arange(len(members), len(fps)))]
    while todo:
        m, q = todo.pop()
        if not len(m) or not (inner or len(q)):
            continue
        if len(m) > block:
            point = fps[m[len(m) // 2]]
            d, e = distance(fps[m], point), distance(fps[q], point)
            mu = int(np.median(d))
            if (d <= mu).all():
                mu = int(d.max()) - 1
            left = d <= mu
            if left.any() and not left.all():
                near = m[left & (d + radius > mu)] if inner else m[:0]
                todo += [(m[left], q[e - radius <= mu]), (m[~left], np.concatenate([q[e + radius > mu], near]))]
                continue
        for a in range(0, len(m), block):
            own = m[a : a + block]
            for part, same in [(m[c : c + block], c == a) for c in range(a, len(m) if inner else a, block)] + [(q[c : c + 4 * block], False) for c in range(0, len(q), 4 * block)]:
                near = np.bitwise_count(fps[own][:, None] ^ fps[part][None, :]) <= radius
                if same:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if len(i):
                    yield own[i], part[j]


def shard_count(n: int, sample: int = SAMPLE, shard: int = SHARD) -> int:
    """Shards for ``n`` fingerprints: small ones up to FEW of them, then of ``shard`` fingerprints, as many as the sample allows."""
    return max(1, min(n // min(SMALL, shard) + 1, max(FEW, n // shard + 1), sample // 8))


def dealt(nodes: DataFrame, radius: int, sample: int = SAMPLE, shard: int = SHARD, block: int = LEAST_BLOCK) -> GroupedData:
    """``nodes`` (distinct fp, rep) by the leaves of an upper tree and by pairs of blocks: leaf, sub, fp, rep, and ``side``.

    Sides: 0 and 1 are members and queries of a leaf that is whole; of a leaf that is cut, 0 alone is a block with itself,
    and 2 and 3 are two blocks that meet across only.
    """
    spark = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    shards = shard_count(n, sample, shard)
    drawn = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample, max(8192, 8 * shards))).collect()], np.int64).view(np.uint64)
    tree = build(drawn, shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((shards, 2), np.int64)
        for b in batches:
            _, leaf, query = route(b.column(0).to_numpy().view(np.uint64), tree, radius)
            np.add.at(rows, (leaf, query.astype(int)), 1)
        leaf = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_pydict({"leaf": leaf, "members": rows[leaf, 0], "queries": rows[leaf, 1]})

    # A row per shard: bounded by the sample.
    load = np.zeros((shards, 2), np.int64)
    for r in map_arrow(nodes.select("fp"), count, "leaf bigint, members bigint, queries bigint", rows=0).groupBy("leaf").agg(F.sum("members").alias("m"), F.sum("queries").alias("q")).collect():
        load[r.leaf] = r.m, r.q
    most = max(block, 2 * int(load.sum() // shards))
    parts = np.maximum(1, -(-load // most))
    out = pa.schema([("leaf", pa.int64()), ("sub", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64()), ("side", pa.int32())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            rows, leaf, query = route(f, tree, radius)
            sub, side, at = pair_blocks(f[rows], leaf, query, parts)
            for a in range(0, len(at), 100_000):
                k = rows[at[a : a + 100_000]]
                yield batch(out, leaf=leaf[at[a : a + 100_000]], sub=sub[a : a + 100_000], fp=f[k].view(np.int64), rep=b.column(1).take(pa.array(k)), side=side[a : a + 100_000].astype(np.int32))

    rows = map_arrow(nodes.select("fp", "rep"), deal, "leaf bigint, sub bigint, fp bigint, rep bigint, side int")
    return rows.repartition(shuffle_partitions(spark), "leaf", "sub").groupBy("leaf", "sub")


def pair_blocks(fps: np.ndarray, leaf: np.ndarray, query: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows go: sub, side, and the row. ``parts``: blocks of members and of queries of each leaf.

    Block i of the members meets itself (sub i, i), the blocks j > i of the members, and all blocks of the queries.
    """
    pm, pq = parts[leaf, 0], parts[leaf, 1]
    whole = (pm == 1) & (pq == 1)
    mine = (mix(fps) >> np.uint64(40)).astype(np.int64) % np.where(query, pq, pm)
    times = np.where(whole, 1, np.where(query, pm, pm + pq))
    at = np.repeat(np.arange(len(leaf)), times)
    k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    i, other, wide = mine[at], k, (pm + pq)[at]
    # members: with block k of the members, or block k - pm of the queries; queries: with block k of the members
    low = np.where(query[at], k, np.minimum(i, other))
    high = np.where(query[at], pm[at] + i, np.maximum(i, other))
    side = np.where(query[at] | (i > other), 3, np.where(i == other, 0, 2))
    side = np.where(whole[at], query[at].astype(int), side)
    return np.where(whole[at], 0, low * wide + high), side, at


def meet(side: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links within a group of ``dealt``, as positions."""
    first = np.flatnonzero((side == 0) | (side == 2))
    second = np.flatnonzero((side == 1) | (side == 3))
    order = np.concatenate([first, second])
    for i, j in links(fps[first], fps[second], radius, inner=not (side >= 2).any()):
        yield order[i], order[j]


def near_duplicates(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, block: int = LEAST_BLOCK) -> DataFrame:
    """For ``fps`` (doc_id, fp): each row with component_id, the smallest doc_id that links of ``radius`` bits reach.

    Equal fingerprints are one node, so a group of copies never becomes pairs. A row with a null doc_id links like any other and never
    names a component, unless all its rows are null; repeated rows stay; an empty table gives no rows.
    """
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    forest = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        f = group["fp"].to_numpy()
        label = np.arange(len(f))
        for i, j in meet(group["side"].to_numpy(), f.view(np.uint64), radius):
            label = local_components(len(f), np.concatenate([np.arange(len(f)), i]), np.concatenate([label, j]))
        low = np.full(len(f), np.iinfo(np.int64).max)
        np.minimum.at(low, label, f)
        linked = low[label] != f
        return pa.table({"a": f[linked], "b": low[label][linked]}, schema=forest)

    comp = components(dealt(nodes, radius, sample, shard, block).applyInArrow(search, "a bigint, b bigint"))
    named = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "component").select("fp", "component_id"), "fp")


def parity(shingles: np.ndarray) -> np.ndarray:
    """A map of 2 to 4 bits per distinct shingle; each bit tells whether an odd number of shingles falls on it.

    Two maps differ in at most as many bits as their sets have shingles that aren't in both, and a map folds to half its length.
    """
    bits = min(MOST_BITS, 1 << max(6, (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def candidates(sizes: np.ndarray, maps: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that can reach ``threshold`` by their sizes and parity maps, which loses none; with ``side`` only pairs across."""
    words = np.array([len(m) for m in maps])
    levels = {int(n): np.flatnonzero(words == n) for n in np.unique(words)}
    for low, mine in levels.items():
        for high, others in levels.items():
            if high < low or high * threshold > 2 * low:
                continue
            x, y = np.stack([maps[i] for i in mine]), np.stack([maps[i] for i in others])
            while y.shape[1] > low:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            a, b = sizes[mine][:, None], sizes[others][None, :]
            near = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
            if side is not None:
                near &= side[mine][:, None] != side[others][None, :]
            if low == high:
                near = np.triu(near, 1)
            if not near.any():
                continue
            off, step = np.zeros(near.shape, np.int32), max(1, (1 << 18) // near.size)
            for c in range(0, low, step):
                off += np.bitwise_count(x[:, None, c : c + step] ^ y[None, :, c : c + step]).sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(near & (off <= (1 - threshold) / (1 + threshold) * (a + b) + 1e-9))
            if len(i):
                yield mine[i], others[j]


def sketch(text: bytes, k: int) -> tuple[int, int, int, list[int], bytes]:
    """Fingerprint, hash and size of the set of shingles, its band values (each joins the minima of two hash functions) and parity map. No words: no bands."""
    total, ones, sets = 0, np.zeros(64, np.int64), []
    for h in shingle_hashes(text.lower(), k):
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        sets.append(np.unique(h))
    if not sets:
        return 0, 0, 0, [], b""
    own = np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
    low = np.array([(own * c).min() for c in _ODD], np.uint64)
    bands = mix(mix(low[0::2]) + low[1::2]) ^ np.arange(BANDS, dtype=np.uint64)
    fp = int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])
    return fp, xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own), bands.view(np.int64).tolist(), parity(own).tobytes()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp, sid (hash of the set of shingles), size (of the set), bands, map and _key of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sid", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("map", pa.binary()), ("_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sid, size, bands, maps = zip(*[sketch(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t in b.column(1)], strict=True) if b.num_rows else [()] * 5
            yield batch(out, doc_id=b.column(0), fp=np.array(fp, np.uint64).view(np.int64), sid=np.array(sid, np.uint64).view(np.int64), size=list(size), bands=list(bands), map=list(maps), _key=b.column(2))

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), row_key().alias("_key")), run, "doc_id bigint, fp bigint, sid bigint, size bigint, bands array<bigint>, map binary, _key bigint")


def similar(sets: list[np.ndarray], threshold: float, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with a Jaccard similarity of at least ``threshold``, from exact sizes of all intersections."""
    size = np.array([len(x) for x in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    both = np.zeros((len(sets), len(sets)))
    step = max(1, most // len(sets))
    for a in range(0, len(names), step):
        own = (at >= a) & (at < a + step)
        m = np.zeros((len(sets), min(step, len(names) - a)), np.float32)
        m[row[own], at[own] - a] = 1
        both += m @ m.T
    return np.nonzero(np.triu(both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9, 1))


def verified(docs: DataFrame, met: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of links between nodes that meet (spot, side, sid, size, map, _key) and have a similarity of at least ``threshold``.

    Within a spot, nodes of different sides are compared; of a spot with one side only, all. Parity maps tell which nodes can have a
    partner; those are compared by their whole shingle sets.
    """
    out = pa.schema([("spot", pa.int64()), ("sid", pa.int64()), ("_key", pa.int64())])
    forest = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(group: pa.Table) -> pa.Table:
        side, size = group["side"].to_numpy(), group["size"].to_numpy()
        hit = np.zeros(len(size), bool)
        for i, j in candidates(size, [np.frombuffer(x, np.uint64) for x in group["map"].to_pylist()], threshold, side if side.min() != side.max() else None):
            hit[i] = hit[j] = True
        return group.select(out.names).filter(pa.array(hit)).cast(out)

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("_key", pa.int64()), ("shingles", pa.binary())])
        for b in batches:
            got = [np.unique(np.concatenate(list(shingle_hashes(t.as_buffer().to_pybytes().lower(), k)))).tobytes() for t in b.column(1)]
            yield batch(kind, _key=b.column(0), shingles=got)

    def verify(group: pa.Table) -> pa.Table:
        sid = group["sid"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        label = np.arange(len(sid))
        for i, j in candidates(np.array([len(x) for x in sets]), [parity(x) for x in sets], threshold):
            label = local_components(len(sid), np.concatenate([np.arange(len(sid)), i]), np.concatenate([label, j]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in np.flatnonzero(np.bincount(label, minlength=len(sid)) > 1):
            own = np.flatnonzero(label == c)
            i, j = similar([sets[x] for x in own], threshold)
            comp = local_components(len(own), i, j)
            low = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(low, comp, sid[own])
            linked = low[comp] != sid[own]
            a.append(sid[own][linked])
            b.append(low[comp][linked])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)}, schema=forest)

    close = materialize(met.groupBy("spot").applyInArrow(near, "spot bigint, sid bigint, _key bigint"), "close")
    texts = docs.select(row_key().alias("_key"), "text").join(close.select("_key").distinct(), "_key", "left_semi")
    sets = map_arrow(texts, shingle_sets, "_key bigint, shingles binary").dropDuplicates(["_key"])
    return materialize(close.join(sets, "_key").groupBy("spot").applyInArrow(verify, "a bigint, b bigint"), "verified")


def blocks(bands: DataFrame) -> DataFrame:
    """``bands`` (band, sid, component) so that all nodes of a band meet, save those that a component joins already: sid, spot, side.

    Components of over CHUNK nodes in a band are cut into blocks of their own, which needn't meet each other; all other nodes share
    blocks. Of two blocks that meet, each is a side; a shared block meets itself too.
    """
    many = bands.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("unit", F.when(F.col("n") > CHUNK, F.col("component")))
    units = many.groupBy("band", "unit").agg(F.ceil(F.sum("n") / CHUNK).cast("bigint").alias("parts"))
    block = lambda part: F.struct(F.col("unit").isNotNull().alias("own"), F.coalesce("unit", F.lit(0)).alias("unit"), part.alias("part"))
    every = units.select("band", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("band", block(F.col("part")).alias("other"))
    placed = bands.join(many.filter("unit is not null").select("band", "component", "unit"), ["band", "component"], "left").alias("x")
    placed = placed.join(units.alias("u"), (F.col("x.band") == F.col("u.band")) & F.col("x.unit").eqNullSafe(F.col("u.unit"))).select("x.band", "sid", "x.unit", F.pmod(F.xxhash64("sid", "x.band"), F.col("parts")).alias("part"))
    mine = placed.select("band", "sid", block(F.col("part")).alias("mine"))
    pairs = mine.join(every, "band").filter(~F.col("mine.own") | (F.col("mine.unit") != F.col("other.unit")) | ~F.col("other.own"))
    spot = F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other"))
    return pairs.select("sid", spot.alias("spot"), (F.col("mine") > F.col("other")).alias("side"))


def fingerprint_pairs(fps: DataFrame, radius: int) -> DataFrame:
    """Pairs of fingerprints of ``fps`` (fp, component) within ``radius`` bits whose nodes no component joins already: center, fp."""
    nodes = materialize(fps.groupBy("fp").agg(F.when(F.min("component") == F.max("component"), F.min("component")).alias("rep")), "fingerprints")
    out = pa.schema([("center", pa.int64()), ("fp", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        f, rep = group["fp"].to_numpy(), group["rep"].to_pandas(integer_object_nulls=True).to_numpy()
        mixed, known = np.array([r is None for r in rep], bool), np.array([r or 0 for r in rep], np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in meet(group["side"].to_numpy(), f.view(np.uint64), radius):
            open_ = mixed[i] | mixed[j] | (known[i] != known[j])
            low, high = np.minimum(f[i], f[j])[open_], np.maximum(f[i], f[j])[open_]
            a += [low, np.unique(low)]
            b += [high, np.unique(low)]
        return pa.table({"center": np.concatenate(a), "fp": np.concatenate(b)}, schema=out)

    return dealt(nodes, radius).applyInArrow(search, "center bigint, fp bigint").distinct()


def verified_links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, radius: int, threshold: float) -> DataFrame:
    """(node, component) of the links between ``nodes`` (sid, _key, size, bands, map): texts that share a band or whose fingerprints
    (``rows``: sid, fp) lie within ``radius`` bits, and whose similarity is at least ``threshold``.

    First all meet by band and by equal fingerprint, larger groups in chunks. Then, block against block, larger groups
    meet as a whole, and the pairs within the radius, in both cases without what the first links have joined.
    """
    own = materialize(rows.filter("size > 0").select("sid", "fp").distinct(), "fps")
    bands = nodes.select("sid", F.explode("bands").alias("band")).unionByName(own.select("sid", F.xxhash64("fp", F.lit("fp")).alias("band")))
    counts = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bands = materialize(bands.join(counts, "band"), "bands")
    facts = nodes.select("sid", "_key", "size", "map")
    spot = F.xxhash64("band", F.pmod(F.xxhash64("sid", "band"), F.ceil(F.col("n") / CHUNK)))
    joined = verified(docs, bands.select("sid", spot.alias("spot"), F.lit(False).alias("side")).join(facts, "sid"), k, threshold)
    comp = components(joined)

    component = F.coalesce("component", "sid").alias("component")
    fps = own.join(comp, own.sid == comp.node, "left").select("sid", "fp", component)
    stars = fingerprint_pairs(fps, radius).join(fps, "fp").select(F.xxhash64("center", F.lit("star")).alias("band"), "sid", "component").distinct()
    large = bands.filter(F.col("n") > CHUNK)
    large = large.join(comp, large.sid == comp.node, "left").select("band", "sid", component)
    rest = materialize(large.unionByName(stars), "rest")
    if rest.isEmpty():
        return comp
    more = verified(docs, blocks(rest).join(facts, "sid"), k, threshold)
    return components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def keep_one(docs: DataFrame, radius: int = 2, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group that links join, the row of the smallest doc_id stays (nulls last;
    ties: the smaller hash of the row; of equal rows one).

    Two texts link if they share a band, or the fingerprints of their ``k``-word shingles lie within ``radius`` bits, and if their
    sets of shingles have a Jaccard similarity of at least ``threshold``. Texts of one set are one node; those without words
    count as copies. All columns stay; an empty table stays empty.
    """
    plain, back = aside(docs, "doc_id", "text")
    rows = materialize(sketches(plain, k), "simhash")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))
    nodes = rows.groupBy("sid").agg(F.min(first).alias("one"), F.min_by(F.struct("size", "bands", "map"), first).alias("x"))
    nodes = materialize(nodes.select("sid", "one", F.col("one._key").alias("_key"), "x.*"), "nodes")
    comp = verified_links(plain, rows, nodes, k, radius, threshold)
    groups = nodes.join(comp, nodes.sid == comp.node, "left").groupBy(F.coalesce("component", "sid").alias("group"))
    kept = groups.agg(F.min("one").alias("one")).select(F.col("one._key").alias("_key"))
    found = plain.withColumn("_key", row_key()).join(kept.distinct(), "_key")
    again = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return back(found.withColumn("_again", again).filter("_again = 1"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = materialize(fingerprints(table(spark, sf_dir, "documents")), "simhash")
    return near_duplicates(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
