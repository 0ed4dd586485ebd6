"""All pairs of vectors within each sequence, a block of vectors against a block: products in numpy, one pair of blocks at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetext.operators import kinematics as km

#: Vectors of a block.
SIZE = 1024


def products(rows: DataFrame, key: str, f: Callable[[pa.Scalar, pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, half: bool = False, size: int = SIZE) -> DataFrame:
    """``f`` of each block of a sequence with each one (``half``: with itself and later ones) of ``rows`` (key, pos, u).

    ``f`` gets the key, both blocks as tables (pos), their matrix of scalar products, and where there is one: not where a vector is null or
    holds null, or where lengths differ. It is a nested function, so that workers need no module of this package. A block
    travels once for each partner; sequences of any length are cut into blocks of at most ``size`` vectors, so no task holds more than two.
    """
    block, blocks = F.floor((F.row_number().over(km._window(key)) - 1) / size), F.ceil(F.count(F.lit(1)).over(Window.partitionBy(key)) / size)
    whole = F.when(F.forall("u", lambda x: x.isNotNull()), F.col("u"))
    rows = rows.filter(F.col(key).isNotNull()).select(key, "pos", whole.alias("u"), block.alias("_own"), blocks.alias("_n"))
    # a fixed number of partitions: what comes out has nothing to do with the bytes that go in, by which partitions would be merged
    n, at = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [key, "_i", "_j"]

    def side(own: str, other: str, first: Column, last: Column) -> DataFrame:
        t = rows.select(F.col(key).alias(key), F.col("_own").alias(own), F.explode(F.sequence(first, last)).alias(other), F.col("pos").alias("pos"), F.col("u").alias("u"))
        return t.select(*[F.col(c).alias(c) for c in (*at, "pos", "u")]).repartition(n, *at)  # all columns anew: a cogroup drops those that both sides share

    zero, own, end = F.lit(0).cast("bigint"), F.col("_own"), F.col("_n") - 1
    a, b = side("_i", "_j", own if half else zero, end), side("_j", "_i", zero, own if half else end)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        def matrix(t):
            chunks = [c for c in t["u"].chunks if len(c)]
            lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks])
            if not t["u"].null_count and (lengths == lengths[0]).all():
                return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(len(lengths), -1), lengths
            vectors = t["u"].to_pylist()
            lengths = np.array([-1 if v is None else len(v) for v in vectors])
            m = np.zeros((len(vectors), max(0, lengths.max())))
            for row, v in zip(m, vectors):
                if v:
                    row[: len(v)] = v
            return m, lengths

        (p, long), (q, wide) = matrix(x), matrix(y)
        both = min(p.shape[1], q.shape[1])  # of unequal lengths there is no product
        return f(x[key][0], x, y, p[:, :both] @ q[:, :both].T, (long[:, None] == wide) & (long >= 0)[:, None])

    return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(run, schema)
