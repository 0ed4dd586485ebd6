"""Streams of texts: counts by time window, and motion of each key's vectors as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

MOTION = StructType([StructField("key", LongType()), StructField("place", LongType()), StructField("v", DoubleType()), StructField("a", DoubleType())])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and their mean value by window and kind; rows later than ``late`` are dropped with their closed window."""
    t = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return t.groupBy(F.window("_ts", size).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "mean_value")


class _Motion(StatefulProcessor):
    """Keeps a key's last vector, last velocity and place: a few hundred bytes, whatever the stream's length."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", StructType([StructField("e", ArrayType(DoubleType())), StructField("v", DoubleType()), StructField("place", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        e, v, place = (np.array(last[0]), last[1], last[2]) if last is not None else (None, None, -1)
        out = []
        for x in pd.concat(list(rows)).sort_values("pos")["e"]:
            x, place = np.asarray(x, float), place + 1
            new = None if e is None else float(np.linalg.norm(x - e))
            out.append((key[0], place, new, None if v is None or new is None else abs(new - v)))
            e, v = x, new
        self.state.update((e.tolist(), v, place))
        yield pd.DataFrame(out, columns=["key", "place", "v", "a"])

    def close(self) -> None:
        pass


def motion(stream: DataFrame) -> DataFrame:
    """For a stream (key, pos, e): each vector's velocity and acceleration; a key's vectors are in order across batches by arrival, in a batch by pos. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(_Motion(), MOTION, "Append", "None")
