"""Structured Streaming forms of the operators whose state a watermark bounds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def source(spark: SparkSession, folder: str, schema: StructType | str, ts: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files whose ``ts`` has a time zone, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def first_within(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of its keys within ``delay``; state goes once the watermark has passed."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class _Best(StatefulProcessor):
    """Keeps the best row of a key until a timer after its first one; the output is that row."""

    def __init__(self, score: str, columns: list[str], schema: StructType, wait_ms: int):
        self.score, self.columns, self.schema, self.wait_ms = score, columns, schema, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            row = pdf.sort_values([self.score], ascending=False, kind="stable").iloc[0][self.columns]
            have = self.best.get() if self.best.exists() else None
            if have is None:
                self.handle.registerTimer(timer_values.getCurrentWatermarkInMs() + self.wait_ms)
            if have is None or row[self.score] > have[self.columns.index(self.score)]:
                self.best.update(tuple(v.item() if hasattr(v, "item") else v for v in row))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key: Any, timer_values: Any, expired_timer: Any) -> Iterator[pd.DataFrame]:
        if self.best.exists():
            yield pd.DataFrame([self.best.get()], columns=self.columns)
            self.best.clear()

    def close(self) -> None:
        pass


def best_within(events: DataFrame, keys: list[str], score: str, ts: str, delay: str, wait_ms: int) -> DataFrame:
    """The best event of its keys, put out ``wait_ms`` after the first one."""
    own = events.withWatermark(ts, delay)
    columns = [c for c in events.columns if c != ts]
    schema = StructType([events.schema[c] for c in columns])
    return own.groupBy(*keys).transformWithStateInPandas(_Best(score, columns, schema, wait_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def match(left: DataFrame, right: DataFrame, key: str, ts: str, delay: str, seconds: int, how: str = "leftOuter") -> DataFrame:
    """Events of one key within ``seconds``; an outer side without a partner comes once the watermark rules one out."""
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withWatermark(f"l_{ts}", delay)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withWatermark(f"r_{ts}", delay)
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col(f"r_{ts}") >= F.col(f"l_{ts}")) & (F.col(f"r_{ts}") < F.col(f"l_{ts}") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return l.join(r, on, how)


def tumbling(events: DataFrame, keys: list[str], ts: str, delay: str, width: str) -> DataFrame:
    """Counts and sums of value for each window and key, put out once the watermark has passed the window."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), *keys, "n_events", "total")


def late_rows(query) -> int:
    """Rows that came behind the watermark and so were dropped by the query's stateful operators, in the progress it remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Process all that is there and end; exactly once into Parquet. Returns the number of late rows."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return late_rows(query)


def two_pass(stream: DataFrame, handle, checkpoint: str) -> None:
    """``handle(batch, epoch)`` for each micro-batch: the form for operators that read their input twice."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
