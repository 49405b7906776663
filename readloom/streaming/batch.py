"""Batch forms of the time-bounded operators, for results that a stream's must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(c):
    """Microseconds of a timestamp, with or without a time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def first_in_gap(events: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Events that no event of their keys comes before within ``seconds``: the first of each burst."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    since = micros(ts) - micros(F.lag(ts).over(w))
    return events.withColumn("_since", since).filter(F.col("_since").isNull() | (F.col("_since") > seconds * 1_000_000)).drop("_since")


def match_within(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """l, r: events of one key, the right one no earlier than the left one and less than ``seconds`` after it.

    Both are dealt to time bins of that length and joined by equal (key, bin): a left event looks in its bin and the next.
    """
    span = seconds * 1_000_000
    bin_of = F.floor(micros(ts) / span)
    l = left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("_k"), F.explode(F.array(bin_of, bin_of + 1)).alias("_b"))
    r = right.select(F.struct(*right.columns).alias("r"), F.col(key).alias("_k2"), bin_of.alias("_b2"))
    gap = micros(f"r.{ts}") - micros(f"l.{ts}")
    return l.join(r, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2"))).filter((gap >= 0) & (gap < span)).select("l", "r")
