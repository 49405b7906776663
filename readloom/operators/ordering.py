"""Row numbers and runs over a declared order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, bucket: Column, order: list, name: str = "rec_idx") -> DataFrame:
    """Global row numbers from 1 in ``order``.

    ``bucket`` must rise with the order and hold a moderate number of rows for each value; rows are numbered within their
    bucket, after the summed counts of the buckets before it. Only the table of bucket counts is summed in one task.
    """
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return b.join(offsets, "_bucket").withColumn(name, (F.col("_base") + within).cast("long")).drop("_bucket", "_base")


def first_seen_ids(df: DataFrame, key: str, order: str, span: int = 1 << 16, name: str = "new_id") -> DataFrame:
    """Each key's number (from 0) by its first appearance in ``order`` (a whole number)."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    ids = number_rows(firsts, F.floor(F.col("_first") / span), ["_first"], "_id").select(key, (F.col("_id") - 1).alias(name))
    return df.join(ids, key)


def runs(df: DataFrame, value: str, order: str, partition: list[str], name: str = "run_id") -> DataFrame:
    """A run number (from 0) that rises where ``value`` differs from the row before, within ``partition``."""
    w = Window.partitionBy(*partition).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) | F.lag(order).over(w).isNull(), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
