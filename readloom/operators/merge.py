"""Sorted merges of record sets and of their headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl


def sort_key(order: str = "rec_idx") -> list[Column]:
    """Mapped before unmapped, then reference, position, forward before reverse, input and place in it."""
    return [(F.col("ref_id") < 0).cast("int"), F.col("ref_id"), F.col("pos0"), fl.has(F.col("flag"), fl.REVERSE).cast("int"), F.col("input_no"), F.col(order)]


def union_inputs(inputs: list[DataFrame]) -> DataFrame:
    """All records, with input_no."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("input_no", F.lit(i)) for i, df in enumerate(inputs)])


def merge(inputs: list[DataFrame], order: str = "rec_idx") -> DataFrame:
    """One range-partitioned sort of the union, in the order of a merge of sorted inputs."""
    return union_inputs(inputs).orderBy(*sort_key(order))


def merge_headers(headers: list[DataFrame], *, ignore_pi: bool = False) -> DataFrame:
    """Header lines of all inputs (type, id, raw): read groups and programs united, the rest from the first.

    Other lines must be the same in all inputs, and read groups of one id the same (apart from PI, with ``ignore_pi``), else
    the result raises when read. Programs of one id that differ are left out.
    """
    lines = union_inputs(headers)
    same = F.regexp_replace("raw", "\tPI:[^\t]*", "") if ignore_pi else F.col("raw")
    lines = lines.withColumn("_same", F.when(F.col("type") == "RG", same).otherwise(F.col("raw")))
    groups = lines.filter(F.col("type").isin("RG", "PG")).groupBy("type", "id").agg(F.count_distinct("_same").alias("n"), F.min_by("raw", "input_no").alias("raw"), F.min("input_no").alias("input_no"))
    clash = F.when((F.col("type") == "RG") & (F.col("n") > 1), F.raise_error(F.concat(F.lit("read group "), F.col("id"), F.lit(" differs between inputs"))))
    groups = groups.filter((F.col("type") == "RG") | (F.col("n") == 1)).select("type", "id", F.coalesce(clash.cast("string"), F.col("raw")).alias("raw"))
    rest = lines.filter(~F.col("type").isin("RG", "PG")).groupBy("type", "id", "raw").agg(F.count_distinct("input_no").alias("n"))
    lacking = F.when(F.col("n") < len(headers), F.raise_error(F.concat(F.lit("a header line is not in all inputs: "), F.col("raw"))))
    return rest.select("type", "id", F.coalesce(lacking.cast("string"), F.col("raw")).alias("raw")).unionByName(groups)


def tag_inputs(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Set each record's read group by its input (groups: input_no, rg)."""
    return reads.join(groups, "input_no", "left")
