"""Difference of two record sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """_keys and _k: the record's place among those of equal keys."""
    named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    w = Window.partitionBy(*[f"_key{i}" for i in range(len(keys))]).orderBy(order)
    return df.select("*", *named).withColumn("_k", F.row_number().over(w))


def full_outer(left: DataFrame, right: DataFrame, keys: list[Column], order: str, near: Column | None = None) -> DataFrame:
    """Rows as l (struct), r (struct): matched by keys and by place among equal keys.

    ``near`` (over l and r) splits a match that it denies into two one-sided rows.
    """
    n = len(keys)
    pack = lambda df, side: ranked(df, keys, order).select(*[F.col(f"_key{i}").alias(f"{side}{i}") for i in range(n)], F.col("_k").alias(f"{side}k"), F.struct(*[F.col(c) for c in df.columns]).alias(side))
    a, b = pack(left, "l"), pack(right, "r")
    on = reduce(lambda x, y: x & y, [F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) for i in range(n)] + [F.col("lk") == F.col("rk")])
    out = a.join(b, on, "full_outer").select("l", "r")
    if near is None:
        return out
    far = F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.coalesce(near, F.lit(False))
    nothing = lambda c: F.lit(None).cast(out.schema[c].dataType)
    sides = F.when(far, F.array(F.struct(F.col("l").alias("l"), nothing("r").alias("r")), F.struct(nothing("l").alias("l"), F.col("r").alias("r")))).otherwise(F.array(F.struct(F.col("l").alias("l"), F.col("r").alias("r"))))
    return out.select(F.explode(sides).alias("x")).select("x.l", "x.r")


def within(distance: int, ref: str = "ref_id", pos: str = "pos0") -> Column:
    """Both records are on one reference and nearer than ``distance``."""
    return (F.col(f"l.{ref}") == F.col(f"r.{ref}")) & (F.abs(F.col(f"l.{pos}") - F.col(f"r.{pos}")) < distance)


def changed_fields(fields: list[str]) -> Column:
    """Names of the fields that differ; null and null are equal."""
    return F.array_compact(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), f) for f in fields]))


def only(left: DataFrame, right: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Records of ``left`` without a partner in ``right``."""
    cols = [f"_key{i}" for i in range(len(keys))] + ["_k"]
    return ranked(left, keys, order).join(ranked(right, keys, order).select(*cols), cols, "left_anti").drop(*cols)


def tagged(left: DataFrame, right: DataFrame, matched: DataFrame) -> dict[str, DataFrame]:
    """The three record outputs of a difference: only1, only2, and the changed records of ``left`` with the other side's values.

    ``matched`` has rec1, rec2 and changed. Changed records get the tags ZF (flag), ZP (reference:position), ZC (cigar), ZM
    (mapping quality), ZN (mate's reference:position), ZI (insert size), ZS (sequence) and ZQ (qualities) of the other record,
    for the fields that differ.
    """
    from ..functions import tags as tg

    one = left.join(matched.filter("rec2 is null").select(F.col("rec1").alias("rec_idx")), "rec_idx", "left_semi")
    two = right.join(matched.filter("rec1 is null").select(F.col("rec2").alias("rec_idx")), "rec_idx", "left_semi")
    both = matched.filter("rec1 is not null and rec2 is not null")
    other = right.select(F.col("rec_idx").alias("rec2"), F.struct(*right.columns).alias("o"))
    j = left.join(both.withColumnRenamed("rec1", "rec_idx"), "rec_idx").join(other, "rec2")
    place = lambda r, p: F.concat_ws(":", F.col(f"o.{r}"), (F.col(f"o.{p}") + 1).cast("string"))
    tags = [("ZF", "i", ["flag"], lambda: F.col("o.flag").cast("string")), ("ZP", "Z", ["ref_id", "pos0"], lambda: place("ref_name", "pos0")), ("ZC", "Z", ["cigar"], lambda: F.col("o.cigar")), ("ZM", "i", ["mapq"], lambda: F.col("o.mapq").cast("string")), ("ZN", "Z", ["mate_ref_id", "mate_pos0"], lambda: place("mate_ref_name", "mate_pos0")), ("ZI", "i", ["insert_size"], lambda: F.col("o.insert_size").cast("string")), ("ZS", "Z", ["seq"], lambda: F.col("o.seq")), ("ZQ", "Z", ["qual"], lambda: F.col("o.qual"))]
    for name, kind, fields, value in tags:
        if set(fields) <= set(right.columns):
            j = j.withColumn("tags", tg.put(F.col("tags"), name, kind, F.when(F.arrays_overlap("changed", F.array(*[F.lit(f) for f in fields])), value())))
    return {"only1": one, "only2": two, "changed": j.select(*left.columns)}
