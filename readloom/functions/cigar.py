"""Cigar parsing, spans and surgery.

Parsing, spans and tests are built-in column expressions. Changes that walk a cigar from an end (clips, indel shifts) are
Arrow scalar functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .surgery import ALL_OPS, MATCH_OPS, PATTERN, QUERY_OPS, REF_OPS, left_shift, parse, soft_clip, text, whole_clip  # noqa: F401



def ops(cigar: Column) -> Column:
    """array<struct<len:int, op:string>>; '*' and null give an empty array."""
    text = F.coalesce(cigar, F.lit("*"))
    lens = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1)), lambda x: x.cast("int"))
    return F.arrays_zip(lens.alias("len"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(2)).alias("op"))


def _sum(cigar: Column, of: str) -> Column:
    """Summed lengths of some operations, without making structs."""
    found = F.regexp_extract_all(F.coalesce(cigar, F.lit("*")), F.lit(f"([0-9]+)[{of}]"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int"))


def ref_span(cigar: Column) -> Column:
    return _sum(cigar, REF_OPS)


def query_length(cigar: Column) -> Column:
    return _sum(cigar, QUERY_OPS)


def align_end(pos0: Column, cigar: Column) -> Column:
    """0-based inclusive end; a read without reference bases ends where it starts."""
    return pos0 + F.greatest(ref_span(cigar), F.lit(1)) - 1


def leading_clip(cigar: Column) -> Column:
    return _sum(F.regexp_extract(F.coalesce(cigar, F.lit("*")), r"^((?:[0-9]+[SH])+)", 1), "SH")


def trailing_clip(cigar: Column) -> Column:
    return _sum(F.regexp_extract(F.coalesce(cigar, F.lit("*")), r"[^SH0-9]((?:[0-9]+[SH])+)$", 1), "SH")


def unclipped_start(pos0: Column, cigar: Column) -> Column:
    return pos0 - leading_clip(cigar)


def unclipped_end(pos0: Column, cigar: Column) -> Column:
    return align_end(pos0, cigar) + trailing_clip(cigar)


def contains_any(cigar: Column, wanted: str) -> Column:
    return cigar.rlike(f"[{''.join(sorted(set(wanted) & set(ALL_OPS)))}]")


def ref_offsets(cigar: Column) -> Column:
    """For each query base its offset from the alignment start, null for inserted and soft-clipped bases: array<int>."""
    step = lambda a, o: F.struct(
        F.when(o["op"].isin(*MATCH_OPS), F.concat(a["out"], F.transform(F.sequence(F.lit(0), o["len"] - 1), lambda i: (i + a["ref"]).cast("int"))))
        .when(o["op"].isin("I", "S"), F.concat(a["out"], F.array_repeat(F.lit(None).cast("int"), o["len"])))
        .otherwise(a["out"])
        .alias("out"),
        (a["ref"] + F.when(o["op"].isin(*REF_OPS), o["len"]).otherwise(0)).alias("ref"),
    )
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("ref"))
    return F.aggregate(F.filter(ops(cigar), lambda o: o["len"] > 0), start, step)["out"]


def query_indices(cigar: Column) -> Column:
    """For each reference base that a read spans the index of its query base, -1 at deletions and skips: array<int>."""
    step = lambda a, o: F.struct(
        F.when(o["op"].isin(*MATCH_OPS), F.concat(a["out"], F.transform(F.sequence(F.lit(0), o["len"] - 1), lambda i: (i + a["q"]).cast("int"))))
        .when(o["op"].isin(*REF_OPS), F.concat(a["out"], F.array_repeat(F.lit(-1), o["len"])))
        .otherwise(a["out"])
        .alias("out"),
        (a["q"] + F.when(o["op"].isin(*QUERY_OPS), o["len"]).otherwise(0)).alias("q"),
    )
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("q"))
    return F.aggregate(F.filter(ops(cigar), lambda o: o["len"] > 0), start, step)["out"]


def base_at(cigar: Column, seq: Column, pos0: Column, at: Column | int) -> Column:
    """The read's base at a reference position, null where it has none."""
    offset = (F.lit(at) if isinstance(at, int) else at) - pos0
    place = F.array_position(ref_offsets(cigar), offset.cast("int"))
    return F.when(place > 0, F.substring(seq, place.cast("int"), F.lit(1)))


def op_at(cigar: Column, index: Column) -> Column:
    """The operation that gives a read's base of this 0-based index, null outside."""
    own = F.filter(ops(cigar), lambda o: o["op"].isin(*QUERY_OPS))
    step = lambda a, o: F.struct(
        (a["q"] + o["len"]).alias("q"),
        F.when(a["op"].isNull() & (index >= a["q"]) & (index < a["q"] + o["len"]), o["op"]).otherwise(a["op"]).alias("op"),
    )
    return F.aggregate(own, F.struct(F.lit(0).alias("q"), F.lit(None).cast("string").alias("op")), step)["op"]


def md(cigar: Column, seq: Column, ref: Column) -> Column:
    """The MD text of an alignment: ``ref`` has the reference bases that it spans. Null where the cigar has skips.

    Runs of equal bases are counted; another reference base stands for itself, deleted ones follow a '^'.
    """
    step = lambda a, q: F.struct(
        (a["at"] + 1).alias("at"),
        F.when(q < 0, 0).when(_same(seq, ref, q, a["at"]), a["n"] + 1).otherwise(0).alias("n"),
        F.when((q >= 0) & _same(seq, ref, q, a["at"]), a["out"])
        .when(q >= 0, F.concat(a["out"], a["n"].cast("string"), F.upper(F.substring(ref, a["at"] + 1, F.lit(1)))))
        .otherwise(F.concat(a["out"], F.when(a["gap"], "").otherwise(F.concat(a["n"].cast("string"), F.lit("^"))), F.upper(F.substring(ref, a["at"] + 1, F.lit(1)))))
        .alias("out"),
        (q < 0).alias("gap"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("out"), F.lit(False).alias("gap"))
    done = F.aggregate(query_indices(cigar), start, step)
    return F.when(~cigar.contains("N") & (cigar != "*") & (seq != "*"), F.concat(done["out"], done["n"].cast("string")))


def _same(seq: Column, ref: Column, q: Column, at: Column) -> Column:
    base = F.upper(F.substring(seq, q + 1, F.lit(1)))
    return (base == "=") | (base == F.upper(F.substring(ref, at + 1, F.lit(1))))


def whole_clip_column(cigar: Column) -> Column:
    hard = lambda p: F.regexp_extract(cigar, p, 1)
    return F.concat(hard("^([0-9]+H)"), query_length(cigar).cast("string"), F.lit("S"), hard("[^0-9]([0-9]+H)$"))


CLIPPED = T.StructType([T.StructField("cigar", T.StringType()), T.StructField("pos0", T.IntegerType())])


@F.arrow_udf(CLIPPED)
def soft_clip_udf(cigar: pa.Array, pos0: pa.Array, front: pa.Array, back: pa.Array) -> pa.Array:
    rows = [soft_clip(c or "*", p if p is not None else -1, f or 0, b or 0) for c, p, f, b in zip(*(x.to_pylist() for x in (cigar, pos0, front, back)), strict=True)]
    return pa.array([{"cigar": c, "pos0": p} for c, p in rows], pa.struct([("cigar", pa.string()), ("pos0", pa.int32())]))


@F.arrow_udf(T.StringType())
def left_shift_udf(cigar: pa.Array, seq: pa.Array) -> pa.Array:
    return pa.array([None if c is None else left_shift(c, s or "") if "I" in c or "D" in c else c for c, s in zip(cigar.to_pylist(), seq.to_pylist(), strict=True)], pa.string())
