"""Checks of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import flags as fl
from ..functions import tags as tg
from . import rewrite

#: Places of the numbers among a line's columns.
NUMBERS = (1, 3, 4, 7, 8)


def rules(n_refs: int | None = None) -> dict[str, Column]:
    """Error name and the condition under which a record has it."""
    f, known = F.col("flag"), F.col("cigar") != "*"
    out = {
        "INVALID_FLAG": (f < 0) | (f > 65535),
        "INVALID_NAME": F.col("read_name").isNull() | (F.length("read_name") < 1) | (F.length("read_name") > 254) | F.col("read_name").rlike("[ \\t@]"),
        "INVALID_MAPQ": (F.col("mapq") < 0) | (F.col("mapq") > 255),
        "INVALID_POS": F.col("pos0") < -1,
        "INVALID_CIGAR": known & ~F.col("cigar").rlike(f"^(?:{cg.PATTERN})+$"),
        "CIGAR_SEQ_LENGTH": known & (F.col("seq") != "*") & F.col("cigar").rlike(f"^(?:{cg.PATTERN})+$") & (cg.query_length(F.col("cigar")) != F.length("seq")),
        "SEQ_QUAL_LENGTH": (F.col("qual") != "*") & (F.col("seq") != "*") & (F.length("seq") != F.length("qual")),
        "MAPPED_WITHOUT_REF": ~fl.has(f, fl.UNMAPPED) & (F.col("ref_id") < 0),
    }
    if n_refs is not None:
        out["UNKNOWN_REF"] = F.col("ref_id") >= n_refs
    return {k: F.coalesce(v, F.lit(True)) for k, v in out.items()}


def faults() -> dict[str, Column]:
    """Error name and condition of a line that isn't a record; its text is in _corrupt_record."""
    p = F.split("_corrupt_record", "\t")
    whole = F.size(p) >= 11
    bad_number = lambda i: p[i].try_cast("int").isNull()
    numbers = bad_number(NUMBERS[0])
    for i in NUMBERS[1:]:
        numbers = numbers | bad_number(i)
    tags = F.exists(F.slice(p, 12, 10000), lambda x: ~tg.well_formed(x))
    return {"TOO_FEW_COLUMNS": ~whole, "NOT_AN_INTEGER": whole & numbers, "INVALID_TAG_FORMAT": (F.size(p) > 11) & tags}


def errors(reads: DataFrame, n_refs: int | None = None) -> DataFrame:
    """rec_idx, error: one row for each rule that a record breaks, or for each fault of a line that isn't a record."""
    named = lambda d: F.array_compact(F.array(*[F.when(c, name) for name, c in d.items()]))
    found = named(rules(n_refs))
    if "_corrupt_record" in reads.columns:
        found = F.when(F.col("_corrupt_record").isNotNull(), named(faults())).otherwise(found)
    return reads.select("rec_idx", F.explode(found).alias("error"))


def md_errors(reads: DataFrame, ref: DataFrame) -> DataFrame:
    """rec_idx, error: mapped records whose MD tag isn't what the reference (ref_id, bases) says. Cigars with skips aren't judged."""
    own = reads.filter(tg.value(F.col("tags"), "MD").isNotNull() & ~fl.has(F.col("flag"), fl.UNMAPPED))
    own = own.filter(cg.query_length(F.col("cigar")) == F.length("seq"))
    met = rewrite.with_reference(own, ref)
    wrong = F.upper(tg.value(F.col("tags"), "MD")) != cg.md(F.col("cigar"), F.col("seq"), F.col("_ref"))
    return met.filter(wrong).select("rec_idx", F.lit("INVALID_MD").alias("error"))


def error_counts(reads: DataFrame, n_refs: int | None = None) -> DataFrame:
    return errors(reads, n_refs).groupBy("error").agg(F.count(F.lit(1)).alias("n_errors"))


def unsorted(reads: DataFrame, by: str = "coordinate", span: int = 1 << 16) -> DataFrame:
    """Records that come before the one in front of them, by coordinate (unmapped last) or read name.

    Neighbours are compared within stretches of ``span`` record numbers; the last record of each stretch is also handed to
    the next one, so no task has all rows.
    """
    key = F.struct((F.col("ref_id") < 0).cast("int").alias("u"), F.col("ref_id"), F.col("pos0")) if by == "coordinate" else F.struct("read_name")
    r = reads.select("rec_idx", key.alias("_key")).withColumn("_block", F.floor(F.col("rec_idx") / span))
    last = r.groupBy("_block").agg(F.max("rec_idx").alias("rec_idx"), F.max_by("_key", "rec_idx").alias("_key"))
    blocks = r.select("_block").distinct().withColumn("_before", F.lag("_block").over(Window.orderBy("_block")))
    handed = last.join(blocks.filter("_before is not null").select(F.col("_block").alias("_to"), "_before"), F.col("_block") == F.col("_before")).select("rec_idx", "_key", F.col("_to").alias("_block"), F.lit(True).alias("_handed"))
    w = Window.partitionBy("_block").orderBy("rec_idx")
    both = r.withColumn("_handed", F.lit(False)).unionByName(handed)
    return both.withColumn("_prev", F.lag("_key").over(w)).filter(~F.col("_handed") & (F.col("_key") < F.col("_prev"))).select("rec_idx")


def until(reads: DataFrame, max_errors: int, n_refs: int | None = None) -> DataFrame:
    """The first ``max_errors`` errors in record order: a top-n, so nothing is summed over all rows."""
    return errors(reads, n_refs).orderBy("rec_idx", "error").limit(max_errors)
