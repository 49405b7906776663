"""Duplicate marking by 5' coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import flags as fl
from . import mates

#: Unmapped, secondary, QC fail and supplementary records take no part; the last three must be in any choice of it.
EXCLUDED, MUST_EXCLUDE = 0xB04, 0x900
MIN_QUALITY = 15


def five_prime() -> Column:
    """Where sequencing began, clips counted: the unclipped start of a forward read, the unclipped end of a reverse one."""
    return F.when(fl.has(F.col("flag"), fl.REVERSE), cg.unclipped_end(F.col("pos0"), F.col("cigar"))).otherwise(cg.unclipped_start(F.col("pos0"), F.col("cigar")))


def keyed(reads: DataFrame, *, excluded: int = EXCLUDED, min_quality: int = MIN_QUALITY, one_chrom: bool = False, library: str | None = None, force: bool = True) -> DataFrame:
    """Eligible reads with their key (ref_id, 5' coordinate, reverse, library), quality sum, and whether they count as paired."""
    if excluded & MUST_EXCLUDE != MUST_EXCLUDE:
        raise ValueError("secondary and supplementary records (0x900) must be excluded")
    own = reads.withColumn("flag", fl.without_bits(F.col("flag"), fl.DUPLICATE)) if force else reads
    if not force:
        marked = F.when(fl.has(F.col("flag"), fl.DUPLICATE), F.raise_error(F.lit("a record is marked as duplicate already; pass force to mark anew")))
        own = own.withColumn("flag", F.coalesce(marked.cast("int"), F.col("flag")))
    own = own.filter(fl.passes(F.col("flag"), 0, excluded | fl.UNMAPPED))
    paired = fl.has(F.col("flag"), fl.PAIRED) & ~fl.has(F.col("flag"), fl.MATE_UNMAPPED)
    if one_chrom:
        paired = paired & (F.col("ref_id") == F.col("mate_ref_id"))
    key = F.struct(F.col("ref_id"), five_prime().alias("c5"), fl.has(F.col("flag"), fl.REVERSE).alias("reverse"), (F.col(library) if library else F.lit(0)).alias("lib"))
    return own.select("*", key.alias("key"), bs.quality_sum(F.col("qual"), min_quality).alias("sumq"), paired.alias("paired"))


def fragment_duplicates(keys: DataFrame) -> DataFrame:
    """rec_idx of unpaired reads that share their key with a paired one, or with a better unpaired one (the earlier, if equal)."""
    best = keys.groupBy("key").agg(F.max("paired").alias("any_paired"), F.max(F.when(~F.col("paired"), F.struct(F.col("sumq"), (-F.col("rec_idx")).alias("i")))).alias("best"))
    lone = keys.filter("not paired").select("rec_idx", "key")
    return lone.join(best, "key").filter(F.col("any_paired") | (F.col("best.i") != -F.col("rec_idx"))).select("rec_idx")


def pair_duplicates(keys: DataFrame) -> DataFrame:
    """rec_idx of both reads of each pair but the best of its two keys: the highest quality sum.

    If equal, the pair whose leftmost read (by reference and 5' coordinate, else the earlier) is the earliest.
    """
    pairs = mates.by_coordinate(keys.filter("paired"), ["key", "sumq"])
    at = lambda k: F.struct(F.col(f"{k}.ref_id").alias("r"), F.col(f"{k}.c5").alias("c"))
    left = F.when(at("key1") < at("key2"), F.col("rec_idx1")).when(at("key2") < at("key1"), F.col("rec_idx2")).otherwise(F.col("rec_idx1"))
    pairs = pairs.select(left.alias("left"), "rec_idx1", "rec_idx2", F.least("key1", "key2").alias("k1"), F.greatest("key1", "key2").alias("k2"), (F.col("sumq1") + F.col("sumq2")).alias("sumq"))
    # The best is aggregated before the shuffle, so a deep pile of copies doesn't gather in one task.
    best = pairs.groupBy("k1", "k2").agg(F.max(F.struct(F.col("sumq"), (-F.col("left")).alias("i"))).alias("best"))
    worse = pairs.join(best, ["k1", "k2"]).filter(F.col("best.i") != -F.col("left"))
    return worse.select(F.explode(F.array("rec_idx1", "rec_idx2")).alias("rec_idx"))


def mark(reads: DataFrame, *, remove: bool = False, **options) -> DataFrame:
    """``reads`` with the duplicate bit set on duplicates and clear elsewhere, or without the duplicates.

    A paired read is only judged by its pair; one without its mate is never a duplicate.
    """
    keys = keyed(reads, **options)
    found = fragment_duplicates(keys).unionByName(pair_duplicates(keys)).withColumn("_dup", F.lit(True))
    if remove:
        return reads.join(found, "rec_idx", "left_anti")
    clear = fl.without_bits(F.col("flag"), fl.DUPLICATE)
    return reads.join(found, "rec_idx", "left").withColumn("flag", F.when(F.col("_dup"), fl.with_bits(clear, fl.DUPLICATE)).otherwise(clear)).select(*reads.columns)


def best_per_key(df: DataFrame, keys: list[str], best: Column, tie: Column) -> DataFrame:
    """The row of each key with the highest ``best``, the lowest ``tie`` if equal."""
    w = Window.partitionBy(*keys).orderBy(best.desc(), tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
