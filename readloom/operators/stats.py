"""Counts and histograms over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import flags as fl


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def basic(reads: DataFrame) -> DataFrame:
    """One row: counts of records by flag, their shares, and bases."""
    f = F.col("flag")
    mapped = ~fl.has(f, fl.UNMAPPED)
    length = F.when(F.col("seq") == "*", 0).otherwise(F.length("seq"))
    sums = reads.agg(
        F.count(F.lit(1)).alias("total_reads"), _n(mapped).alias("mapped_reads"), _n(fl.has(f, fl.PAIRED)).alias("paired_reads"), _n(fl.has_all(f, fl.PAIRED | fl.PROPER)).alias("proper_pairs"),
        _n(fl.has(f, fl.DUPLICATE)).alias("duplicate_reads"), _n(fl.has(f, fl.QC_FAIL)).alias("qc_fail_reads"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("total_bases"), F.coalesce(F.sum(F.when(mapped, length)), F.lit(0)).cast("long").alias("bases_in_mapped"),
    )
    rate = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("total_reads")), 2)
    return sums.select("*", rate("mapped_reads").alias("mapping_rate"), rate("proper_pairs").alias("proper_rate"), rate("duplicate_reads").alias("duplicate_rate"), rate("qc_fail_reads").alias("qc_fail_rate"))


def read_classes(reads: DataFrame) -> DataFrame:
    """One row: how many reads are of each class that duplicate marking counts."""
    f = F.col("flag")
    return reads.agg(
        F.count(F.lit(1)).alias("n_reads"), _n(fl.has(f, fl.PAIRED)).alias("n_paired"), _n(fl.has(f, fl.PROPER)).alias("n_proper"), _n(fl.has(f, fl.REVERSE)).alias("n_reverse"), _n(fl.has(f, fl.QC_FAIL)).alias("n_qc_fail"),
        _n(fl.has(f, fl.SECONDARY)).alias("n_secondary"), _n(fl.has(f, fl.SUPPLEMENTARY)).alias("n_supplementary"), _n(fl.has(f, fl.UNMAPPED)).alias("n_unmapped"), _n(fl.has(f, fl.MATE_UNMAPPED)).alias("n_mate_unmapped"),
    )


def quality_histogram(reads: DataFrame, *, phred: bool = False, required: int = 0, excluded: int = 0) -> DataFrame:
    """Bases by quality character code (33 to 126) or phred value (0 to 93), zeros included; other bytes are skipped."""
    own = reads.filter(fl.passes(F.col("flag"), required, excluded) & (F.col("qual") != "*"))
    # Counted for each distinct string first: repeated strings are common, and single characters are many.
    seen = own.groupBy("qual").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.split("qual", "")).alias("c"), "n")
    counts = seen.filter("c <> ''").groupBy(F.ascii("c").alias("code")).agg(F.sum("n").alias("n"))
    spark = reads.sparkSession
    every = spark.range(33, 127).select(F.col("id").cast("int").alias("code"))
    out = every.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n_bases"))
    return out.select((F.col("code") - bs.OFFSET).alias("phred"), "n_bases") if phred else out


def counts_by(reads: DataFrame, key: str, name: str = "n_reads") -> DataFrame:
    return reads.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def gaps(reads: DataFrame) -> DataFrame:
    """Reads that start a gap to their mate, with gap = mate start - end - 1.

    Paired, mapped with a mapped mate on the same known reference, neither duplicate, QC fail nor secondary, and the mate not
    earlier; where both start at one place, only the forward read.
    """
    f = F.col("flag")
    fine = fl.passes(f, fl.PAIRED, fl.UNMAPPED | fl.MATE_UNMAPPED | fl.SECONDARY | fl.QC_FAIL | fl.DUPLICATE) & (F.col("ref_id") == F.col("mate_ref_id")) & (F.col("ref_id") >= 0)
    ahead = (F.col("mate_pos0") > F.col("pos0")) | ((F.col("mate_pos0") == F.col("pos0")) & ~fl.has(f, fl.REVERSE))
    return reads.filter(fine & ahead).withColumn("read_end0", cg.align_end(F.col("pos0"), F.col("cigar"))).withColumn("gap", F.col("mate_pos0") - F.col("read_end0") - 1)


def gap_histogram(reads: DataFrame) -> DataFrame:
    return gaps(reads).filter(~fl.has(F.col("flag"), fl.REVERSE)).groupBy("gap").agg(F.count(F.lit(1)).alias("n_reads"))


def gap_details(reads: DataFrame) -> DataFrame:
    """Each gap with its 1-based start, and whether its read is not the first fragment or is reverse."""
    g = gaps(reads)
    return g.select("rec_idx", "ref_id", (F.col("read_end0") + 1).alias("gap_start0"), "gap", (~fl.has(F.col("flag"), fl.FIRST)).alias("not_first"), fl.has(F.col("flag"), fl.REVERSE).alias("reverse"))
