"""Counts for each covered reference position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import flags as fl

#: ASCII code of quality 20.
Q20 = 53
COUNTERS = ("total_reads", "dups", "qc_fail", "mapped", "paired", "proper_pair", "zero_mapq", "low_mapq", "pass_mapq", "mapq_255", "depth", "q20_bases")


def cover(reads: DataFrame) -> DataFrame:
    """A row for each reference position that a read spans (the first one of a read without a cigar): pos, its quality code there (null at deletions and skips), and flags.

    Only what the counters need goes through the explode.
    """
    place = F.when(F.col("cigar") == "*", F.array(F.lit(-1))).otherwise(cg.query_indices(F.col("cigar")))
    r = reads.filter(F.col("ref_id") >= 0).select("ref_id", "pos0", "flag", "mapq", "qual", F.posexplode(place).alias("_o", "_q"))
    return r.select("ref_id", (F.col("pos0") + F.col("_o")).alias("pos"), "flag", "mapq", F.when((F.col("_q") >= 0) & (F.col("qual") != "*"), F.ascii(F.substring("qual", F.col("_q") + 1, F.lit(1)))).alias("code"), (F.col("_q") >= 0).alias("has_base"))


def qc(reads: DataFrame, *, min_mapq: int = 0, required: int = 0, excluded: int = 0, regions: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """One row for each covered position. Conditions apply in this order: duplicate or QC fail, unmapped, mapq 255, mapq low, no base."""
    c = cover(reads.filter(fl.passes(F.col("flag"), required, excluded)))
    if regions is not None:
        inside = regions.select("ref_id", F.explode(F.sequence("start0", F.col("end0_excl") - 1)).alias("pos")).distinct()
        c = c.join(inside, ["ref_id", "pos"], "left_semi")
    if sites is not None:
        c = c.join(sites.select("ref_id", F.col("pos0").alias("pos")).distinct(), ["ref_id", "pos"], "left_anti")
    f = F.col("flag")
    fine = ~fl.has(f, fl.DUPLICATE | fl.QC_FAIL) & ~fl.has(f, fl.UNMAPPED)
    known = fine & (F.col("mapq") != 255)
    deep = known & (F.col("mapq") >= min_mapq) & F.col("has_base")
    n = lambda x: F.count_if(x).cast("long")
    return c.groupBy("ref_id", "pos").agg(
        F.count(F.lit(1)).alias("total_reads"), n(fl.has(f, fl.DUPLICATE)).alias("dups"), n(fl.has(f, fl.QC_FAIL)).alias("qc_fail"), n(fine).alias("mapped"), n(fine & fl.has(f, fl.PAIRED)).alias("paired"),
        n(fine & fl.has_all(f, fl.PAIRED | fl.PROPER)).alias("proper_pair"), n(fine & (F.col("mapq") == 0)).alias("zero_mapq"), n(fine & (F.col("mapq") < 10)).alias("low_mapq"),
        n(fine & ((F.col("mapq") >= min_mapq) | (F.col("mapq") == 255))).alias("pass_mapq"), n(fine & (F.col("mapq") == 255)).alias("mapq_255"), F.round(F.avg(F.when(known, F.col("mapq"))), 6).alias("avg_mapq"), n(known).alias("avg_mapq_count"),
        n(deep).alias("depth"), n(deep & (F.col("code") >= Q20)).alias("q20_bases"),
    )


def percents(positions: DataFrame) -> DataFrame:
    """Counters as shares of total_reads in percent, with 3 decimals."""
    rate = lambda c: F.round(F.when(F.col("total_reads") > 0, 100.0 * F.col(c) / F.col("total_reads")).otherwise(0.0), 3)
    return positions.select("ref_id", "pos", "total_reads", *[rate(c).alias(f"{c}_pct") for c in COUNTERS[1:]], "avg_mapq")


def summary(positions: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each counter over the positions: counter, mean, sd."""
    aggs = [f(c).alias(f"{c}_{t}") for c in COUNTERS for f, t in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
    one = positions.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("counter"), F.round(F.col(f"{c}_mean"), 6).alias("mean"), F.round(F.col(f"{c}_sd"), 6).alias("sd")) for c in COUNTERS])
    return one.select(F.explode(rows).alias("x")).select("x.*")
