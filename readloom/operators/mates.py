"""Pairing of mates and classes of overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import flags as fl

#: No pair of these can overlap: secondary, supplementary, QC fail, duplicate, unmapped, mate unmapped.
OVERLAP_EXCLUDED = 0xF0C


def by_coordinate(reads: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs of equal names whose mate positions name each other: columns of ``keep`` with suffixes 1 (earlier rec_idx) and 2.

    Several records with equal keys match in their order: the k-th earlier record with the k-th later one.
    """
    key = ["read_name", "ref_id", "pos0", "mate_ref_id", "mate_pos0"]
    need = list(dict.fromkeys([*key, "rec_idx", *keep]))
    # Both sides of a pair see the same key: the two places in order.
    place, mate = F.struct("ref_id", "pos0"), F.struct(F.col("mate_ref_id").alias("ref_id"), F.col("mate_pos0").alias("pos0"))
    r = reads.select(*need).withColumn("_lo", F.least(place, mate)).withColumn("_hi", F.greatest(place, mate)).withColumn("_at_lo", place == F.col("_lo"))
    same = F.col("_lo") == F.col("_hi")
    w = Window.partitionBy("read_name", "_lo", "_hi", "_at_lo").orderBy("rec_idx")
    r = r.withColumn("_k", F.row_number().over(w))
    # Where both mates start at one place, the first, third ... are the earlier ones.
    side = F.when(same, (F.col("_k") % 2 == 1)).otherwise(F.col("_at_lo"))
    rank = F.when(same, F.ceil(F.col("_k") / 2)).otherwise(F.col("_k"))
    r = r.withColumn("_side", side).withColumn("_rank", rank)
    cols = lambda tag: [F.col(c).alias(f"{c}{tag}") for c in need]
    on = ["read_name", "_lo", "_hi", "_rank"]
    a = r.filter("_side").select(*[F.col(c).alias(f"a{c}") for c in on], *cols("_a"))
    b = r.filter("not _side").select(*[F.col(c).alias(f"b{c}") for c in on], *cols("_b"))
    p = a.join(b, (F.col("aread_name") == F.col("bread_name")) & (F.col("a_lo") == F.col("b_lo")) & (F.col("a_hi") == F.col("b_hi")) & (F.col("a_rank") == F.col("b_rank")))
    early = F.col("rec_idx_a") < F.col("rec_idx_b")
    pick = lambda c, first: F.when(early if first else ~early, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    return p.select(*[pick(c, True).alias(f"{c}1") for c in need], *[pick(c, False).alias(f"{c}2") for c in need])


def by_adjacency(reads: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs of a name-sorted input: of each name the first with the second record, the third with the fourth, and so on."""
    need = list(dict.fromkeys(["read_name", "rec_idx", *keep]))
    w = Window.partitionBy("read_name").orderBy("rec_idx")
    r = reads.select(*need).withColumn("_k", F.row_number().over(w))
    nxt = [F.lead(c).over(w).alias(f"{c}2") for c in need]
    return r.select(*[F.col(c).alias(f"{c}1") for c in need], *nxt, "_k").filter((F.col("_k") % 2 == 1) & F.col("rec_idx2").isNotNull()).drop("_k")


def missing(reads: DataFrame) -> DataFrame:
    """Paired records that no other record answers: same name, at the mate position, with its mate position here."""
    paired = reads.filter(fl.has(F.col("flag"), fl.PAIRED))
    m = reads.select(F.col("read_name").alias("_n"), F.col("ref_id").alias("_r"), F.col("pos0").alias("_p"), F.col("mate_ref_id").alias("_mr"), F.col("mate_pos0").alias("_mp"), F.col("rec_idx").alias("_i"))
    on = (F.col("read_name") == F.col("_n")) & (F.col("mate_ref_id") == F.col("_r")) & (F.col("mate_pos0") == F.col("_p")) & (F.col("ref_id") == F.col("_mr")) & (F.col("pos0") == F.col("_mp")) & (F.col("rec_idx") != F.col("_i"))
    return paired.join(m, on, "left_anti")


def eligible(excluded: int = OVERLAP_EXCLUDED) -> Column:
    """A read that can overlap its mate: paired, on the mate's reference, with none of the excluded bits."""
    return fl.passes(F.col("flag"), fl.PAIRED, excluded) & (F.col("ref_id") == F.col("mate_ref_id")) & (F.col("ref_id") >= 0)


def overlap_class(excluded: int = OVERLAP_EXCLUDED) -> Column:
    """How a read lies to its mate, by its own end and the mate's start."""
    end, here, there = cg.align_end(F.col("pos0"), F.col("cigar")), F.col("pos0"), F.col("mate_pos0")
    back, mate_back = fl.has(F.col("flag"), fl.REVERSE), fl.has(F.col("flag"), fl.MATE_REVERSE)
    return (
        F.when(~eligible(excluded), "NO_OVERLAP")
        .when((here < there) & (end < there), F.when(back & ~mate_back, "NO_OVERLAP_WRONG_ORIENT").otherwise("NO_OVERLAP"))
        .when(here < there, "OVERLAP")
        .when(here == there, "SAME_START")
        .when(~back & mate_back, "UNKNOWN_OVERLAP_WRONG_ORIENT")
        .otherwise("UNKNOWN_OVERLAP")
    )
