"""Clipping of overlapping mates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import flags as fl
from ..functions import surgery as sg
from . import mates

CLIP = T.StructType([T.StructField(n, t) for n, t in (("cigar1", T.StringType()), ("pos1", T.IntegerType()), ("cigar2", T.StringType()), ("pos2", T.IntegerType()), ("loser", T.IntegerType()), ("whole", T.BooleanType()))])


def query_index(parts: list[tuple[int, str]], offset: int, after: bool) -> int:
    """How many query bases lie before reference ``offset`` (counting from the start), or up to it with ``after``."""
    q = r = 0
    last = 0
    for n, o in parts:
        if o in sg.MATCH_OPS:
            if offset < r + n:
                return q + max(offset - r, 0) + (1 if after and offset >= r else 0)
            q, r = q + n, r + n
            last = q
        elif o in "IS":
            q += n
        elif o in "DN":
            if offset < r + n:
                return last
            r += n
    return last if after else q


def mean_code(qual: str, first: int, last: int) -> float:
    part = qual[first : last + 1] if 0 <= first < len(qual) else ""
    return sum(map(ord, part)) / len(part) if part else 0.0


def resolve(c1: str, p1: int, q1: str, rev1: bool, c2: str, p2: int, q2: str, rev2: bool) -> tuple[str, int, str, int, int, bool]:
    """New cigars and positions of a pair whose first read starts no later than the second and reaches it.

    The side with the lower mean quality (the first, if equal) loses: the first its tail from the second's start on, the
    second its head through the first's end, which are also what the means are of. A reverse first read with a forward
    second one points the wrong way: the loser is clipped whole, and the winner loses what is past the overlap.
    """
    a, b = sg.parse(c1), sg.parse(c2)
    span = lambda parts: sum(n for n, o in parts if o in sg.REF_OPS)
    n1, n2 = (sum(n for n, o in parts if o in sg.QUERY_OPS) for parts in (a, b))
    end1, end2 = p1 + span(a) - 1, p2 + span(b) - 1
    tail, head = (query_index(a, p2 - p1, False) if p2 > p1 else 0), (query_index(b, end1 - p2, True) if end1 < end2 else n2)
    first_loses = mean_code(q1, tail, n1 - 1) <= mean_code(q2, 0, head - 1)
    if rev1 and not rev2:
        if first_loses:
            nc, np_ = sg.soft_clip(c2, p2, 0, n2 - query_index(b, end1 - p2, True)) if end2 > end1 else (c2, p2)
            return sg.whole_clip(a), p1, nc, np_, 1, True
        nc, np_ = sg.soft_clip(c1, p1, tail, 0) if p2 > p1 else (c1, p1)
        return nc, np_, sg.whole_clip(b), p2, 2, True
    if first_loses:
        nc, np_ = sg.soft_clip(c1, p1, 0, n1 - tail) if p2 > p1 else (sg.whole_clip(a), p1)
        return nc, np_, c2, p2, 1, p2 == p1
    nc, np_ = sg.soft_clip(c2, p2, head, 0)
    return c1, p1, nc, np_, 2, end1 >= end2


@F.arrow_udf(CLIP)
def resolve_udf(c1: pa.Array, p1: pa.Array, q1: pa.Array, r1: pa.Array, c2: pa.Array, p2: pa.Array, q2: pa.Array, r2: pa.Array) -> pa.Array:
    rows = [resolve(*x) for x in zip(*(v.to_pylist() for v in (c1, p1, q1, r1, c2, p2, q2, r2)), strict=True)]
    names = ("cigar1", "pos1", "cigar2", "pos2", "loser", "whole")
    kinds = pa.struct([("cigar1", pa.string()), ("pos1", pa.int32()), ("cigar2", pa.string()), ("pos2", pa.int32()), ("loser", pa.int32()), ("whole", pa.bool_())])
    return pa.array([dict(zip(names, r, strict=True)) for r in rows], kinds)


def pairs(reads: DataFrame, *, by_name: bool = False, excluded: int = mates.OVERLAP_EXCLUDED) -> DataFrame:
    """Overlapping eligible pairs, the one that starts first as 1, with overlap (reference bases)."""
    own = reads.filter(mates.eligible(excluded))
    keep = ["ref_id", "pos0", "flag", "cigar", "qual"]
    p = (mates.by_adjacency if by_name else mates.by_coordinate)(own, keep)
    swap = F.col("pos02") < F.col("pos01")
    both = ["rec_idx", *keep]
    p = p.select(*[F.when(swap, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}1") for c in both], *[F.when(swap, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in both])
    end1, end2 = cg.align_end(F.col("pos01"), F.col("cigar1")), cg.align_end(F.col("pos02"), F.col("cigar2"))
    return p.withColumn("overlap", F.least(end1, end2) - F.col("pos02") + 1).filter("overlap > 0")


def clip(reads: DataFrame, *, by_name: bool = False, excluded: int = mates.OVERLAP_EXCLUDED, unmapped: bool = False, store_original: str | None = None) -> DataFrame:
    """``reads`` with the overlap of each pair clipped from one of the two; mate positions follow.

    Reads that point the wrong way and don't overlap their mate (or whose mate isn't there) are clipped whole. With
    ``unmapped`` a read that is clipped whole becomes unmapped, and its mate says so. Row order is the caller's (sort after).
    """
    rev = lambda i: fl.has(F.col(f"flag{i}"), fl.REVERSE)
    p = pairs(reads, by_name=by_name, excluded=excluded)
    p = p.withColumn("_c", resolve_udf("cigar1", "pos01", "qual1", rev(1), "cigar2", "pos02", "qual2", rev(2)))
    side = lambda i: F.struct(F.col(f"rec_idx{i}").alias("rec_idx"), F.col(f"_c.cigar{i}").alias("_cigar"), F.col(f"_c.pos{i}").alias("_pos"), F.col(f"_c.pos{3 - i}").alias("_mate"), (F.col("_c.whole") & (F.col("_c.loser") == i)).alias("_gone"), (F.col("_c.whole") & (F.col("_c.loser") == 3 - i)).alias("_mate_gone"))
    new = p.select(F.explode(F.array(side(1), side(2))).alias("x")).select("x.*")
    j = reads.join(new, "rec_idx", "left")
    wrong = F.col("_cigar").isNull() & mates.overlap_class(excluded).isin("NO_OVERLAP_WRONG_ORIENT", "UNKNOWN_OVERLAP_WRONG_ORIENT")
    cigar = F.when(wrong, cg.whole_clip_column(F.col("cigar"))).otherwise(F.coalesce("_cigar", "cigar"))
    if store_original and "tags" in reads.columns:
        from ..functions import tags as tg

        j = j.withColumn("tags", F.when(cigar != F.col("cigar"), tg.put(F.col("tags"), store_original, "Z", F.col("cigar"))).otherwise(F.col("tags")))
    flag = F.col("flag")
    if unmapped:
        gone = F.coalesce(F.col("_gone"), F.lit(False)) | wrong
        flag = F.when(gone, fl.with_bits(flag, fl.UNMAPPED)).when(F.coalesce(F.col("_mate_gone"), F.lit(False)), fl.without_bits(fl.with_bits(flag, fl.MATE_UNMAPPED), fl.PROPER)).otherwise(flag)
        cigar = F.when(gone, "*").otherwise(cigar)
    return j.select(*[{"cigar": cigar, "flag": flag, "pos0": F.coalesce("_pos", "pos0"), "mate_pos0": F.coalesce("_mate", "mate_pos0")}.get(c, F.col(c)).alias(c) for c in reads.columns])


def statistics(reads: DataFrame, **options) -> DataFrame:
    """One row: number of overlapping pairs, mean and sample variance of the overlap."""
    return pairs(reads, **options).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.var_samp("overlap"), 6).alias("var_overlap"))


def clip_counts(reads: DataFrame, *, by_name: bool = False, excluded: int = mates.OVERLAP_EXCLUDED) -> DataFrame:
    """One row: pairs whose orientation costs more than the overlap, pairs of which the forward or the reverse read is clipped,
    and reads that overlap a mate which isn't there.
    """
    rev = lambda i: fl.has(F.col(f"flag{i}"), fl.REVERSE)
    p = pairs(reads, by_name=by_name, excluded=excluded)
    p = p.withColumn("_c", resolve_udf("cigar1", "pos01", "qual1", rev(1), "cigar2", "pos02", "qual2", rev(2)))
    loser = F.when(F.col("_c.loser") == 1, rev(1)).otherwise(rev(2))
    n = lambda x: F.count_if(x).cast("long")
    counts = p.agg(n(rev(1) & ~rev(2)).alias("n_orientation"), n(~loser).alias("n_forward_clipped"), n(loser).alias("n_reverse_clipped"))
    found = p.select(F.explode(F.array("rec_idx1", "rec_idx2")).alias("rec_idx"))
    expected = reads.filter(mates.overlap_class(excluded).isin("OVERLAP", "SAME_START"))
    missing = expected.join(found, "rec_idx", "left_anti").agg(F.count(F.lit(1)).alias("n_missing_mates"))
    return counts.withColumn("_one", F.lit(1)).join(missing.withColumn("_one", F.lit(1)), "_one").drop("_one")
