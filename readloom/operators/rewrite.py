"""Row-wise changes of records; each is one narrow projection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import flags as fl
from ..functions import surgery as sg
from ..functions import tags as tg

REVERSE = lambda: fl.has(F.col("flag"), fl.REVERSE)
#: Reference bases of a chunk, at least.
CHUNK = 1024


def with_reference(reads: DataFrame, ref: DataFrame, into: str = "_ref") -> DataFrame:
    """``reads`` with the reference bases that each one spans, null where it lies on no sequence of ``ref`` (ref_id, bases).

    Sequences are cut into chunks that are as long as the longest span (found by a pass over the reads) and overlap by it, so
    a read meets one chunk by (ref_id, chunk) and no row carries a whole sequence.
    """
    span = cg.ref_span(F.col("cigar"))
    reach = reads.agg(F.max(span)).first()[0] or 1
    length = max(CHUNK, 1 << (reach - 1).bit_length())
    pieces = ref.select("ref_id", F.regexp_extract_all(F.col("bases"), F.lit(f"(?s).{{1,{length}}}"), F.lit(0)).alias("_p"))
    longer = F.transform("_p", lambda c, i: F.concat(c, F.coalesce(F.substring(F.get("_p", i + 1), 1, reach), F.lit(""))))
    chunks = pieces.select("ref_id", F.posexplode(longer).alias("_chunk", into))
    at = (F.col("pos0") - F.col("_chunk") * length + 1).cast("int")
    met = reads.withColumn("_chunk", F.floor(F.col("pos0") / length).cast("int")).join(chunks, ["ref_id", "_chunk"], "left")
    return met.withColumn(into, F.substring(F.col(into), at, span)).select(*reads.columns, into)


def swap_bases(reads: DataFrame, ref: DataFrame, *, equals: bool) -> DataFrame:
    """Bases equal to the reference's become '=' (``equals``), or '=' becomes them; reads off the reference stay."""
    change = (bs.use_equals if equals else bs.use_bases)(F.col("seq"), F.col("_ref"), cg.ref_offsets(F.col("cigar")))
    fits = F.col("_ref").isNotNull() & (F.col("seq") != "*") & (F.col("cigar") != "*")
    return with_reference(reads, ref).withColumn("seq", F.when(fits, change).otherwise(F.col("seq"))).select(*reads.columns)


def trim(reads: DataFrame, left: int, right: int, *, ignore_strand: bool = False) -> DataFrame:
    """Ends become N with the least quality; in reverse reads the sides change places."""
    l, r = F.lit(left), F.lit(right)
    if not ignore_strand:
        l, r = F.when(REVERSE(), right).otherwise(left), F.when(REVERSE(), left).otherwise(right)
    return reads.withColumns({"seq": bs.trim(F.col("seq"), l, r, "N"), "qual": bs.trim(F.col("qual"), l, r, "!")})


def clip(reads: DataFrame, left: int, right: int, *, ignore_strand: bool = False) -> DataFrame:
    """Soft-clip ends (clips that are there count); a read that is clipped whole becomes unmapped, with cigar '*'."""
    l, r = F.lit(left), F.lit(right)
    if not ignore_strand:
        l, r = F.when(REVERSE(), right).otherwise(left), F.when(REVERSE(), left).otherwise(right)
    n = F.length("seq")
    whole = (n <= l + r) & (F.col("seq") != "*")
    done = cg.soft_clip_udf(F.col("cigar"), F.col("pos0"), l.cast("int"), r.cast("int"))
    fits = ~whole & ~fl.has(F.col("flag"), fl.UNMAPPED) & (F.col("cigar") != "*")
    return reads.withColumns({
        "cigar": F.when(whole, "*").when(fits, done["cigar"]).otherwise(F.col("cigar")),
        "pos0": F.when(fits, done["pos0"]).otherwise(F.col("pos0")),
        "flag": F.when(whole, fl.with_bits(F.col("flag"), fl.UNMAPPED)).otherwise(F.col("flag")),
    })


def left_shift(reads: DataFrame) -> DataFrame:
    return reads.withColumn("cigar", cg.left_shift_udf(F.col("cigar"), F.col("seq")))


def revert(reads: DataFrame, *, cigar: bool = True, qual: bool = True, keep_tags: bool = False, remove: list[str] = (), remove_bq: bool = False) -> DataFrame:
    """Cigar, position and qualities from the tags that kept the original ones (OC, OP, OQ)."""
    out, used = {}, []
    if cigar:
        out["cigar"] = F.coalesce(tg.value(F.col("tags"), "OC"), F.col("cigar"))
        out["pos0"] = F.coalesce(tg.integer(F.col("tags"), "OP") - 1, F.col("pos0"))
        used += ["OC", "OP"]
    if qual:
        out["qual"] = F.coalesce(tg.value(F.col("tags"), "OQ"), F.col("qual"))
        used += ["OQ"]
    gone = ([] if keep_tags else used) + list(remove) + (["BQ"] if remove_bq else [])
    out["tags"] = tg.remove(F.col("tags"), gone)
    return reads.withColumns(out)


def squeeze(reads: DataFrame, *, bounds: list[int] = (), how: str = "low", custom: dict[int, int] | None = None, keep_dups: bool = False, keep_oq: bool = False, remove: list[str] = ()) -> DataFrame:
    """Fewer bytes for a record: no duplicates, binned qualities, fewer tags."""
    own = reads if keep_dups else reads.filter(~fl.has(F.col("flag"), fl.DUPLICATE))
    if bounds or custom:
        own = own.withColumn("qual", bs.bin_quality(F.col("qual"), bounds, how, custom))
    if "tags" in reads.columns:
        own = own.withColumn("tags", tg.remove(F.col("tags"), list(remove) + ([] if keep_oq else ["OQ"])))
    return own


def unmap(reads: DataFrame, condition) -> DataFrame:
    """Unmapped with cigar '*' where the condition holds; the position stays."""
    return reads.withColumns({"cigar": F.when(condition, "*").otherwise(F.col("cigar")), "flag": F.when(condition, fl.with_bits(F.col("flag"), fl.UNMAPPED)).otherwise(F.col("flag"))})


def mismatch_ends(reads: DataFrame, ref: DataFrame, *, threshold: float = 0.1, default_quality: int = 20) -> DataFrame:
    """``reads`` with _j: the query bases to clip at the front and the back for their mismatches, and the mismatches' summed quality in between.

    ``ref``: ref_id, bases (the whole sequence); only the stretch that a read covers goes to the Arrow function.
    """
    @F.pandas_udf("front int, back int, loss int")
    def judge(c: pd.Series, s: pd.Series, r: pd.Series, q: pd.Series) -> pd.DataFrame:
        rows = []
        for ci, si, ri, qi in zip(c, s, r, q, strict=True):
            if not ri or ci == "*" or si == "*":
                rows.append((0, 0, 0))
                continue
            front, back = sg.mismatch_clip(ci, si, ri, threshold)
            loss, at, on = 0, 0, 0
            for n, o in sg.parse(ci):
                if o in sg.MATCH_OPS:
                    for i in range(n):
                        if front <= at + i < len(si) - back and on + i < len(ri) and si[at + i].upper() != ri[on + i].upper():
                            loss += default_quality if qi == "*" else ord(qi[at + i]) - 33
                at += n if o in sg.QUERY_OPS else 0
                on += n if o in sg.REF_OPS else 0
            rows.append((front, back, loss))
        return pd.DataFrame(rows, columns=["front", "back", "loss"], dtype="int32")

    return with_reference(reads, ref).withColumn("_j", judge("cigar", "seq", F.coalesce("_ref", F.lit("")), "qual")).drop("_ref")


def filter_mismatches(reads: DataFrame, ref: DataFrame, *, threshold: float = 0.1, quality_threshold: int = 60, default_quality: int = 20) -> DataFrame:
    """Clip ends with too many mismatches, then unmap what is clipped whole or mismatches with too much quality."""
    r = mismatch_ends(reads, ref, threshold=threshold, default_quality=default_quality)
    whole = F.col("_j.front") + F.col("_j.back") >= F.length("seq")
    clipped = cg.soft_clip_udf(F.col("cigar"), F.col("pos0"), F.col("_j.front"), F.col("_j.back"))
    touched = ~whole & (F.col("_j.front") + F.col("_j.back") > 0)
    r = r.withColumn("_c", F.when(touched, clipped))
    r = r.withColumns({"cigar": F.coalesce(F.col("_c.cigar"), F.col("cigar")), "pos0": F.coalesce(F.col("_c.pos0"), F.col("pos0"))})
    return unmap(r, whole | (F.col("_j.loss") > quality_threshold)).select(*reads.columns)


def with_read_group(reads: DataFrame, rg: str) -> DataFrame:
    """Set the RG tag; names that begin with seqcore_ begin with UM then."""
    return reads.withColumns({"tags": tg.put(F.col("tags"), "RG", "Z", F.lit(rg)), "read_name": F.regexp_replace("read_name", "^seqcore_", "UM")})


def store_original(reads: DataFrame, tag: str, column: str = "cigar") -> DataFrame:
    """Keep a column's value in a tag."""
    return reads.withColumn("tags", tg.put(F.col("tags"), tag, "Z", F.col(column).cast("string")))


def quality_from_tag(reads: DataFrame, tag: str) -> DataFrame:
    """Qualities from a tag where its length fits; ``fell_back`` tells where it didn't."""
    v = tg.value(F.col("tags"), tag)
    fits = F.coalesce(F.length(v) == F.length("seq"), F.lit(False))
    return reads.withColumn("fell_back", ~fits).withColumn("qual", F.when(fits, v).otherwise(F.col("qual")))
