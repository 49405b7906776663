"""One function for each tool of the command-line suite that users know, over DataFrames or paths.

Options keep their names. Functions take and return DataFrames of records (see ``sources.sam``); those that write take a
path. Record order is by rec_idx; sort by it where order matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cigar as cg
from .functions import flags as fl
from .functions import tags as tg
from .operators import dedup as dd
from .operators import diff as df_
from .operators import intervals, mates, ordering, overlap, pileup, recab as rc, rewrite, split, stats as st, validate as vd
from .operators import merge as mg
from .sources import lists, sam


def convert(reads: DataFrame, *, lshift: bool = False, recover: bool = False, useBases: bool = False, useEquals: bool = False, useOrigSeq: bool = False, refFile: DataFrame | None = None) -> DataFrame:
    """Records as they are, with indels shifted left, or bases and '=' swapped against the reference (ref_id, bases).

    A line that couldn't be read as a record is an error, or is left out with ``recover`` (of BAM files, ``bam.read`` takes
    recover itself). useOrigSeq keeps bases as they are, which is the default.
    """
    if useBases + useEquals + useOrigSeq > 1:
        raise ValueError("useBases, useEquals and useOrigSeq exclude each other")
    out = sam.usable(reads, recover)
    out = rewrite.left_shift(out) if lshift else out
    if useBases or useEquals:
        if refFile is None:
            raise ValueError("a reference is needed")
        out = rewrite.swap_bases(out, refFile, equals=useEquals)
    return out


def writeRegion(reads: DataFrame, *, refName: str | None = None, refID: int | None = None, start: int = -1, end: int = -1, bed: DataFrame | None = None, withinReg: bool = False, readName: str | None = None, rnFile: DataFrame | None = None, lshift: bool = False, excludeFlags: int = 0, requiredFlags: int = 0) -> DataFrame:
    """Records of a reference, a range of it or regions, by name and flags. refID -1 is the unmapped ones."""
    if sum(x is not None for x in (refName, refID, bed)) > 1:
        raise ValueError("refName, refID and bed exclude each other")
    out = reads.filter(fl.passes(F.col("flag"), requiredFlags, excludeFlags))
    last = cg.align_end(F.col("pos0"), F.col("cigar"))
    if refName is not None:
        out = out.filter(F.col("ref_name") == refName)
    if refID is not None:
        out = out.filter(F.col("ref_id") == refID)
    if start >= 0:
        out = out.filter((F.col("pos0") >= start) if withinReg else (last >= start))
    if end >= 0:
        out = out.filter((last < end) if withinReg else (F.col("pos0") < end))
    if bed is not None:
        out = intervals.semi_join(out.withColumn("_last", last), bed, last="_last", contained=withinReg).drop("_last")
    if readName is not None:
        out = out.filter(F.col("read_name") == readName)
    if rnFile is not None:
        out = out.join(rnFile.select("read_name"), "read_name", "left_semi").select(*reads.columns)
    return rewrite.left_shift(out) if lshift else out


def splitChromosome(reads: DataFrame, refs: DataFrame, out: str) -> None:
    split.write_by(split.by_reference(reads, refs), out, "ref_name")


def splitBam(reads: DataFrame, head: DataFrame, out: str) -> None:
    """A folder for each read group, and the header lines of each: header.<group>."""
    groups = sam.read_groups(head)
    own = reads.withColumn("rg", tg.value(F.col("tags"), "RG"))
    split.write_by(split.check_groups(own, groups), out, "rg")
    # A header has few read groups; each line that belongs to none goes to all of them.
    ids = [r.id for r in groups.select("id").collect()]
    lines = head.filter("type not in ('RG', 'PG')").select(F.explode(F.array(*[F.lit(i) for i in ids]).cast("array<string>")).alias("rg"), "line_no", "raw")
    own_lines = head.filter(F.col("type").isin("RG", "PG") & F.col("id").isin(*ids)).select(F.col("id").alias("rg"), "line_no", "raw")
    lines.unionByName(own_lines).write.mode("overwrite").partitionBy("rg").parquet(out.rstrip("/") + "_headers")


def findCigars(reads: DataFrame, *, cinsert: bool = False, cdel: bool = False, cpad: bool = False, cskip: bool = False, chardClip: bool = False, csoftClip: bool = False, nonM: bool = False) -> DataFrame:
    wanted = "".join(c for c, on in zip("IDPNHS", (cinsert, cdel, cpad, cskip, chardClip, csoftClip), strict=True) if on or nonM)
    if not wanted:
        raise ValueError("choose at least one cigar operation")
    return reads.filter(cg.contains_any(F.col("cigar"), wanted))


def clipOverlap(reads: DataFrame, *, storeOrig: str | None = None, readName: bool = False, overlapsOnly: bool = False, excludeFlags: int = mates.OVERLAP_EXCLUDED, unmapped: bool = False, stats: bool = False) -> DataFrame:
    if stats:
        one = lambda df: df.withColumn("_one", F.lit(1))
        own = {"by_name": readName, "excluded": excludeFlags}
        return one(overlap.statistics(reads, **own)).join(one(overlap.clip_counts(reads, **own)), "_one").drop("_one")
    out = overlap.clip(reads, by_name=readName, excluded=excludeFlags, unmapped=unmapped, store_original=storeOrig)
    if overlapsOnly:
        both = overlap.pairs(reads, by_name=readName, excluded=excludeFlags).select(F.explode(F.array("rec_idx1", "rec_idx2")).alias("rec_idx"))
        out = out.join(both, "rec_idx", "left_semi")
    return out


def filter(reads: DataFrame, refFile: DataFrame, *, qualityThreshold: int = 60, defaultQualityInt: int = 20, mismatchThreshold: float = 0.1) -> DataFrame:  # noqa: A001
    return rewrite.filter_mismatches(reads, refFile, threshold=mismatchThreshold, quality_threshold=qualityThreshold, default_quality=defaultQualityInt)


def revert(reads: DataFrame, *, cigar: bool = False, qual: bool = False, keepTags: bool = False, rmBQ: bool = False, rmTags: str = "") -> DataFrame:
    return rewrite.revert(reads, cigar=cigar, qual=qual, keep_tags=keepTags, remove=tg.names(rmTags), remove_bq=rmBQ)


def squeeze(reads: DataFrame, *, refFile: DataFrame | None = None, keepOQ: bool = False, keepDups: bool = False, readName: bool = False, sReadName: bool = False, rmTags: str = "", binQualS: list[int] = (), binMid: bool = False, binHigh: bool = False, binCustom: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(records, mapping of old to new names or None). Names are numbered by first appearance, or by change from record to record."""
    how = "mid" if binMid else "high" if binHigh else "low"
    out, mapping = rewrite.squeeze(reads, bounds=list(binQualS), how=how, custom=binCustom, keep_dups=keepDups, keep_oq=keepOQ, remove=tg.names(rmTags)), None
    if readName and sReadName:
        raise ValueError("readName and sReadName exclude each other")
    if readName:
        named = ordering.first_seen_ids(out, "read_name", "rec_idx")
        mapping = named.select("read_name", "new_id").distinct()
        out = named.withColumn("read_name", F.col("new_id").cast("string")).select(*out.columns)
    if sReadName:
        # A name's run starts where the record before has another; runs are numbered by their first record.
        span = 1 << 16
        first = _run_starts(out, span)
        starts = ordering.number_rows(first, F.floor(F.col("rec_idx") / span), ["rec_idx"], "_id").select(F.col("rec_idx").alias("_start"), (F.col("_id") - 1).alias("new_id"))
        named = _in_runs(out, first, span).join(starts, "_start")
        mapping = named.select("read_name", "new_id").distinct()
        out = named.withColumn("read_name", F.col("new_id").cast("string")).select(*out.columns)
    if refFile is not None:
        out = convert(out, useEquals=True, refFile=refFile)
    return out, mapping


def _blocked(reads: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(rec_idx, read_name, _block, _first, _prev name within the block; and each block's last name handed to the next block)."""
    from pyspark.sql import Window

    r = reads.select("rec_idx", "read_name").withColumn("_block", F.floor(F.col("rec_idx") / span))
    w = Window.partitionBy("_block").orderBy("rec_idx")
    r = r.withColumn("_prev", F.lag("read_name").over(w)).withColumn("_n", F.row_number().over(w))
    last = r.groupBy("_block").agg(F.max_by("read_name", "rec_idx").alias("_name"))
    handed = last.withColumn("_before", F.lag("_name").over(Window.orderBy("_block"))).select("_block", "_before")
    return r.join(handed, "_block"), handed


def _run_starts(reads: DataFrame, span: int) -> DataFrame:
    r, _ = _blocked(reads, span)
    prev = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_prev"))
    return r.filter(~prev.eqNullSafe(F.col("read_name"))).select("rec_idx", "read_name")


def _in_runs(reads: DataFrame, starts: DataFrame, span: int) -> DataFrame:
    """Each record with its run's first rec_idx: the last start in its block, or in an earlier one."""
    from pyspark.sql import Window

    s = starts.select(F.col("rec_idx").alias("_s"))
    j = reads.join(s, F.col("rec_idx") == F.col("_s"), "left").withColumn("_block", F.floor(F.col("rec_idx") / span))
    blocks = j.groupBy("_block").agg(F.max("_s").alias("_last"))
    before = blocks.select("_block", F.max("_last").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    w = Window.partitionBy("_block").orderBy("rec_idx").rowsBetween(Window.unboundedPreceding, 0)
    return j.join(before, "_block").withColumn("_start", F.coalesce(F.last("_s", ignorenulls=True).over(w), F.col("_carried"))).drop("_s", "_block", "_carried")


def trimBam(reads: DataFrame, n: int | None = None, *, left: int | None = None, right: int | None = None, ignoreStrand: bool = False, clip: bool = False) -> DataFrame:
    l, r = (left or 0, right or 0) if n is None else (n, n)
    return (rewrite.clip if clip else rewrite.trim)(reads, l, r, ignore_strand=ignoreStrand)


def mergeBam(inputs: list[tuple[DataFrame, DataFrame]], *, regions: list[str] | None = None, refs: DataFrame | None = None, ignorePI: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records in merge order, header) of two or more (records, header). With regions ('chr:1-100'), records come once for each region they touch."""
    if len(inputs) < 2:
        raise ValueError("give two inputs or more")
    out = mg.merge([r for r, _ in inputs])
    if regions:
        spark = out.sparkSession
        parsed = [(i, *lists.region(x)) for i, x in enumerate(regions)]
        reg = spark.createDataFrame(parsed, "region_no int, name string, start0 int, end0_excl int").join(refs, "name").select("region_no", "ref_id", "start0", F.coalesce("end0_excl", "length").alias("end0_excl"))
        ends = mg.union_inputs([r for r, _ in inputs]).withColumn("_last", cg.align_end(F.col("pos0"), F.col("cigar")))
        out = intervals.overlap_join(ends, reg, last="_last").drop("_last", "start0", "end0_excl").orderBy("region_no", *mg.sort_key()).drop("region_no")
    return out, mg.merge_headers([h for _, h in inputs], ignore_pi=ignorePI)


def polishBam(reads: DataFrame, head: DataFrame, *, HD: str | None = None, RG: str | None = None, PG: list[str] = (), CO: list[str] = (), fasta: DataFrame | None = None, checkSQ: bool = False, AS: str | None = None, UR: str | None = None, SP: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, header) with header lines added, SQ lines completed from the sequences, and the read group set everywhere."""
    if checkSQ and fasta is None:
        raise ValueError("checkSQ needs fasta")
    checks = {r.name: (r.length, r.md5) for r in fasta.select("name", "length", "md5").collect()} if checkSQ else None
    head = sam.edit_header(head, [x for x in (HD, RG) if x] + list(PG) + list(CO), checks=checks, extra={k: v for k, v in (("AS", AS), ("UR", UR), ("SP", SP)) if v})
    if RG:
        name = next(x[3:] for x in RG.replace("\\t", "\t").split("\t") if x.startswith("ID:"))
        reads = rewrite.with_read_group(reads, name)
    return reads, head


def dedup(reads: DataFrame, *, minQual: int = dd.MIN_QUALITY, oneChrom: bool = False, rmDups: bool = False, force: bool = False, excludeFlags: int = dd.EXCLUDED, library: str | None = None, recab: dict | None = None) -> DataFrame:
    """Mark duplicates; with ``recab`` (the options of recab) qualities are recalibrated from the marked records."""
    out = dd.mark(reads, min_quality=minQual, one_chrom=oneChrom, remove=rmDups, force=force, excluded=excludeFlags, library=library)
    return recalibrate(out, **recab) if recab is not None else out


def dedup_LowMem(reads: DataFrame, *, minQual: int = dd.MIN_QUALITY, oneChrom: bool = False, rmDups: bool = False, force: bool = False, excludeFlags: int = dd.EXCLUDED, library: str | None = None, recab: dict | None = None) -> DataFrame:
    """Duplicates as in ``dedup``; with ``recab`` only the first read of each fragment key, marked later or not, builds the table."""
    options = {"min_quality": minQual, "one_chrom": oneChrom, "force": force, "excluded": excludeFlags, "library": library}
    out = dd.mark(reads, remove=rmDups, **options)
    if recab is None:
        return out
    first = dd.keyed(reads, **options).groupBy("key").agg(F.min("rec_idx").alias("rec_idx")).select("rec_idx")
    build = reads.withColumn("flag", fl.without_bits(F.col("flag"), fl.DUPLICATE)).join(first, "rec_idx", "left_semi")
    return recalibrate(out, build=build, **recab)


def recalibrate(reads: DataFrame, refFile: DataFrame, *, build: DataFrame | None = None, blended: int = 0, dbsnp: DataFrame | None = None, minBaseQual: int = rc.MIN_QUALITY, maxBaseQual: int = rc.MAX_QUALITY, fitModel: bool = False, useLogReg: bool = False, keepPrevDbsnp: bool = False, keepPrevNonAdjacent: bool = False, qualField: str | None = None, storeQualTag: str | None = None, buildExcludeFlags: int = rc.EXCLUDED, applyExcludeFlags: int = 0) -> DataFrame:
    """Records with recalibrated qualities; refFile: ref_id, pos, base. ``rg`` is taken from the RG tag where it isn't a column.

    ``build``: the records that build the table, where not all do. With useLogReg the regression's qualities are taken,
    ``blended`` or plain; fitModel alone doesn't change the qualities (``recab.logistic_fit`` gives the model).
    """

    def prepared(r: DataFrame) -> DataFrame:
        r = rewrite.quality_from_tag(r, qualField).drop("fell_back") if qualField else r
        return r if "rg" in r.columns else r.withColumn("rg", F.coalesce(tg.value(F.col("tags"), "RG"), F.lit("")))

    own = prepared(reads)
    cells = rc.covariates(own if build is None else prepared(build), refFile, sites=dbsnp, min_quality=minBaseQual, excluded=buildExcludeFlags, keep_prev_site=keepPrevDbsnp, keep_prev_gap=keepPrevNonAdjacent)
    quality = "q_emp"
    if useLogReg:
        cells, quality = cells.withColumn("q_model", rc.predicted_quality(rc.logistic_fit(cells)["weights"], blended)), "q_model"
    if storeQualTag:
        own = rewrite.store_original(own, storeQualTag, "qual")
    return rc.apply(own, cells, max_quality=maxBaseQual, min_quality=minBaseQual, excluded=applyExcludeFlags, quality=quality).select(*reads.columns)


recab = recalibrate


def validate(reads: DataFrame, *, refs: int | None = None, refFile: DataFrame | None = None, head: DataFrame | None = None, so_flag: bool = False, so_coord: bool = False, so_query: bool = False, maxErrors: int = -1) -> DataFrame:
    """rec_idx, error; with a sort order (so_flag: that of the header ``head``) also SORT_ORDER, with ``refFile`` INVALID_MD."""
    if so_coord + so_query + so_flag > 1:
        raise ValueError("so_flag, so_coord and so_query exclude each other")
    if so_flag:
        if head is None:
            raise ValueError("so_flag needs the header")
        order = head.filter("type = 'HD'").select(F.col("tags")["SO"]).first()
        so_coord, so_query = (bool(order) and order[0] == x for x in ("coordinate", "queryname"))
    found = vd.errors(reads, refs)
    if refFile is not None:
        found = found.unionByName(vd.md_errors(reads, refFile))
    if so_coord or so_query:
        found = found.unionByName(vd.unsorted(sam.usable(reads, True), "coordinate" if so_coord else "name").withColumn("error", F.lit("SORT_ORDER")))
    return found if maxErrors < 0 else found.orderBy("rec_idx", "error").limit(maxErrors)


def diff(in1: DataFrame, in2: DataFrame, *, all: bool = False, flag: bool = False, mapQual: bool = False, mate: bool = False, isize: bool = False, seq: bool = False, baseQual: bool = False, tags: str = "", everyTags: bool = False, noCigar: bool = False, noPos: bool = False, posDiff: int = 100_000) -> DataFrame:  # noqa: A002
    """rec1, rec2, changed (names of fields) of records that differ or are in one input only (changed is then null)."""
    fields = ([] if noPos else ["ref_id", "pos0"]) + ([] if noCigar else ["cigar"])
    chosen = ((flag, ["flag"]), (mapQual, ["mapq"]), (mate, ["mate_ref_id", "mate_pos0"]), (isize, ["insert_size"]), (seq, ["seq"]), (baseQual, ["qual"]))
    fields += [f for on, fs in chosen if on or all for f in fs]
    a, b = in1, in2
    if everyTags or all:
        a, b = (x.withColumn("tag_text", tg.text(F.col("tags"), sort=False)) for x in (a, b))
        fields.append("tag_text")
    for t in tg.names(tags):
        name = f"tag_{t[:2]}"
        a, b = (x.withColumn(name, tg.value(F.col("tags"), t[:2], t[3:] or "Z")) for x in (a, b))
        fields.append(name)
    keep = list(dict.fromkeys(["rec_idx", "read_name", "flag", "ref_id", "pos0", *fields]))
    both = df_.full_outer(a.select(*keep), b.select(*keep), [F.col("read_name"), fl.fragment(F.col("flag"))], "rec_idx", df_.within(posDiff))
    one = F.col("l").isNull() | F.col("r").isNull()
    out = both.select(F.col("l.rec_idx").alias("rec1"), F.col("r.rec_idx").alias("rec2"), F.when(~one, df_.changed_fields(fields)).alias("changed"))
    return out.filter(F.col("changed").isNull() | (F.size("changed") > 0))


def stats(reads: DataFrame, *, basic: bool = False, qual: bool = False, phred: bool = False, pBaseQC: bool = False, cBaseQC: bool = False, baseSum: bool = False, maxNumReads: int = -1, unmapped: bool = False, regionList: DataFrame | None = None, excludeFlags: int = 0, requiredFlags: int = 0, withinRegion: bool = False, minMapQual: int = 0, dbsnp: DataFrame | None = None) -> dict[str, DataFrame]:
    """The chosen tables by name. With regions a read counts once for each one that it touches, in basic and histograms."""
    own = reads.filter(fl.passes(F.col("flag"), requiredFlags, excludeFlags))
    if unmapped:
        own = own.filter(F.col("ref_id") < 0)
    if maxNumReads >= 0:
        own = own.orderBy("rec_idx").limit(maxNumReads)
    counted = own
    if regionList is not None:
        counted = intervals.overlap_join(own.withColumn("_last", cg.align_end(F.col("pos0"), F.col("cigar"))), regionList, last="_last", contained=withinRegion).select(*reads.columns)
    out = {}
    if basic:
        out["basic"] = st.basic(counted)
    if qual:
        out["qual"] = st.quality_histogram(counted)
    if phred:
        out["phred"] = st.quality_histogram(counted, phred=True)
    if pBaseQC or cBaseQC or baseSum:
        pile = pileup.qc(own, min_mapq=minMapQual, regions=regionList, sites=dbsnp)
        if pBaseQC:
            out["pBaseQC"] = pileup.percents(pile)
        if cBaseQC:
            out["cBaseQC"] = pile
        if baseSum:
            out["baseSum"] = pileup.summary(pile)
    return out


def gapInfo(reads: DataFrame, *, detailed: bool = False, checkFirst: bool = False, checkStrand: bool = False) -> DataFrame:
    """The histogram of gaps between mates, or each of them; checkFirst and checkStrand keep what those columns mark out."""
    if not detailed:
        return st.gap_histogram(reads)
    out = st.gap_details(reads)
    if checkFirst:
        out = out.filter("not not_first")
    return out.filter("not reverse") if checkStrand else out


def bam2FastQ(reads: DataFrame, *, readName: bool = False, splitRG: bool = False, qualField: str | None = None, firstRNExt: str = "/1", secondRNExt: str = "/2", rnPlus: bool = False, noReverseComp: bool = False, region: str | None = None, outBase: str | None = None, gzip: bool = False) -> DataFrame:
    """FASTQ entries; with outBase also written, split by role (and read group). region 'chr:pos:base' (pos from 0) keeps reads with that base."""
    own = rewrite.quality_from_tag(reads, qualField).drop("fell_back") if qualField else reads
    if region:
        name, pos, base = (region.split(":") + [None, None])[:3]
        own = own.filter(F.col("ref_name") == name)
        if pos is not None:
            own = own.filter((F.col("pos0") <= int(pos)) & (cg.align_end(F.col("pos0"), F.col("cigar")) >= int(pos)))
        if base is not None:
            own = own.filter(F.upper(cg.base_at(F.col("cigar"), F.col("seq"), F.col("pos0"), int(pos))) == base.upper())
    if splitRG and "rg" not in own.columns:
        own = own.withColumn("rg", tg.value(F.col("tags"), "RG"))
    out = split.fastq(own, by_name=readName, first_ext=firstRNExt, second_ext=secondRNExt, rn_plus=rnPlus, reverse_comp=not noReverseComp)
    if outBase:
        keys = (["rg"] if splitRG else []) + ["role"]
        ordered = out.repartitionByRange(*keys, "rec_idx").sortWithinPartitions(*keys, "rec_idx")
        ordered.select(*keys, F.col("fastq").alias("value")).write.mode("overwrite").partitionBy(*keys).option("compression", "gzip" if gzip else "none").text(outBase)
    return out


def dumpHeader(spark: SparkSession, path: str) -> DataFrame:
    return sam.header(spark, path).select("line_no", "raw")


def dumpRefInfo(head: DataFrame, reads: DataFrame | None = None, *, printRecordRefs: bool = False) -> DataFrame:
    """The reference dictionary, or the references of the records with their counts."""
    return st.counts_by(reads, "ref_id") if printRecordRefs else sam.references(head)


def dumpIndex(spark: SparkSession, bamIndex: str, *, refID: int = -1) -> DataFrame:
    out = lists.bai(spark, bamIndex)
    return out if refID < 0 else out.filter(F.col("ref_id") == refID)


readReference = lists.read_reference


def explainFlags(flag: str) -> list[str]:
    """The labels of a flag in hex (0x...) or decimal."""
    n = fl.parse(flag)
    early = [label for b, label in fl.LABELS if n & b]
    place = {fl.FIRST: "first fragment", fl.LAST: "last fragment", fl.FIRST | fl.LAST: "middle fragment"}.get(n & (fl.FIRST | fl.LAST), "unknown fragment")
    return early + ([place] if n & fl.PAIRED else []) + [label for b, label in fl.LATE_LABELS if n & b]


def readIndexedBam(reads: DataFrame) -> DataFrame:
    """Records by reference, those without one first."""
    return reads.orderBy("ref_id", "pos0", "rec_idx")
