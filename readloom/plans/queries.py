"""The operators over the tables, and the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import flags as fl
from ..functions import tags as tg
from ..operators import dedup, diff, intervals, mates, merge, ordering, overlap, pileup, recab, rewrite, split, stats, validate
from ..sources import sam
from ..streaming import batch as events_batch
from .reads import SQL_BASE, reads, ref_base, regions, sites, sql, table, with_ends

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


REV = "(flag & 16) <> 0"


@query(sql("SELECT rec_idx, read_name, flag FROM r WHERE (flag & 1) = 1 AND (flag & 1028) = 0"))
def flag_mask_filter(spark, d):
    return reads(spark, d).filter(fl.passes(F.col("flag"), fl.PAIRED, fl.UNMAPPED | fl.DUPLICATE)).select("rec_idx", "read_name", "flag")


@query(sql("""SELECT rec_idx, flag, concat_ws(',', CASE WHEN flag & 1 > 0 THEN 'paired' END, CASE WHEN flag & 2 > 0 THEN 'properly paired' END, CASE WHEN flag & 4 > 0 THEN 'unmapped' END,
 CASE WHEN flag & 8 > 0 THEN 'mate unmapped' END, CASE WHEN flag & 16 > 0 THEN 'reverse strand' END, CASE WHEN flag & 32 > 0 THEN 'mate reverse strand' END,
 CASE WHEN flag & 1 > 0 THEN CASE flag & 192 WHEN 64 THEN 'first fragment' WHEN 128 THEN 'last fragment' WHEN 192 THEN 'middle fragment' ELSE 'unknown fragment' END END,
 CASE WHEN flag & 256 > 0 THEN 'secondary' END, CASE WHEN flag & 512 > 0 THEN 'QC fail' END, CASE WHEN flag & 1024 > 0 THEN 'duplicate' END, CASE WHEN flag & 2048 > 0 THEN 'supplementary' END) AS labels FROM r"""))
def explain_flags(spark, d):
    return reads(spark, d).select("rec_idx", "flag", F.array_join(fl.explain(F.col("flag")), ",").alias("labels"))


@query(sql("""SELECT *, round(100.0 * mapped_reads / total_reads, 2) AS mapping_rate, round(100.0 * proper_pairs / total_reads, 2) AS proper_rate, round(100.0 * duplicate_reads / total_reads, 2) AS duplicate_rate, round(100.0 * qc_fail_reads / total_reads, 2) AS qc_fail_rate FROM (
SELECT count(*) AS total_reads, count(*) FILTER (WHERE flag & 4 = 0) AS mapped_reads, count(*) FILTER (WHERE flag & 1 > 0) AS paired_reads, count(*) FILTER (WHERE flag & 3 = 3) AS proper_pairs,
 count(*) FILTER (WHERE flag & 1024 > 0) AS duplicate_reads, count(*) FILTER (WHERE flag & 512 > 0) AS qc_fail_reads, CAST(sum(length(seq)) AS BIGINT) AS total_bases, CAST(sum(CASE WHEN flag & 4 = 0 THEN length(seq) END) AS BIGINT) AS bases_in_mapped FROM r)"""))
def basic_stats(spark, d):
    return stats.basic(reads(spark, d))


@query(sql("SELECT count(*) AS n_reads, " + ", ".join(f"count(*) FILTER (WHERE flag & {b} > 0) AS n_{n}" for n, b in (("paired", 1), ("proper", 2), ("reverse", 16), ("qc_fail", 512), ("secondary", 256), ("supplementary", 2048), ("unmapped", 4), ("mate_unmapped", 8))) + " FROM r"))
def read_class_counts(spark, d):
    return stats.read_classes(reads(spark, d))


HISTOGRAM = "c AS (SELECT CAST(ascii(ch) AS INTEGER) AS code, count(*) AS n FROM (SELECT unnest(string_split(qual, '')) AS ch FROM r WHERE {where}) GROUP BY ALL)"


@query(sql("SELECT CAST(e.code AS INTEGER) AS code, CAST(coalesce(c.n, 0) AS BIGINT) AS n_bases FROM (SELECT unnest(range(33, 127)) AS code) e LEFT JOIN c ON e.code = c.code", HISTOGRAM.format(where="true")))
def qual_histogram(spark, d):
    return stats.quality_histogram(reads(spark, d))


@query(sql("SELECT CAST(e.code - 33 AS INTEGER) AS phred, CAST(coalesce(c.n, 0) AS BIGINT) AS n_bases FROM (SELECT unnest(range(33, 127)) AS code) e LEFT JOIN c ON e.code = c.code", HISTOGRAM.format(where="flag & 1536 = 0")))
def phred_histogram(spark, d):
    return stats.quality_histogram(reads(spark, d), phred=True, excluded=fl.QC_FAIL | fl.DUPLICATE)


SUMQ = "CAST(coalesce(list_sum(list_filter(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33), lambda q: q >= 15)), 0) AS INTEGER)"


@query(sql(f"SELECT rec_idx, {SUMQ} AS sumq FROM r"))
def phred_sum_min15(spark, d):
    return reads(spark, d).select("rec_idx", bs.quality_sum(F.col("qual"), 15).alias("sumq"))


def _bins(low, mid, high, custom):
    one = lambda e: f"array_to_string(list_transform(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33), lambda q: chr(CAST({e} + 33 AS INTEGER))), '')"
    return ", ".join(f"{one(e)} AS {n}" for e, n in ((low, "qual_low"), (mid, "qual_mid"), (high, "qual_high"), (custom, "qual_custom")))


@query(sql("SELECT rec_idx, " + _bins("CASE WHEN q < 10 THEN 0 WHEN q < 20 THEN 10 ELSE 20 END", "CASE WHEN q < 10 THEN 4 WHEN q < 20 THEN 14 ELSE 56 END", "CASE WHEN q < 10 THEN 9 WHEN q < 20 THEN 19 ELSE 93 END", "CASE WHEN q < 5 THEN q WHEN q < 25 THEN 12 ELSE 37 END") + " FROM r"))
def bin_qualities(spark, d):
    q = F.col("qual")
    return reads(spark, d).select("rec_idx", bs.bin_quality(q, [10, 20]).alias("qual_low"), bs.bin_quality(q, [10, 20], "mid").alias("qual_mid"), bs.bin_quality(q, [10, 20], "high").alias("qual_high"), bs.bin_quality(q, custom={5: 12, 25: 37}).alias("qual_custom"))


@query(sql(f"SELECT rec_idx, CASE WHEN {REV} THEN concat('NN', substr(seq, 3, 15), 'NNN') ELSE concat('NNN', substr(seq, 4, 15), 'NN') END AS seq, CASE WHEN {REV} THEN concat('!!', substr(qual, 3, 15), '!!!') ELSE concat('!!!', substr(qual, 4, 15), '!!') END AS qual FROM r"))
def trim_ends(spark, d):
    return rewrite.trim(reads(spark, d), 3, 2).select("rec_idx", "seq", "qual")


@query(sql("SELECT rec_idx, reverse(translate(upper(seq), 'ACGT', 'TGCA')) AS seq, reverse(qual) AS qual FROM r WHERE (flag & 16) <> 0"))
def reverse_complement(spark, d):
    return reads(spark, d).filter(fl.has(F.col("flag"), fl.REVERSE)).select("rec_idx", bs.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"))


DROPPED = "m AS (SELECT * FROM r WHERE (rec_idx - 1) % 86 <> 1)"


def dropped(spark, d):
    """The reads without some second mates."""
    return reads(spark, d).filter((F.col("rec_idx") - 1) % 86 != 1)


FASTQ = f"""f AS (SELECT m.rec_idx, m.rg, CASE WHEN o.rec_idx IS NULL THEN 'single' WHEN m.flag & 64 > 0 THEN 'first' ELSE 'second' END AS role, m.read_name, m.seq, m.qual, m.flag
  FROM m LEFT JOIN m o ON m.read_name = o.read_name AND m.rec_idx <> o.rec_idx)"""


@query(sql(f"""SELECT rec_idx, rg, role, concat('@', read_name, CASE role WHEN 'first' THEN '/1' WHEN 'second' THEN '/2' ELSE '' END, chr(10), CASE WHEN {REV} THEN reverse(translate(upper(seq), 'ACGT', 'TGCA')) ELSE upper(seq) END, chr(10), '+', chr(10), CASE WHEN {REV} THEN reverse(qual) ELSE qual END) AS fastq FROM f""", DROPPED, FASTQ))
def fastq_records(spark, d):
    return split.fastq(dropped(spark, d))


@query(sql("""SELECT 'base' AS merge_name, concat('base.', rg, '_1.fastq') AS fastq1, concat('base.', rg, '_2.fastq') AS fastq2, rg FROM f WHERE role = 'first' GROUP BY rg
UNION ALL SELECT 'base', concat('base.', rg, '.fastq'), '.', rg FROM f WHERE role = 'single' GROUP BY rg""", DROPPED, FASTQ))
def fastq_manifest(spark, d):
    return split.fastq_manifest(split.fastq(dropped(spark, d)), "base")


@query(sql("SELECT rec_idx, cigar FROM r WHERE regexp_matches(cigar, '[ID]')"))
def cigar_op_filter(spark, d):
    return reads(spark, d).filter(cg.contains_any(F.col("cigar"), "ID")).select("rec_idx", "cigar")


@query(sql("SELECT rec_idx, CAST(end0 - pos0 + 1 AS INTEGER) AS ref_span, 20 AS query_length, end0, CAST(pos0 - lead AS INTEGER) AS unclipped_start0, end0 AS unclipped_end0 FROM r"))
def cigar_ref_span(spark, d):
    c, p = F.col("cigar"), F.col("pos0")
    return reads(spark, d).select("rec_idx", cg.ref_span(c).alias("ref_span"), cg.query_length(c).alias("query_length"), cg.align_end(p, c).alias("end0"), cg.unclipped_start(p, c).alias("unclipped_start0"), cg.unclipped_end(p, c).alias("unclipped_end0"))


GAPS = "g AS (SELECT *, CAST(mate_pos0 - end0 - 1 AS INTEGER) AS gap FROM r WHERE flag & 1 > 0 AND flag & 1804 = 0 AND (mate_pos0 > pos0 OR (mate_pos0 = pos0 AND flag & 16 = 0)))"


@query(sql("SELECT gap, count(*) AS n_reads FROM g WHERE flag & 16 = 0 GROUP BY gap", GAPS))
def gap_histogram(spark, d):
    return stats.gap_histogram(reads(spark, d))


@query(sql("SELECT rec_idx, ref_id, CAST(end0 + 1 AS INTEGER) AS gap_start0, gap, flag & 64 = 0 AS not_first, flag & 16 > 0 AS reverse FROM g", GAPS))
def gap_details(spark, d):
    return stats.gap_details(reads(spark, d))


@query(sql("SELECT a.read_name AS read_name, a.rec_idx AS rec_idx1, b.rec_idx AS rec_idx2, a.pos0 AS pos1, b.pos0 AS pos2 FROM r a JOIN r b ON a.read_name = b.read_name AND a.rec_idx < b.rec_idx AND a.pos0 = b.mate_pos0 AND a.mate_pos0 = b.pos0"))
def mate_join(spark, d):
    return mates.by_coordinate(reads(spark, d), []).select(F.col("read_name1").alias("read_name"), "rec_idx1", "rec_idx2", F.col("pos01").alias("pos1"), F.col("pos02").alias("pos2"))


@query(sql("SELECT a.read_name AS read_name, a.rec_idx AS rec_idx1, b.rec_idx AS rec_idx2 FROM r a JOIN r b ON a.read_name = b.read_name AND a.rec_idx < b.rec_idx"))
def mate_join_adjacent(spark, d):
    return mates.by_adjacency(reads(spark, d), []).select(F.col("read_name1").alias("read_name"), "rec_idx1", "rec_idx2")


@query(sql("SELECT rec_idx, read_name FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.read_name = m.read_name AND o.rec_idx <> m.rec_idx)", DROPPED))
def missing_mates(spark, d):
    return mates.missing(dropped(spark, d)).select("rec_idx", "read_name")


@query(sql("""SELECT CASE WHEN flag & 1 = 0 OR flag & 3852 > 0 THEN 'NO_OVERLAP' WHEN pos0 < mate_pos0 AND end0 < mate_pos0 THEN CASE WHEN flag & 16 > 0 AND flag & 32 = 0 THEN 'NO_OVERLAP_WRONG_ORIENT' ELSE 'NO_OVERLAP' END
 WHEN pos0 < mate_pos0 THEN 'OVERLAP' WHEN pos0 = mate_pos0 THEN 'SAME_START' WHEN flag & 16 = 0 AND flag & 32 > 0 THEN 'UNKNOWN_OVERLAP_WRONG_ORIENT' ELSE 'UNKNOWN_OVERLAP' END AS overlap_class, count(*) AS n_reads FROM r GROUP BY 1"""))
def overlap_class(spark, d):
    return reads(spark, d).groupBy(mates.overlap_class().alias("overlap_class")).agg(F.count(F.lit(1)).alias("n_reads"))


@query(sql("""SELECT count(*) AS n_pairs, round(avg(o), 6) AS mean_overlap, round(var_samp(o), 6) AS var_overlap FROM (SELECT least(a.end0, b.end0) - greatest(a.pos0, b.pos0) + 1 AS o FROM r a JOIN r b ON a.read_name = b.read_name AND a.rec_idx < b.rec_idx
 WHERE a.flag & 3852 = 0 AND b.flag & 3852 = 0) WHERE o > 0"""))
def overlap_stats(spark, d):
    return overlap.statistics(reads(spark, d))


# How pairs whose starts are 12 apart are cut, by cigar: bases before the second start in the first read, bases of the second up
# to the first's end; the first cut at its tail, the second at its head (and how far that moves it); then, for reads that point
# the wrong way, the second's tail and the first's head cut.
CUTS = """cuts(cigar, tail, head, tail1, head2, moved, tail2, head1) AS (VALUES ('20M', 12, 8, '12M8S', '8S12M', 8, '8M12S', '12S8M'), ('3S17M', 15, 8, '3S12M5S', '8S12M', 5, '3S5M12S', '15S5M'),
 ('10M2D10M', 10, 10, '10M10S', '10S10M', 12, '10M10S', '10S10M'), ('8M1I11M', 13, 7, '8M1I4M7S', '7S1M1I11M', 7, '7M13S', '13S7M'))"""
MEAN = "list_sum(list_transform(string_split({part}, ''), lambda c: ascii(c))) / {n}"
OVERLAPS = f"""el AS (SELECT *, flag & 16 > 0 AS rev FROM r WHERE flag & 3852 = 0),
p0 AS (SELECT a.rec_idx AS i1, b.rec_idx AS i2, a.pos0 AS p1, b.pos0 AS p2, a.qual AS q1, b.qual AS q2, CASE WHEN a.pos0 = b.pos0 THEN 'same' WHEN a.rev AND NOT b.rev THEN 'wrong' ELSE 'right' END AS kind, c.*
  FROM el a JOIN el b ON a.read_name = b.read_name AND a.rec_idx <> b.rec_idx AND (a.pos0 < b.pos0 OR (a.pos0 = b.pos0 AND a.rec_idx < b.rec_idx)) AND b.pos0 <= a.end0 JOIN cuts c ON a.cigar = c.cigar),
p1 AS (SELECT *, CASE WHEN kind = 'same' THEN {MEAN.format(part='q1', n=20)} <= {MEAN.format(part='q2', n=20)} ELSE {MEAN.format(part='substr(q1, tail + 1)', n='(20 - tail)')} <= {MEAN.format(part='substr(q2, 1, head)', n='head')} END AS lost1 FROM p0),
p2 AS (SELECT *, CASE WHEN kind = 'right' THEN CASE WHEN lost1 THEN tail1 ELSE cigar END WHEN lost1 THEN '20S' WHEN kind = 'wrong' THEN head1 ELSE cigar END AS c1, CASE WHEN kind = 'wrong' AND NOT lost1 THEN p1 + 12 ELSE p1 END AS n1,
  CASE WHEN kind = 'right' THEN CASE WHEN lost1 THEN cigar ELSE head2 END WHEN NOT lost1 THEN '20S' WHEN kind = 'wrong' THEN tail2 ELSE cigar END AS c2, CASE WHEN kind = 'right' AND NOT lost1 THEN p2 + moved ELSE p2 END AS n2 FROM p1),
new AS (SELECT i1 AS rec_idx, c1 AS c, n1 AS p, n2 AS m FROM p2 UNION ALL SELECT i2, c2, n2, n1 FROM p2)"""


@query(sql("""SELECT r.rec_idx, r.flag, CAST(coalesce(n.p, r.pos0) AS INTEGER) AS pos0, CAST(coalesce(n.m, r.mate_pos0) AS INTEGER) AS mate_pos0, CASE WHEN n.c IS NOT NULL THEN n.c
 WHEN r.flag & 3852 = 0 AND ((r.pos0 < r.mate_pos0 AND r.end0 < r.mate_pos0 AND r.flag & 48 = 16) OR (r.pos0 > r.mate_pos0 AND r.flag & 48 = 32)) THEN '20S' ELSE r.cigar END AS cigar FROM r LEFT JOIN new n ON r.rec_idx = n.rec_idx""", CUTS, OVERLAPS))
def overlap_clip(spark, d):
    return overlap.clip(reads(spark, d)).select("rec_idx", "flag", "pos0", "mate_pos0", "cigar")


@query(sql("""SELECT rec_idx, CASE p4 WHEN 1 THEN CASE WHEN NOT rev THEN '4S14M2S' ELSE '3S13M4S' END WHEN 2 THEN CASE WHEN rev THEN '2S8M2D6M4S' ELSE '4S6M2D8M2S' END WHEN 3 THEN CASE WHEN rev THEN '2S6M1I7M4S' ELSE '4S4M1I9M2S' END ELSE CASE WHEN rev THEN '2S14M4S' ELSE '4S14M2S' END END AS cigar,
 CAST(pos0 + CASE WHEN p4 = 1 THEN CASE WHEN rev THEN 0 ELSE 1 END WHEN rev THEN 2 ELSE 4 END AS INTEGER) AS pos0 FROM (SELECT *, (flag & 16) <> 0 AS rev, CASE cigar WHEN '20M' THEN 0 WHEN '3S17M' THEN 1 WHEN '10M2D10M' THEN 2 ELSE 3 END AS p4 FROM r WHERE flag & 4 = 0)"""))
def clip_ends(spark, d):
    own = reads(spark, d).filter(~fl.has(F.col("flag"), fl.UNMAPPED))
    return rewrite.clip(own, 4, 2).select("rec_idx", "cigar", "pos0")


DEDUP = f"""e AS (SELECT rec_idx, read_name, ref_id, CASE WHEN flag & 16 > 0 THEN end0 ELSE pos0 - lead END AS c5, flag & 16 > 0 AS rv, rg, {SUMQ} AS q, flag & 8 = 0 AS paired FROM r WHERE flag & 2820 = 0),
frag AS (SELECT rec_idx FROM (SELECT rec_idx, paired, bool_or(paired) OVER (PARTITION BY ref_id, c5, rv, rg) AS anyp, row_number() OVER (PARTITION BY ref_id, c5, rv, rg, paired ORDER BY q DESC, rec_idx) AS rn FROM e) WHERE NOT paired AND (anyp OR rn > 1)),
k AS (SELECT rec_idx, read_name, q, c5, {{'a': ref_id, 'b': c5, 'c': rv, 'd': rg}} AS key FROM e WHERE paired),
pr AS (SELECT a.rec_idx AS i1, b.rec_idx AS i2, a.q + b.q AS q, CASE WHEN b.c5 < a.c5 THEN b.rec_idx ELSE a.rec_idx END AS lead_idx, least(a.key, b.key) AS k1, greatest(a.key, b.key) AS k2 FROM k a JOIN k b ON a.read_name = b.read_name AND a.rec_idx < b.rec_idx),
prd AS (SELECT i1, i2 FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY q DESC, lead_idx) AS rn FROM pr) WHERE rn > 1),
dups AS (SELECT rec_idx FROM frag UNION ALL SELECT i1 FROM prd UNION ALL SELECT i2 FROM prd)"""


@query(sql("SELECT rec_idx FROM frag", DEDUP))
def dedup_fragments(spark, d):
    return dedup.fragment_duplicates(dedup.keyed(reads(spark, d), library="rg"))


@query(sql("SELECT i1 AS rec_idx FROM prd UNION ALL SELECT i2 FROM prd", DEDUP))
def dedup_pairs(spark, d):
    return dedup.pair_duplicates(dedup.keyed(reads(spark, d), library="rg"))


@query(sql("SELECT rec_idx, CAST((flag & ~1024) + CASE WHEN rec_idx IN (SELECT rec_idx FROM dups) THEN 1024 ELSE 0 END AS INTEGER) AS flag FROM r", DEDUP))
def dedup_mark(spark, d):
    return dedup.mark(reads(spark, d), library="rg").select("rec_idx", "flag")


@query(sql("SELECT rec_idx FROM r WHERE rec_idx NOT IN (SELECT rec_idx FROM dups)", DEDUP))
def dedup_remove(spark, d):
    return dedup.mark(reads(spark, d), library="rg", remove=True).select("rec_idx")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def dedup_rows_best(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    best = dedup.best_per_key(items, ["l_orderkey", "l_linenumber"], F.col("l_extendedprice"), F.struct("l_partkey", "l_suppkey"))
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT md5(text) AS digest, count(*) AS n_docs, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_exact_dup(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id")).filter("n_docs > 1")


@query("SELECT doc_id, quality FROM (SELECT d.doc_id, coalesce(l.quality, -1) AS quality, row_number() OVER (PARTITION BY md5(d.text) ORDER BY coalesce(l.quality, -1) DESC, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE rn = 1")
def doc_best_dup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))
    # Aggregated before the shuffle: a text with very many copies makes one row for each task.
    best = docs.groupBy("digest").agg(F.max(F.struct("quality", (-F.col("doc_id")).alias("i"))).alias("b"))
    return best.select((-F.col("b.i")).alias("doc_id"), F.col("b.quality").alias("quality"))


CHANGED = "c AS (SELECT * REPLACE (CAST(CASE WHEN rec_idx % 19 = 0 THEN mapq + 1 ELSE mapq END AS INTEGER) AS mapq, CAST(CASE WHEN rec_idx % 17 = 0 THEN pos0 + 150000 WHEN rec_idx % 13 = 0 THEN pos0 + 5 ELSE pos0 END AS INTEGER) AS pos0) FROM r WHERE rec_idx % 23 <> 0), r2 AS (SELECT * FROM r WHERE rec_idx % 29 <> 0)"
ON = "a.read_name = b.read_name AND (a.flag & 192) = (b.flag & 192) AND abs(a.pos0 - b.pos0) < 100000"
FIELDS = ["read_name", "flag", "ref_id", "pos0", "mapq", "rec_idx"]


def _two(spark, d):
    r = reads(spark, d).select(*FIELDS)
    n = F.col("rec_idx")
    changed = r.filter(n % 23 != 0).withColumns({"mapq": F.when(n % 19 == 0, F.col("mapq") + 1).otherwise(F.col("mapq")), "pos0": F.when(n % 17 == 0, F.col("pos0") + 150000).when(n % 13 == 0, F.col("pos0") + 5).otherwise(F.col("pos0"))})
    return r.filter(n % 29 != 0), changed


def _keys():
    return [F.col("read_name"), fl.fragment(F.col("flag"))]


@query(sql(f"SELECT a.rec_idx AS rec1, b.rec_idx AS rec2, concat_ws(',', CASE WHEN a.pos0 <> b.pos0 THEN 'pos0' END, CASE WHEN a.mapq <> b.mapq THEN 'mapq' END) AS changed FROM r2 a FULL OUTER JOIN c b ON {ON} WHERE a.rec_idx IS NULL OR b.rec_idx IS NULL OR a.pos0 <> b.pos0 OR a.mapq <> b.mapq", CHANGED))
def diff_full_outer(spark, d):
    a, b = _two(spark, d)
    both = diff.full_outer(a, b, _keys(), "rec_idx", diff.within(100_000))
    one = F.col("l").isNull() | F.col("r").isNull()
    out = both.select(F.col("l.rec_idx").alias("rec1"), F.col("r.rec_idx").alias("rec2"), F.when(one, "").otherwise(F.array_join(diff.changed_fields(["pos0", "mapq"]), ",")).alias("changed"), one.alias("_one"))
    return out.filter("_one or changed <> ''").drop("_one")


@query(sql("SELECT a.rec_idx FROM r2 a WHERE a.rec_idx % 23 = 0", CHANGED))
def diff_only_left(spark, d):
    a, b = _two(spark, d)
    return diff.only(a, b, _keys(), "rec_idx").select("rec_idx")


@query(sql("SELECT b.rec_idx FROM c b WHERE b.rec_idx % 29 = 0", CHANGED))
def diff_only_right(spark, d):
    a, b = _two(spark, d)
    return diff.only(b, a, _keys(), "rec_idx").select("rec_idx")


@query("""WITH c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)
SELECT a.o_orderkey, concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END) AS changed
FROM orders a JOIN c b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority""")
def diff_changed_fields(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = o.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))})
    both = diff.full_outer(o, c, [F.col("o_orderkey")], "o_custkey")
    return both.select(F.col("l.o_orderkey").alias("o_orderkey"), F.array_join(diff.changed_fields(["o_orderstatus", "o_orderpriority"]), ",").alias("changed")).filter("changed <> ''")


@query(sql("SELECT row_number() OVER (ORDER BY ref_id, pos0, CASE WHEN flag & 16 > 0 THEN 1 ELSE 0 END, CAST(substr(rg, 3) AS INTEGER), rec_idx) AS place, rec_idx FROM r"))
def merge_sorted(spark, d):
    r = reads(spark, d)
    merged = merge.union_inputs([r.filter(F.col("rg") == f"rg{i}") for i in range(3)])
    return ordering.number_rows(merged, F.struct((F.col("ref_id") < 0).cast("int").alias("u"), F.col("ref_id"), F.floor(F.col("pos0") / 16).alias("b")), merge.sort_key(), "place").select("place", "rec_idx")


@query(sql("SELECT rg, count(*) AS n_inputs FROM (SELECT DISTINCT ref_id, rg FROM r) GROUP BY rg"))
def union_distinct_rg(spark, d):
    r = reads(spark, d)
    return r.select("ref_id", "rg").dropDuplicates().groupBy("rg").agg(F.count(F.lit(1)).alias("n_inputs"))


@query(sql("SELECT r.rec_idx, g.region_no FROM r JOIN regions g ON r.ref_id = g.ref_id AND r.pos0 < g.end0_excl AND r.end0 >= g.start0"))
def interval_overlap_join(spark, d):
    return intervals.overlap_join(with_ends(reads(spark, d)), regions(spark, d)).select("rec_idx", "region_no")


@query(sql("SELECT r.rec_idx, g.region_no FROM r JOIN regions g ON r.ref_id = g.ref_id AND r.pos0 >= g.start0 AND r.end0 < g.end0_excl"))
def interval_within_join(spark, d):
    return intervals.overlap_join(with_ends(reads(spark, d)), regions(spark, d), contained=True).select("rec_idx", "region_no")


@query(sql("SELECT r.rec_idx FROM r WHERE EXISTS (SELECT 1 FROM regions g WHERE r.ref_id = g.ref_id AND r.pos0 < g.end0_excl AND r.end0 >= g.start0)"))
def interval_semi(spark, d):
    return intervals.semi_join(with_ends(reads(spark, d)), regions(spark, d)).select("rec_idx")


@query(sql("SELECT region_no, max(end0_excl) OVER (PARTITION BY ref_id ORDER BY start0, end0_excl, region_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM regions"))
def regions_running_end(spark, d):
    return intervals.furthest_end_before(regions(spark, d)).select("region_no", "prev_end")


@query(sql("SELECT rec_idx FROM r ANTI JOIN sites s ON r.ref_id = s.ref_id AND r.pos0 = s.pos0"))
def site_anti_join(spark, d):
    return intervals.at_sites(reads(spark, d), sites(spark, d), keep=False).select("rec_idx")


@query(sql("SELECT rec_idx FROM r SEMI JOIN sites s ON r.ref_id = s.ref_id AND r.pos0 = s.pos0"))
def site_semi_join(spark, d):
    return intervals.at_sites(reads(spark, d), sites(spark, d), keep=True).select("rec_idx")


# Offset o on the reference to the place in the read (from 1), by cigar.
PILE = """o AS (SELECT *, CAST(unnest(range(0, end0 - pos0 + 1)) AS INTEGER) AS o FROM r),
pl AS (SELECT *, pos0 + o AS pos, CASE cigar WHEN '20M' THEN o + 1 WHEN '3S17M' THEN o + 4 WHEN '10M2D10M' THEN CASE WHEN o < 10 THEN o + 1 WHEN o < 12 THEN NULL ELSE o - 1 END ELSE CASE WHEN o < 8 THEN o + 1 ELSE o + 2 END END AS q FROM o),
x AS (SELECT *, flag & 1540 = 0 AS fine, flag & 1540 = 0 AND mapq <> 255 AS known, flag & 1540 = 0 AND mapq <> 255 AND mapq >= 20 AND q IS NOT NULL AS deep FROM pl),
pq AS (SELECT ref_id, pos, count(*) AS total_reads, count(*) FILTER (WHERE flag & 1024 > 0) AS dups, count(*) FILTER (WHERE flag & 512 > 0) AS qc_fail, count(*) FILTER (WHERE fine) AS mapped, count(*) FILTER (WHERE fine AND flag & 1 > 0) AS paired,
 count(*) FILTER (WHERE fine AND flag & 3 = 3) AS proper_pair, count(*) FILTER (WHERE fine AND mapq = 0) AS zero_mapq, count(*) FILTER (WHERE fine AND mapq < 10) AS low_mapq, count(*) FILTER (WHERE fine AND mapq >= 20) AS pass_mapq, count(*) FILTER (WHERE fine AND mapq = 255) AS mapq_255,
 round(avg(mapq) FILTER (WHERE known), 6) AS avg_mapq, count(*) FILTER (WHERE known) AS avg_mapq_count, count(*) FILTER (WHERE deep) AS depth, count(*) FILTER (WHERE deep AND ascii(substr(qual, q, 1)) >= 53) AS q20_bases FROM x GROUP BY ref_id, pos)"""


@query(sql("SELECT ref_id, pos, count(*) AS depth FROM pl WHERE q IS NOT NULL AND flag & 1540 = 0 GROUP BY ref_id, pos", PILE))
def pileup_depth(spark, d):
    c = pileup.cover(reads(spark, d).filter(fl.passes(F.col("flag"), 0, fl.UNMAPPED | fl.QC_FAIL | fl.DUPLICATE)))
    return c.filter("has_base").groupBy("ref_id", "pos").agg(F.count(F.lit(1)).alias("depth"))


@query(sql("SELECT * FROM pq", PILE))
def pileup_qc(spark, d):
    return pileup.qc(reads(spark, d), min_mapq=20)


@query(sql("SELECT pq.* FROM pq SEMI JOIN regions g ON pq.ref_id = g.ref_id AND pq.pos >= g.start0 AND pq.pos < g.end0_excl ANTI JOIN sites s ON pq.ref_id = s.ref_id AND pq.pos = s.pos0", PILE))
def pileup_in_regions(spark, d):
    return pileup.qc(reads(spark, d), min_mapq=20, regions=regions(spark, d), sites=sites(spark, d))


@query(sql("SELECT ref_id, pos, total_reads, " + ", ".join(f"round(100.0 * {c} / total_reads, 3) AS {c}_pct" for c in pileup.COUNTERS[1:]) + ", avg_mapq FROM pq", PILE))
def pileup_percents(spark, d):
    return pileup.percents(pileup.qc(reads(spark, d), min_mapq=20))


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS counter, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd FROM pq" for c in pileup.COUNTERS), PILE))
def pileup_summary(spark, d):
    return pileup.summary(pileup.qc(reads(spark, d), min_mapq=20))


# Bases in the order of sequencing: i is the place in the read (from 1), oo the reference offset there.
RECAB = f"""b0 AS (SELECT *, CAST(unnest(range(0, 20)) AS INTEGER) AS cycle FROM r),
b1 AS (SELECT *, CASE WHEN {REV} THEN 20 - cycle ELSE cycle + 1 END AS i FROM b0),
b2 AS (SELECT *, CASE cigar WHEN '20M' THEN i - 1 WHEN '3S17M' THEN CASE WHEN i > 3 THEN i - 4 END WHEN '10M2D10M' THEN CASE WHEN i <= 10 THEN i - 1 ELSE i + 1 END ELSE CASE WHEN i <= 8 THEN i - 1 WHEN i > 9 THEN i - 2 END END AS oo,
 CASE WHEN {REV} THEN translate(substr(seq, i, 1), 'ACGT', 'TGCA') ELSE substr(seq, i, 1) END AS cur, CAST(ascii(substr(qual, i, 1)) - 33 AS INTEGER) AS q FROM b1),
b3 AS (SELECT *, pos0 + oo AS rp, coalesce(lag(cur) OVER w, 'K') AS prev, lag(pos0 + oo) OVER w AS pp, flag & 128 > 0 AS second FROM b2 WINDOW w AS (PARTITION BY rec_idx ORDER BY cycle)),
b4 AS (SELECT * FROM b3 WHERE flag & 3844 = 0 AND mapq NOT IN (0, 255) AND rp IS NOT NULL AND q >= 5 AND cur <> 'N' AND (cycle = 0 OR (abs(rp - pp) = 1 AND prev <> 'N'))),
b5 AS (SELECT * FROM b4 WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.ref_id = b4.ref_id AND s.pos0 = b4.rp) AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.ref_id = b4.ref_id AND s.pos0 = b4.pp)),
b6 AS (SELECT *, CASE WHEN {REV} THEN translate({SQL_BASE.format(pos='rp', ref='ref_id')}, 'ACGT', 'TGCA') ELSE {SQL_BASE.format(pos='rp', ref='ref_id')} END AS base FROM b5),
cv AS (SELECT rg, q AS qual, cycle, second, prev, cur, CAST(sum(CASE WHEN cur = base THEN 1 ELSE 0 END) AS BIGINT) AS matches, CAST(sum(CASE WHEN cur <> base THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM b6 GROUP BY ALL),
qe AS (SELECT *, CAST(floor(-10 * log10((mismatches + 1) / (matches + mismatches + 1)) + 0.5) AS INTEGER) AS q_emp FROM cv)"""


def _reference(spark):
    r = spark.range(0, 10000).select((F.col("id") % 5).cast("int").alias("ref_id"), F.floor(F.col("id") / 5).cast("int").alias("pos"))
    return r.withColumn("base", ref_base(F.col("ref_id"), F.col("pos")))


def _cells(spark, d):
    return recab.covariates(reads(spark, d), _reference(spark), sites=sites(spark, d), max_span=22)


@query(sql("SELECT * FROM cv", RECAB))
def covariate_table(spark, d):
    return _cells(spark, d)


@query(sql("SELECT * FROM qe", RECAB))
def empirical_quality(spark, d):
    return recab.empirical(_cells(spark, d))


@query(sql("SELECT concat_ws(',', rg, CAST(qual AS VARCHAR), CAST(CASE WHEN second THEN -(cycle + 1) ELSE cycle + 1 END AS VARCHAR), concat(prev, cur), CAST(matches + mismatches AS VARCHAR), CAST(mismatches AS VARCHAR), CAST(q_emp AS VARCHAR)) AS value FROM qe", RECAB))
def recal_table_lines(spark, d):
    return recab.table_lines(_cells(spark, d))


@query(sql(f"""SELECT rec_idx, CASE WHEN {REV} THEN reverse(qual) ELSE qual END AS qual FROM (SELECT rec_idx, any_value(flag) AS flag, string_agg(chr(CAST(33 + CASE WHEN b3.q < 5 OR qe.q_emp IS NULL THEN b3.q ELSE least(qe.q_emp, 50) END AS INTEGER)), '' ORDER BY b3.cycle) AS qual
 FROM b3 LEFT JOIN qe ON b3.rg = qe.rg AND b3.q = qe.qual AND b3.cycle = qe.cycle AND b3.second = qe.second AND b3.prev = qe.prev AND b3.cur = qe.cur GROUP BY rec_idx)""", RECAB))
def apply_recal(spark, d):
    return recab.apply(reads(spark, d), _cells(spark, d)).select("rec_idx", "qual")


@query()
def recal_regression(spark, d):
    cells = _cells(spark, d)
    fit = recab.logistic_fit(cells)
    return recab.empirical(cells).withColumn("q_model", recab.predicted_quality(fit["weights"]))


@query("SELECT event_id, new_id FROM events JOIN (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS new_id FROM events GROUP BY user_id) USING (user_id)")
def rename_first_seen(spark, d):
    return ordering.first_seen_ids(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "new_id")


@query("SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run_id FROM (SELECT event_id, user_id, CASE WHEN lag(event_id) OVER w IS NULL OR lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def run_islands(spark, d):
    return ordering.runs(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", "event_id", ["user_id"]).select("event_id", "run_id")


@query(sql("SELECT ref_id, count(*) AS n_reads FROM r GROUP BY ref_id"))
def split_counts_by_ref(spark, d):
    return stats.counts_by(reads(spark, d), "ref_id")


@query(sql("SELECT rg, count(*) AS n_reads FROM r GROUP BY rg"))
def split_counts_by_rg(spark, d):
    return stats.counts_by(reads(spark, d), "rg")


FAULTS = """v AS (SELECT * REPLACE (CASE WHEN rec_idx % 37 = 0 THEN flag + 70000 ELSE flag END AS flag, CASE WHEN rec_idx % 41 = 0 THEN concat(read_name, ' x') ELSE read_name END AS read_name, CASE WHEN rec_idx % 43 = 0 THEN '19M' WHEN rec_idx % 47 = 0 THEN '20Z' ELSE cigar END AS cigar,
 CASE WHEN rec_idx % 53 = 0 THEN substr(qual, 2) ELSE qual END AS qual, CAST(CASE WHEN rec_idx % 59 = 0 THEN -1 ELSE ref_id END AS INTEGER) AS ref_id) FROM r)"""
ERRORS = """er AS (SELECT rec_idx, 'INVALID_FLAG' AS error FROM v WHERE flag > 65535 UNION ALL SELECT rec_idx, 'INVALID_NAME' FROM v WHERE read_name LIKE '% %' UNION ALL SELECT rec_idx, 'INVALID_CIGAR' FROM v WHERE cigar = '20Z' UNION ALL SELECT rec_idx, 'CIGAR_SEQ_LENGTH' FROM v WHERE cigar = '19M'
 UNION ALL SELECT rec_idx, 'SEQ_QUAL_LENGTH' FROM v WHERE length(qual) <> length(seq) UNION ALL SELECT rec_idx, 'MAPPED_WITHOUT_REF' FROM v WHERE ref_id < 0 AND flag & 4 = 0)"""


def _faulty(spark, d):
    n = F.col("rec_idx")
    return reads(spark, d).withColumns({
        "flag": F.when(n % 37 == 0, F.col("flag") + 70000).otherwise(F.col("flag")), "read_name": F.when(n % 41 == 0, F.concat("read_name", F.lit(" x"))).otherwise(F.col("read_name")), "cigar": F.when(n % 43 == 0, "19M").when(n % 47 == 0, "20Z").otherwise(F.col("cigar")),
        "qual": F.when(n % 53 == 0, F.substring("qual", 2, 100)).otherwise(F.col("qual")), "ref_id": F.when(n % 59 == 0, -1).otherwise(F.col("ref_id")),
    })


@query(sql("SELECT rec_idx, error FROM er", FAULTS, ERRORS))
def validate_errors(spark, d):
    return validate.errors(_faulty(spark, d))


@query(sql("SELECT error, count(*) AS n_errors FROM er GROUP BY error", FAULTS, ERRORS))
def validate_counts(spark, d):
    return validate.error_counts(_faulty(spark, d))


@query(sql("SELECT rec_idx, error FROM er ORDER BY rec_idx, error LIMIT 50", FAULTS, ERRORS))
def validate_first_50(spark, d):
    return validate.until(_faulty(spark, d), 50)


@query(sql("SELECT rec_idx FROM (SELECT rec_idx, ref_id, pos0, lag(ref_id) OVER (ORDER BY rec_idx) AS pr, lag(pos0) OVER (ORDER BY rec_idx) AS pp FROM r) WHERE ref_id < pr OR (ref_id = pr AND pos0 < pp)"))
def unsorted_records(spark, d):
    return validate.unsorted(reads(spark, d))


@query(sql("SELECT * EXCLUDE (end0, lead) FROM r ORDER BY rec_idx LIMIT 100"))
def limit_first_n(spark, d):
    return reads(spark, d).orderBy("rec_idx").limit(100)


@query(sql("SELECT rec_idx, read_name FROM r WHERE read_name IN (SELECT concat('r', CAST(p_partkey * 3 AS VARCHAR)) FROM part)"))
def read_name_semi(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit("r"), (F.col("p_partkey") * 3).cast("string")).alias("read_name"))
    return reads(spark, d).join(names, "read_name", "left_semi").select("rec_idx", "read_name")


@query(sql("SELECT rec_idx, CASE cigar WHEN '20M' THEN substr(seq, 6, 1) WHEN '3S17M' THEN substr(seq, 9, 1) WHEN '10M2D10M' THEN substr(seq, 6, 1) ELSE substr(seq, 6, 1) END AS base FROM r"))
def base_at_position(spark, d):
    return reads(spark, d).select("rec_idx", cg.base_at(F.col("cigar"), F.col("seq"), F.col("pos0"), F.col("pos0") + 5).alias("base"))


@query(sql("SELECT rec_idx, read_name, flag, concat('chr', CAST(ref_id AS VARCHAR)) AS ref_name, pos0, mapq, cigar, concat('chr', CAST(mate_ref_id AS VARCHAR)) AS mate_ref_name, mate_pos0, seq, qual, rg FROM r"))
def sam_round_trip(spark, d):
    """Records as SAM text and parsed again."""
    r = reads(spark, d)
    name = lambda c: F.concat(F.lit("chr"), F.col(c).cast("string"))
    full = r.select("*", name("ref_id").alias("ref_name"), name("mate_ref_id").alias("mate_ref_name"), F.lit(0).alias("insert_size"), tg.put(F.create_map().cast(tg.TYPE), "RG", "Z", F.col("rg")).alias("tags"))
    text = sam.lines(full)
    back = sam.parse(text, order=F.col("rec_idx"))
    return back.select("rec_idx", "read_name", "flag", "ref_name", "pos0", "mapq", "cigar", "mate_ref_name", "mate_pos0", "seq", "qual", tg.value(F.col("tags"), "RG").alias("rg"))


# Bases with the reference base under them: i is the place in the read (from 1), rp the reference position.
PLACED = f"""s0 AS (SELECT *, CAST(unnest(range(1, 21)) AS INTEGER) AS i FROM r),
s1 AS (SELECT *, pos0 + CASE cigar WHEN '20M' THEN i - 1 WHEN '3S17M' THEN CASE WHEN i > 3 THEN i - 4 END WHEN '10M2D10M' THEN CASE WHEN i <= 10 THEN i - 1 ELSE i + 1 END ELSE CASE WHEN i <= 8 THEN i - 1 WHEN i > 9 THEN i - 2 END END AS rp, substr(seq, i, 1) AS ch FROM s0),
s2 AS (SELECT *, {SQL_BASE.format(pos="rp", ref="ref_id")} AS base FROM s1)"""


def _sequences(spark):
    i = F.sequence(F.lit(0), F.lit(1999))
    return spark.range(5).select(F.col("id").cast("int").alias("ref_id"), F.array_join(F.transform(i, lambda x: ref_base(F.col("id"), x)), "").alias("bases"))


@query(sql("SELECT rec_idx, string_agg(CASE WHEN ch = base THEN '=' ELSE ch END, '' ORDER BY i) AS seq FROM s2 GROUP BY rec_idx", PLACED))
def bases_to_equals(spark, d):
    return rewrite.swap_bases(reads(spark, d), _sequences(spark), equals=True).select("rec_idx", "seq")


@query(sql("SELECT rec_idx, seq FROM r"))
def equals_to_bases(spark, d):
    """There and back again."""
    ref = _sequences(spark)
    return rewrite.swap_bases(rewrite.swap_bases(reads(spark, d), ref, equals=True), ref, equals=False).select("rec_idx", "seq")


ENDS = """s3 AS (SELECT rec_idx, i, ch <> base AS bad, ascii(substr(qual, i, 1)) - 33 AS q FROM s2 WHERE rp IS NOT NULL),
s4 AS (SELECT *, row_number() OVER f AS kf, count(*) FILTER (WHERE bad) OVER f AS bf, row_number() OVER b AS kb, count(*) FILTER (WHERE bad) OVER b AS bb, count(*) OVER (PARTITION BY rec_idx) AS n FROM s3 WINDOW f AS (PARTITION BY rec_idx ORDER BY i), b AS (PARTITION BY rec_idx ORDER BY i DESC)),
s5 AS (SELECT rec_idx, coalesce(max(i) FILTER (WHERE bad AND kf <= (n + 1) // 2 AND bf / kf > 0.8), 0) AS x, coalesce(max(21 - i) FILTER (WHERE bad AND kb <= (n + 1) // 2 AND bb / kb > 0.8), 0) AS y FROM s4 GROUP BY rec_idx),
s6 AS (SELECT rec_idx, CASE WHEN x + y >= 20 THEN 20 ELSE x END AS x, CASE WHEN x + y >= 20 THEN 0 ELSE y END AS y FROM s5)"""


@query(sql("SELECT s6.rec_idx, CAST(x AS INTEGER) AS front, CAST(y AS INTEGER) AS back, CAST(coalesce(sum(q) FILTER (WHERE bad AND i > x AND i <= 20 - y), 0) AS INTEGER) AS loss FROM s6 JOIN s3 ON s6.rec_idx = s3.rec_idx GROUP BY ALL", PLACED, ENDS))
def mismatch_ends(spark, d):
    return rewrite.mismatch_ends(reads(spark, d), _sequences(spark), threshold=0.8).select("rec_idx", "_j.front", "_j.back", "_j.loss")


def _tagged(spark, d):
    """Reads with a tag for their group, and for some of them the tags that keep original values."""
    n, r = F.col("rec_idx"), reads(spark, d)
    tags = tg.put(F.create_map().cast(tg.TYPE), "RG", "Z", F.col("rg"))
    for name, kind, every, value in (("OQ", "Z", 2, F.reverse("qual")), ("OC", "Z", 3, F.lit("5S15M")), ("OP", "i", 5, F.lit("1000")), ("BQ", "Z", 7, F.lit("x")), ("XT", "i", 4, F.lit("9"))):
        tags = tg.put(tags, name, kind, F.when(n % every == 0, value))
    return r.withColumn("tags", tags)


def _tag_text(*tags):
    """SQL of tags as text, by name: (name, every, text)."""
    return "concat_ws(chr(9), " + ", ".join(f"CASE WHEN rec_idx % {every} = 0 THEN {text} END" for _, every, text in sorted(tags)) + ")"


RG_TAG, OQ_TAG, OC_TAG = ("RG", 1, "concat('RG:Z:', rg)"), ("OQ", 2, "concat('OQ:Z:', reverse(qual))"), ("OC", 3, "'OC:Z:5S15M'")
OP_TAG, BQ_TAG, XT_TAG = ("OP", 5, "'OP:i:1000'"), ("BQ", 7, "'BQ:Z:x'"), ("XT", 4, "'XT:i:9'")


@query(sql(f"SELECT rec_idx, CASE WHEN rec_idx % 3 = 0 THEN '5S15M' ELSE cigar END AS cigar, CAST(CASE WHEN rec_idx % 5 = 0 THEN 999 ELSE pos0 END AS INTEGER) AS pos0, CASE WHEN rec_idx % 2 = 0 THEN reverse(qual) ELSE qual END AS qual, {_tag_text(RG_TAG, XT_TAG)} AS tag_text FROM r"))
def revert_originals(spark, d):
    return rewrite.revert(_tagged(spark, d), remove_bq=True).select("rec_idx", "cigar", "pos0", "qual", tg.text(F.col("tags")).alias("tag_text"))


@query(sql(f"SELECT rec_idx, translate(qual, '#%()+-/13579;=?A', '!!!!+++111111111') AS qual, {_tag_text(RG_TAG, OC_TAG, OP_TAG, BQ_TAG)} AS tag_text FROM r WHERE flag & 1024 = 0"))
def squeeze_records(spark, d):
    return rewrite.squeeze(_tagged(spark, d), bounds=[10, 16], remove=["XT:i"]).select("rec_idx", "qual", tg.text(F.col("tags")).alias("tag_text"))


@query(sql("SELECT rec_idx, concat(CASE WHEN rec_idx % 3 = 0 THEN 'UM' WHEN rec_idx % 3 = 1 THEN 'xseqcore_' ELSE '' END, read_name) AS read_name, 'new' AS rg FROM r"))
def set_read_group(spark, d):
    n = F.col("rec_idx") % 3
    named = _tagged(spark, d).withColumn("read_name", F.concat(F.when(n == 0, "seqcore_").when(n == 1, "xseqcore_").otherwise(""), "read_name"))
    return rewrite.with_read_group(named, "new").select("rec_idx", "read_name", tg.value(F.col("tags"), "RG").alias("rg"))


@query(sql("SELECT rec_idx, rec_idx % 2 <> 0 AS fell_back, CASE WHEN rec_idx % 2 = 0 THEN reverse(qual) ELSE qual END AS qual FROM r"))
def quality_from_tag(spark, d):
    return rewrite.quality_from_tag(_tagged(spark, d), "OQ").select("rec_idx", "fell_back", "qual")


@query(sql(f"SELECT rec_idx, {_tag_text(('OQ', 1, "concat('OQ:Z:', qual)"), ('OC', 1, "concat('OC:Z:', cigar)"), RG_TAG, OP_TAG, BQ_TAG, XT_TAG)} AS tag_text FROM r"))
def store_originals(spark, d):
    kept = rewrite.store_original(rewrite.store_original(_tagged(spark, d), "OC"), "OQ", "qual")
    return kept.select("rec_idx", tg.text(F.col("tags")).alias("tag_text"))


@query(sql("SELECT rec_idx, CASE WHEN mapq < 10 THEN '*' ELSE cigar END AS cigar, CAST(CASE WHEN mapq < 10 THEN flag | 4 ELSE flag END AS INTEGER) AS flag, pos0 FROM r"))
def unmap_reads(spark, d):
    return rewrite.unmap(reads(spark, d), F.col("mapq") < 10).select("rec_idx", "cigar", "flag", "pos0")


@query(sql("SELECT rec_idx, CASE WHEN mapq > 19 THEN NULL WHEN cigar = '3S17M' AND mapq < 3 THEN 'S' WHEN cigar = '8M1I11M' AND mapq = 8 THEN 'I' ELSE 'M' END AS op FROM r"))
def cigar_op_at(spark, d):
    return reads(spark, d).select("rec_idx", cg.op_at(F.col("cigar"), F.col("mapq")).alias("op"))


@query(sql("SELECT rec_idx, CASE WHEN mapq > 19 THEN 0.0 ELSE list_avg(list_transform(string_split(substr(qual, mapq + 1, 5), ''), lambda c: ascii(c))) END AS mean_code FROM r"))
def quality_slice_mean(spark, d):
    return reads(spark, d).select("rec_idx", bs.quality_mean(F.col("qual"), F.col("mapq"), F.col("mapq") + 4).alias("mean_code"))


@query(sql("SELECT rec_idx FROM (SELECT rec_idx, read_name, lag(read_name) OVER (ORDER BY rec_idx) AS before FROM r) WHERE read_name < before"))
def unsorted_names(spark, d):
    return validate.unsorted(reads(spark, d), "name")


def _dictionary(spark, d):
    n = table(spark, d, "nation")
    return sam.header_of(n.select(F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), (F.col("n_nationkey") + 100).cast("string")).alias("value"), "n_nationkey"), F.col("n_nationkey"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ref_id, n_name AS name, CAST(n_nationkey + 100 AS INTEGER) AS length FROM nation")
def reference_dictionary(spark, d):
    return sam.references(_dictionary(spark, d))


@query("SELECT n_name AS id, concat('lib', n_regionkey) AS library, 's' AS sample, CAST(lib_id AS INTEGER) AS lib_id FROM nation JOIN (SELECT n_regionkey, row_number() OVER (ORDER BY min(n_nationkey)) AS lib_id FROM nation GROUP BY n_regionkey) USING (n_regionkey)")
def read_group_libraries(spark, d):
    n = table(spark, d, "nation")
    return sam.read_groups(sam.header_of(n.select(F.concat(F.lit("@RG\tID:"), "n_name", F.lit("\tLB:lib"), F.col("n_regionkey").cast("string"), F.lit("\tSM:s")).alias("value"), "n_nationkey"), F.col("n_nationkey")))


@query("""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS line_no, 'SQ' AS type, n_name AS id, concat('@SQ', chr(9), 'SN:', n_name, chr(9), 'LN:', n_nationkey + 100, CASE WHEN n_nationkey % 2 = 0 THEN concat(chr(9), 'M5:', md5(n_name), chr(9), 'AS:x') ELSE '' END) AS raw FROM nation
UNION ALL SELECT CAST((SELECT count(*) FROM nation) AS INTEGER), 'RG', 'new', concat('@RG', chr(9), 'ID:new', chr(9), 'SM:s') UNION ALL SELECT CAST((SELECT count(*) FROM nation) + 1 AS INTEGER), 'CO', NULL, concat('@CO', chr(9), 'done')""")
def header_edit(spark, d):
    known = {r.n_name: (r.n_nationkey + 100, r.md5) for r in table(spark, d, "nation").filter("n_nationkey % 2 = 0").select("n_name", "n_nationkey", F.md5("n_name").alias("md5")).collect()}  # a header's lines
    return sam.edit_header(_dictionary(spark, d), ["@RG\\tID:new\\tSM:s", "@CO\\tdone"], checks=known, extra={"AS": "x"})


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 600000000")
def event_dedup_window(spark, d):
    return events_batch.first_in_gap(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 600).select("event_id", "user_id", "event_type")


@query("SELECT a.event_id AS event1, b.event_id AS event2 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND epoch_us(b.ts) >= epoch_us(a.ts) AND epoch_us(b.ts) - epoch_us(a.ts) < 300000000 AND a.event_id <> b.event_id")
def event_match_interval(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return events_batch.match_within(e, e, "user_id", "ts", 300).filter((F.col("l.event_type") != F.col("r.event_type")) & (F.col("l.event_id") != F.col("r.event_id"))).select(F.col("l.event_id").alias("event1"), F.col("r.event_id").alias("event2"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
