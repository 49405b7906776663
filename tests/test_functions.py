import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions import bases as bs
from readloom.functions import cigar as cg
from readloom.functions import flags as fl
from readloom.functions import tags as tg


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_flags(spark):
    assert one(spark, fl.explain(F.col("f")), f=99) == ["paired", "properly paired", "mate reverse strand", "first fragment"]
    assert one(spark, fl.explain(F.col("f")), f=0) == []
    assert fl.parse("0x63") == fl.parse("0X63") == fl.parse("99") == 99
    with pytest.raises(ValueError):
        fl.parse("70000")


@pytest.mark.parametrize(
    "cigar, span, query, lead, trail, end",
    [("10M", 10, 10, 0, 0, 109), ("3S5M2D4M1I2S", 11, 15, 3, 2, 110), ("2H3S4M", 4, 7, 5, 0, 103), ("*", 0, 0, 0, 0, 100), ("5M100N5M4H", 110, 10, 0, 4, 209)],
)
def test_cigar_spans(spark, cigar, span, query, lead, trail, end):
    c = F.col("c")
    got = spark.createDataFrame([(cigar,)], ["c"]).select(cg.ref_span(c).alias("a"), cg.query_length(c).alias("b"), cg.leading_clip(c).alias("d"), cg.trailing_clip(c).alias("e"), cg.align_end(F.lit(100), c).alias("f")).first()
    assert tuple(got) == (span, query, lead, trail, end)


def test_ref_offsets(spark):
    assert one(spark, cg.ref_offsets(F.col("c")), c="1S2M1I1M2D1M") == [None, 0, 1, None, 2, 5]
    assert one(spark, cg.base_at(F.col("c"), F.lit("NACGTG"), F.lit(10), 15), c="1S2M1I1M2D1M") == "G"
    assert one(spark, cg.base_at(F.col("c"), F.lit("NACGTG"), F.lit(10), 13), c="1S2M1I1M2D1M") is None


CIGARS = st.lists(st.tuples(st.integers(1, 9), st.sampled_from("MIDM=X")), min_size=1, max_size=6).map(lambda p: [(5, "M"), *p, (5, "M")])


@settings(max_examples=200, deadline=None)
@given(CIGARS, st.integers(0, 20), st.integers(0, 20))
def test_soft_clip_keeps_the_read(parts, front, back):
    whole = cg.text(parts)
    n = sum(k for k, o in cg.parse(whole) if o in cg.QUERY_OPS)
    end = 50 + sum(k for k, o in cg.parse(whole) if o in cg.REF_OPS)
    if front + back >= n:
        return
    got, pos = cg.soft_clip(whole, 50, front, back)
    p = cg.parse(got)
    assert sum(k for k, o in p if o in cg.QUERY_OPS) == n
    assert pos >= 50 and pos + sum(k for k, o in p if o in cg.REF_OPS) <= end
    clipped = (p[0][0] if p[0][1] == "S" else 0), (p[-1][0] if p[-1][1] == "S" and len(p) > 1 else 0)
    if any(o in cg.MATCH_OPS for _, o in p):
        assert clipped[0] >= front and clipped[1] >= back
        body = [o for _, o in p if o != "S"]
        assert body[0] in "M=X" or front == 0
        assert body[-1] in "M=X" or back == 0


def test_soft_clip_counts_old_clips():
    assert cg.soft_clip("3S17M", 10, 2, 0) == ("3S17M", 10)
    assert cg.soft_clip("3S17M", 10, 4, 0) == ("4S16M", 11)
    assert cg.soft_clip("8M1I11M", 10, 8, 0) == ("9S11M", 18)
    assert cg.soft_clip("8M2D12M", 10, 0, 12) == ("8M12S", 10)
    assert cg.soft_clip("2H8M", 10, 3, 0) == ("2H3S5M", 13)


def test_left_shift():
    #   read AACACACG with the second CA inserted
    assert cg.left_shift("5M2I3M", "AACACACTTT") == "1M2I7M"
    assert cg.left_shift("10M", "AACACACTTT") == "10M"


def test_bases(spark):
    assert one(spark, bs.reverse_complement(F.col("s")), s="aCGTN") == "NACGT"
    assert one(spark, bs.quality_sum(F.col("q")), q="!0?") == 45
    assert one(spark, bs.quality_sum(F.col("q")), q="*") == 0
    assert one(spark, bs.quality_mean(F.col("q"), F.lit(1), F.lit(2)), q="!0@") == 56.0
    assert one(spark, bs.quality_mean(F.col("q"), F.lit(7), F.lit(9)), q="!0@") == 0.0
    assert one(spark, bs.trim(F.col("s"), F.lit(2), F.lit(1), "N"), s="ACGTA") == "NNGTN"
    assert one(spark, bs.trim(F.col("s"), F.lit(4), F.lit(3), "N"), s="ACGTA") == "NNNNN"
    assert one(spark, bs.phred_of(F.lit(1), F.lit(99)), x=1) == 17
    assert one(spark, bs.use_equals(F.col("s"), F.lit("ACGT"), F.array(F.lit(0), F.lit(1), F.lit(None), F.lit(2))), s="AGTG") == "=GT="
    assert one(spark, bs.use_bases(F.col("s"), F.lit("ACGT"), F.array(F.lit(0), F.lit(1), F.lit(None), F.lit(2))), s="=GT=") == "AGTG"


def test_bins():
    a, b = bs.bin_map([10, 20], "mid")
    m = dict(zip(a, b, strict=True))
    assert m[chr(33 + 9)] == chr(33 + 4) and m[chr(33 + 15)] == chr(33 + 14) and m[chr(33 + 93)] == chr(33 + 56)
    with pytest.raises(ValueError):
        bs.bin_map([20, 10])


def test_tags(spark):
    fields = F.array(*[F.lit(x) for x in ("RG:Z:a:b", "NM:i:1", "NM:A:2", "NM:Z:x", "RG:Z:c")])
    t = spark.range(1).select(tg.parse(fields).alias("t"))
    got = t.select(tg.text(F.col("t")).alias("s"), tg.integer(F.col("t"), "NM").alias("n"), tg.value(F.col("t"), "RG").alias("r"), tg.text(tg.remove(F.col("t"), ["RG", "NM:i"])).alias("rest"), tg.text(tg.put(F.col("t"), "RG", "Z", F.lit("d"))).alias("put")).first()
    assert got.s == "NM:Z:x\tNM:A:2\tRG:Z:c" and got.n == 2 and got.r == "c" and got.rest == "NM:Z:x"
    assert got.put == "NM:Z:x\tNM:A:2\tRG:Z:d"
    assert tg.names("XT:Z,NM:i;RG") == ["XT:Z", "NM:i", "RG"]


def test_output_names():
    from readloom.functions import names

    assert names.without_extension("a/b.c.sam") == "a/b.c" and names.without_extension("a.b/c") == "a.b/c" and names.without_extension("d/.x") == "d/.x"
    assert names.stem("/p/q/in1.sam") == "in1" and names.stem("plain") == "plain"
    assert names.diff_outputs("o/d.sam", "x/in1.sam", "in2") == ("o/d.sam", "o/d_only1_in1.sam", "o/d_only2_in2.sam")
    assert names.fastq_outputs("x/r.sam", gzip=True) == {"first": "x/r_1.fastq.gz", "second": "x/r_2.fastq.gz", "unpaired": "x/r.fastq.gz"}


def test_query_indices(spark):
    from readloom.functions import cigar as cg

    rows = spark.createDataFrame([("3M",), ("2S2M1D1M",), ("1M2I1M2N1M3H",), ("*",), (None,)], "cigar string")
    assert [r[0] for r in rows.select(cg.query_indices(F.col("cigar"))).collect()] == [[0, 1, 2], [2, 3, -1, 4], [0, 3, -1, -1, 4], [], []]
