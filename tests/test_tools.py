import pytest
from pyspark.sql import functions as F

from readloom import tools
from readloom.functions import tags as tg
from readloom.sources import sam

HEAD = ["@HD\tVN:1.4", "@SQ\tSN:1\tLN:1000", "@SQ\tSN:2\tLN:500", "@RG\tID:a\tSM:s", "@RG\tID:b\tSM:s", "@PG\tID:a\tPN:x", "@PG\tID:other"]


def load(spark, tmp_path, name, rows, head=HEAD):
    p = tmp_path / name
    p.write_text("\n".join([*head, *rows]) + "\n")
    reads, h = sam.read(spark, str(p), "DROPMALFORMED")
    return reads.cache(), h


@pytest.fixture
def one(spark, tmp_path):
    rows = [f"r{i}\t{99 if i % 2 else 0}\t1\t{10 + 7 * i}\t60\t10M\t=\t{30 + 7 * i}\t30\tACGTACGTAC\tIIIIIIIIII\tRG:Z:{'ab'[i % 2]}" for i in range(8)]
    return load(spark, tmp_path, "one.sam", rows)


def test_split_by_read_group(spark, tmp_path, one):
    reads, head = one
    tools.splitBam(reads, head, str(tmp_path / "out"))
    assert {(r.rg, r.n) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("rg").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 4), ("b", 4)}
    h = spark.read.parquet(str(tmp_path / "out_headers"))
    assert {r.raw for r in h.filter("rg = 'a'").collect()} == {*HEAD[:4], HEAD[5]} and h.filter("rg = 'b'").count() == 4


def test_split_by_reference(spark, tmp_path, one):
    reads, head = one
    tools.splitChromosome(reads, sam.references(head), str(tmp_path / "chroms"))
    assert {str(r.ref_name) for r in spark.read.parquet(str(tmp_path / "chroms")).select("ref_name").distinct().collect()} == {"1"}


def test_merge_in_regions(spark, tmp_path, one):
    reads, head = one
    other, head2 = load(spark, tmp_path, "two.sam", ["x\t0\t1\t12\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII", "u\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII"])
    out, h = tools.mergeBam([(reads, head), (other, head2)])
    names = [r.read_name for r in out.collect()]
    assert names[:3] == ["r0", "x", "r1"] and names[-1] == "u" and h.count() == len(HEAD)
    some, _ = tools.mergeBam([(reads, head), (other, head2)], regions=["1:1-12", "1:20-20"], refs=sam.references(head))
    assert [r.read_name for r in some.collect()] == ["r0", "x", "x", "r1"]


def test_polish(spark, tmp_path, one):
    reads, head = one
    out, h = tools.polishBam(reads, head, RG="@RG\\tID:new\\tSM:s", CO=["@CO\\tdone"])
    assert out.filter(tg.value(F.col("tags"), "RG") == "new").count() == 8 and h.filter("raw = '@CO\tdone'").count() == 1
    with pytest.raises(ValueError):
        tools.polishBam(reads, head, checkSQ=True)


def test_recalibration_after_dedup_is_the_same_in_one_step(spark, one):
    reads, _ = one
    ref = spark.range(0, 1000).select(F.lit(0).alias("ref_id"), F.col("id").cast("int").alias("pos"), F.substring(F.lit("ACGT"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    both = tools.dedup(reads, force=True, recab={"refFile": ref})
    two = tools.recab(tools.dedup(reads, force=True), ref)
    rows = lambda df: sorted((r.rec_idx, r.flag, r.qual) for r in df.collect())
    assert rows(both) == rows(two) and both.columns == reads.columns
    assert tools.recab(reads, ref, fitModel=True, storeQualTag="OQ").filter("tags['OQ:Z'].v is not null").count() == 8


def test_write_region(spark, tmp_path, one):
    reads, _ = one
    names = spark.createDataFrame([("r1",), ("r3",)], "read_name string")
    assert tools.writeRegion(reads, refName="1", start=20, end=40).count() == 4
    assert tools.writeRegion(reads, rnFile=names, requiredFlags=64).count() == 2
    assert tools.writeRegion(reads, refID=-1).count() == 0
    bed = spark.createDataFrame([(0, 20, 40)], "ref_id int, start0 int, end0_excl int")
    assert tools.writeRegion(reads, bed=bed, withinReg=True).count() == 2
    with pytest.raises(ValueError):
        tools.writeRegion(reads, refName="1", refID=0)


def test_fastq_files(spark, tmp_path, one):
    reads, _ = one
    tools.bam2FastQ(reads, splitRG=True, outBase=str(tmp_path / "fq"), gzip=True)
    got = spark.read.text(str(tmp_path / "fq"))
    assert got.count() == 32 and {r.rg for r in got.select("rg").distinct().collect()} == {"a", "b"}
    assert tools.bam2FastQ(reads, region="1:9:A").count() == 1 and tools.bam2FastQ(reads, region="1:9:C").count() == 0
