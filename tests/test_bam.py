import struct

import pytest
from pyspark.sql import functions as F

from readloom import tools
from readloom.operators import diff, recab
from readloom.sources import bam, sam

TEXT = "@SQ\tSN:1\tLN:1000\n@SQ\tSN:2\tLN:500\n"
REFS = [("1", 1000), ("2", 500)]


def records(spark, n=3000):
    lines = [f"r{i}\t{99 if i % 2 else 147}\t{1 + i % 2}\t{1 + i % 400}\t{i % 61}\t3S{5 + i % 4}M2D4M\t=\t{1 + i % 300}\t{i - 50}\t{('ACGTN=' * 4)[: 12 + i % 4]}\t{'I' * (12 + i % 4)}\tNM:i:{i}\tXA:A:c\tXF:f:0.5\tXB:B:s,1,-2\tRG:Z:g{i % 3}" for i in range(n)]
    lines.append("u\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*")
    refs = spark.createDataFrame([(0, "1", 1000), (1, "2", 500)], "ref_id int, name string, length int")
    df = spark.createDataFrame(list(enumerate(lines)), "i long, value string")
    return sam.parse(df, refs, order=F.col("i")).drop("_corrupt_record")


def test_round_trip(spark, tmp_path):
    reads = records(spark)
    paths = bam.write(reads.repartitionByRange(3, "rec_idx").sortWithinPartitions("rec_idx"), TEXT, REFS, str(tmp_path))
    want = [r.value for r in sam.lines(reads).orderBy("rec_idx").collect()]
    got = []
    for p in paths:
        back, text, refs = bam.read(spark, p)
        assert text == TEXT and refs.count() == 2
        got += [r.value for r in bam.to_sam(back).orderBy("rec_idx").collect()]
    assert got == want


def test_stretches(spark, tmp_path):
    reads = records(spark)
    (path,) = bam.write(reads.coalesce(1).sortWithinPartitions("rec_idx"), TEXT, REFS, str(tmp_path))
    whole = bam.read(spark, path)[0]
    offsets = [r.rec_idx for r in whole.orderBy("rec_idx").collect()]
    assert len({o >> 16 for o in offsets}) > 2
    cut = bam.read(spark, path, splits=offsets[500::700])[0]
    assert cut.rdd.getNumPartitions() > 3 and sorted(r.rec_idx for r in cut.collect()) == offsets
    # The same from an index with one bin of chunks.
    chunks = b"".join(struct.pack("<QQ", o, o) for o in offsets[::900])
    index = b"BAI\x01" + struct.pack("<i", 1) + struct.pack("<i", 1) + struct.pack("<Ii", 1, len(offsets[::900])) + chunks + struct.pack("<i", 0)
    assert bam.starts(index, 1) and set(bam.starts(index, 1)) <= set(offsets)
    (tmp_path / "x.bai").write_bytes(index)
    assert bam.read(spark, path, index=str(tmp_path / "x.bai"))[0].count() == len(offsets)


def test_cut_off_file(spark, tmp_path):
    (path,) = bam.write(records(spark, 50).coalesce(1), TEXT, REFS, str(tmp_path))
    data = open(path, "rb").read()
    open(path, "wb").write(data[: -len(bam.EOF)])
    with pytest.raises(ValueError, match="closing block"):
        bam.read(spark, path)
    assert bam.read(spark, path, require_eof=False)[0].count() == 51
    open(path, "wb").write(b"no such file" * 10)
    with pytest.raises(ValueError):
        bam.read(spark, path, require_eof=False)


def test_tagged_differences(spark):
    a = records(spark, 6)
    b = a.filter("read_name <> 'r1'").withColumn("mapq", F.when(F.col("read_name") == "r2", 7).otherwise(F.col("mapq")))
    got = diff.tagged(a, b, tools.diff(a, b, mapQual=True))
    assert [r.read_name for r in got["only1"].collect()] == ["r1"] and got["only2"].count() == 0
    (r,) = got["changed"].collect()
    assert r.read_name == "r2" and r.tags["ZM:i"].v == "7" and "ZP:Z" not in r.tags


def test_model_lines():
    lines = recab.model_lines({"weights": [1.0] * 6, "covariance": [[4.0 if i == j else 0.0 for j in range(6)] for i in range(6)]})
    assert lines[0] == "intercept\t1\t4\t2" and len(lines) == 6
