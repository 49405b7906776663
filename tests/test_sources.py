import struct

import pytest
from pyspark.sql import functions as F

from readloom import tools
from readloom.functions import tags as tg
from readloom.sources import datasource, lists, sam

HEAD = ["@HD\tVN:1.4\tSO:coordinate", "@SQ\tSN:1\tLN:1000", "@SQ\tSN:2\tLN:500", "@RG\tID:a\tSM:s\tLB:l1", "@RG\tID:b\tSM:s\tLB:l2", "@CO\tfree text"]
BODY = ["r1\t99\t1\t11\t60\t10M\t=\t31\t30\tACGTACGTAC\tIIIIIIIIII\tRG:Z:a\tNM:i:0", "r1\t147\t1\t31\t60\t10M\t=\t11\t-30\tACGTACGTAC\tIIIIIIIIII\tRG:Z:b", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*"]


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "in.sam"
    p.write_text("\n".join([*HEAD, *BODY, "broken\tline"]) + "\n")
    return str(p)


def test_read(spark, path):
    reads, head = sam.read(spark, path)
    got = {r.rec_idx: r for r in reads.collect()}
    rows = [got[k] for k in sorted(got)]
    assert [r.read_name for r in rows] == ["r1", "r1", "r2", None]
    assert rows[0].pos0 == 10 and rows[0].ref_id == 0 and rows[1].mate_ref_name == "1" and rows[2].ref_id == -1 and rows[2].pos0 == -1
    assert rows[3]._corrupt_record == "broken\tline"
    assert [(r.ref_id, r.name, r.length) for r in sam.references(head).orderBy("ref_id").collect()] == [(0, "1", 1000), (1, "2", 500)]
    assert {(r.id, r.lib_id) for r in sam.read_groups(head).collect()} == {("a", 1), ("b", 2)}
    assert sam.read(spark, path, "DROPMALFORMED")[0].count() == 3
    with pytest.raises(Exception, match="not a record"):
        sam.read(spark, path, "FAILFAST")[0].collect()


def test_round_trip(spark, path, tmp_path):
    reads, head = sam.read(spark, path, "DROPMALFORMED")
    out = str(tmp_path / "out")
    sam.write(reads, head, out, single=True)
    got = [r.value for r in spark.read.text(out).collect()]
    assert got == [*HEAD, BODY[0].replace("RG:Z:a\tNM:i:0", "NM:i:0\tRG:Z:a"), *BODY[1:]]


def test_data_source_splits(spark, tmp_path):
    p = tmp_path / "x.sam"
    lines = [f"r{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tX0:i:{i}" for i in range(500)]
    p.write_text("\n".join([*HEAD, *lines]) + "\n")
    datasource.register(spark)
    df = spark.read.format("sam").option("path", str(p)).option("splitBytes", 1000).load()
    assert df.rdd.getNumPartitions() > 5
    assert [r.read_name for r in df.orderBy("rec_idx").collect()] == [f"r{i}" for i in range(500)]


def test_header_edit(spark, path):
    head = sam.header(spark, path)
    new = sam.edit_header(head, ["@PG\\tID:p", "@CO\\tmore"], checks={"1": (1000, "abc")}, extra={"AS": "b37"})
    raw = [r.raw for r in new.orderBy("line_no").collect()]
    assert raw[1] == "@SQ\tSN:1\tLN:1000\tM5:abc\tAS:b37" and raw[-2:] == ["@PG\tID:p", "@CO\tmore"]
    with pytest.raises(ValueError):
        sam.edit_header(head, ["@XX\\tID:p"])
    with pytest.raises(Exception, match="differs"):
        sam.edit_header(head, [], checks={"1": (7, "abc")}).collect()


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([(0, "1", 1000), (1, "2", 500)], "ref_id int, name string, length int")


def write(tmp_path, text):
    p = tmp_path / "list.txt"
    p.write_text(text)
    return str(p)


def test_regions(spark, tmp_path, refs):
    good, bad = lists.regions(spark, write(tmp_path, "1\t5\t10\n1\tx\t9\n2\t9\t9\n2\t400\t-1\nq\t1\t2\n"), refs)
    assert sorted(map(tuple, good.collect())) == [(0, 5, 10), (1, 400, 500)] and bad.count() == 3
    good, bad = lists.bed(spark, write(tmp_path, "chr1\t5\t10\n1\t4\t9\n1\t8\t9\textra\n2\t1\t2\n"), refs)
    assert sorted(map(tuple, good.collect())) == [(0, 5, 10), (1, 1, 2)] and bad.count() == 2


def test_small_lists(spark, tmp_path, refs):
    assert sorted(map(tuple, lists.sites(spark, write(tmp_path, "#c\n\n1 5\n2\t7 x\nz 1\n1\n"), refs).collect())) == [(0, 5), (1, 7)]
    assert {r[0] for r in lists.read_names(spark, write(tmp_path, "a,b c\n\td\n")).collect()} == set("abcd")
    assert lists.manifest(spark, write(tmp_path, "BAM\tID\tSM\nf\ti\ts\n")).first().BAM == "f"
    with pytest.raises(ValueError):
        lists.manifest(spark, write(tmp_path, "BAM\tID\nf\ti\n"))
    assert lists.region("1:5-9") == ("1", 4, 9) and lists.region("x") == ("x", 0, None) and lists.region("1:7") == ("1", 6, None)
    for wrong in ("1:a-9", "1:9-5", "1:0-5"):
        with pytest.raises(ValueError):
            lists.region(wrong)


def test_fasta(spark, tmp_path):
    p = write(tmp_path, ">one first\nACgt\nAC\n>two\n>three\nN\n")
    got = {r.name: r for r in lists.fasta(spark, p).collect()}
    import hashlib

    assert got["one"].length == 6 and got["one"].md5 == hashlib.md5(b"ACGTAC").hexdigest() and got["two"].bases == "" and got["three"].bases == "N"
    assert lists.read_reference(lists.fasta(spark, p), "one", 1, bases=3) == "Cgt"
    assert sorted(map(tuple, lists.fasta(spark, p, 4).filter("name = 'one'").collect())) == [("one", 0, "ACgt"), ("one", 1, "AC")]
    with pytest.raises(ValueError):
        lists.read_reference(lists.fasta(spark, p), "nope", 0, bases=1)


def test_index(spark, tmp_path):
    one = struct.pack("<i", 2) + struct.pack("<Ii", 5, 1) + struct.pack("<QQ", 1, 2) + struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, 8, 3) + struct.pack("<i", 1) + struct.pack("<Q", 9)
    (tmp_path / "x.bai").write_bytes(b"BAI\x01" + struct.pack("<i", 2) + one + struct.pack("<ii", 0, 0))
    got = tools.dumpIndex(spark, str(tmp_path / "x.bai")).orderBy("ref_id").drop("path").collect()
    assert tuple(got[0]) == (0, 1, 1, 1, 8, 3) and tuple(got[1])[:4] == (1, 0, 0, 0) and got[1].mapped is None


def test_tag_column(spark, path):
    reads, _ = sam.read(spark, path, "DROPMALFORMED")
    assert [r.g for r in reads.orderBy("rec_idx").select(tg.value(F.col("tags"), "RG").alias("g")).collect()] == ["a", "b", None]


def test_summary_sink_and_errors(spark, tmp_path):
    from readloom.sources import log

    counts = spark.createDataFrame([(3, None, 0.5)], "total long, missing long, rate double")
    log.write_summary(counts, str(tmp_path / "log"), "Run")
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["Run", "total\t3", "missing\t", "rate\t0.5"]
    with pytest.raises(log.ToolError) as e:
        log.error("bad input", 7)
    assert e.value.status == 7
