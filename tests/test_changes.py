import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom import tools
from readloom.functions import cigar as cg
from readloom.functions import tags as tg
from readloom.operators import recab, rewrite
from readloom.sources import bam, sam

from . import test_bam
from .test_tools import HEAD, load


def md_by_walk(cigar, seq, ref):
    """MD by walking the operations."""
    import re

    out, run, q, r = "", 0, 0, 0
    for n, o in re.findall("([0-9]+)([MIDS])", cigar):
        for i in range(int(n)):
            if o == "M":
                if seq[q] == ref[r]:
                    run += 1
                else:
                    out, run = out + str(run) + ref[r], 0
            if o == "D":
                out, run = out + (f"{run}^" if i == 0 else "") + ref[r], 0
            q += o in "MIS"
            r += o in "MD"
    return out + str(run)


def test_md_and_its_validation(spark):
    import random

    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("AC") for _ in range(n))
    rows = [(i, c, base(10), base(12)) for i, c in enumerate(["10M", "3S7M", "4M2D6M", "4M1I5M", "2M1D3M1D5M"] * 8)]
    got = {r.i: r.md for r in spark.createDataFrame(rows, "i int, cigar string, seq string, ref string").select("i", cg.md(F.col("cigar"), F.col("seq"), F.col("ref")).alias("md")).collect()}
    assert got == {i: md_by_walk(c, s, r) for i, c, s, r in rows}
    ref = spark.createDataFrame([(0, "ACGTACGTACGT")], "ref_id int, bases string")
    names = "rec_idx long, read_name string, flag int, ref_id int, pos0 int, mapq int, cigar string, seq string, qual string, md string"
    data = [(0, "a", 0, 0, 1, 9, "4M", "CGTA", "IIII", "4"), (1, "b", 0, 0, 1, 9, "4M", "CGTA", "IIII", "2A1"), (2, "c", 4, 0, 1, 9, "4M", "CGTA", "IIII", "1"), (3, "d", 0, 0, 1, 9, "4M", "CGTA", "IIII", None)]
    reads = spark.createDataFrame(data, names).withColumn("tags", tg.put(F.create_map().cast(tg.TYPE), "MD", "Z", F.col("md"))).drop("md")
    assert [(r.rec_idx, r.error) for r in tools.validate(reads, refFile=ref).collect()] == [(1, "INVALID_MD")]


def test_lines_that_are_no_records(spark, tmp_path):
    tail = "\t1\t5\t9\t4M\t*\t0\t0\tACGT\tIIII"
    rows = ["fine\t0" + tail, "short\t0", "flag\tx" + tail, "tag\t0" + tail + "\t*", "good\t0" + tail + "\tNM:i:1"]
    p = tmp_path / "bad.sam"
    p.write_text("\n".join(["@HD\tVN:1\tSO:coordinate", *HEAD[1:], *rows]) + "\n")
    reads, head = sam.read(spark, str(p))
    assert sorted(r.error for r in tools.validate(reads).collect()) == ["INVALID_TAG_FORMAT", "NOT_AN_INTEGER", "TOO_FEW_COLUMNS"]
    assert tools.validate(reads, so_flag=True, head=head).filter("error = 'SORT_ORDER'").count() == 0
    assert sorted(r.read_name for r in tools.convert(reads, recover=True).collect()) == ["fine", "good"]
    with pytest.raises(Exception, match="recover leaves it out"):
        tools.convert(reads).collect()
    with pytest.raises(ValueError):
        tools.convert(reads, useBases=True, useOrigSeq=True)


def test_damaged_bam(spark, tmp_path):
    reads = test_bam.records(spark)
    (path,) = bam.write(reads.coalesce(1).sortWithinPartitions("rec_idx"), test_bam.TEXT, test_bam.REFS, str(tmp_path))
    whole = {r.rec_idx: r.read_name for r in bam.read(spark, path)[0].collect()}
    blocks = sorted({i >> 16 for i in whole})
    assert len(blocks) > 2
    data = bytearray(open(path, "rb").read())
    data[blocks[1] + 200] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        bam.read(spark, path)[0].collect()
    for splits in (None, [i for i in whole if i >> 16 == blocks[1]][:1]):
        got = {r.rec_idx: r.read_name for r in bam.read(spark, path, recover=True, splits=splits)[0].collect()}
        # All but the records of the damaged block, and the one that reaches into or out of it.
        assert got.items() <= whole.items()
        assert {i >> 16 for i in whole.keys() - got.keys()} <= {blocks[0], blocks[1], blocks[2]}
        assert sum(i >> 16 != blocks[1] for i in whole.keys() - got.keys()) <= 2


def test_reference_in_chunks(spark, monkeypatch):
    """Reads over a chunk's border, past the end, before the start, and on another sequence."""
    monkeypatch.setattr(rewrite, "CHUNK", 8)
    bases = "ACGTTGCAAC" * 4
    ref = spark.createDataFrame([(0, bases), (1, "TTTT")], "ref_id int, bases string")
    rows = [(p, 0, p, "5M") for p in range(0, 36)] + [(100, 0, 38, "5M"), (101, 1, 0, "4M"), (102, 2, 0, "5M"), (103, 0, -1, "5M")]
    got = {r.rec_idx: r["_ref"] for r in rewrite.with_reference(spark.createDataFrame(rows, "rec_idx long, ref_id int, pos0 int, cigar string"), ref).collect()}
    assert all(got[p] == bases[p : p + 5] for p in range(36))
    assert (got[100], got[101], got[102], got[103]) == ("AC", "TTTT", None, None)


def test_regression_against_numpy(spark):
    """Newton's method on the collected cells, and the blended quality by its formula."""
    rng = np.random.default_rng(4)
    cells = [("a", int(q), int(c), bool(c % 2), "ACGTK"[c % 5], "ACGT"[q % 4], int(rng.integers(50, 400)), int(rng.integers(1, 40))) for q in range(5, 25) for c in range(8)]
    df = spark.createDataFrame(cells, "rg string, qual int, cycle int, second boolean, prev string, cur string, matches long, mismatches long")
    x = np.array([[1, q, c, s, "ACGTK".index(p), "ACGT".index(u)] for _, q, c, s, p, u, _, _ in cells], float)
    m, y = np.array([r[6] for r in cells], float), np.array([r[7] for r in cells], float)
    w = np.zeros(6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * ((m + y) * p * (1 - p))) @ x, x.T @ (y - (m + y) * p))
        w += step
        if np.abs(step).sum() < 1e-6:
            break
    fit = recab.logistic_fit(df)
    assert np.allclose(fit["weights"], w, atol=1e-6)
    got = df.select(recab.predicted_quality(fit["weights"]).alias("q"), recab.predicted_quality(fit["weights"], 1).alias("b")).collect()
    rate = 1 / (1 + np.exp(-x @ w))
    assert [r.q for r in got] == np.floor(-10 * np.log10(rate) + 0.5).astype(int).tolist()
    logit = y / (m + y) * (1 - x @ w) / 2
    assert [r.b for r in got] == np.floor(-10 * np.log10(1 / (1 + np.exp(logit))) + 0.5).astype(int).tolist()
    with pytest.raises(ValueError):
        recab.predicted_quality(fit["weights"], 9999)


def test_low_memory_dedup_builds_from_first_reads(spark, tmp_path):
    rows = [f"r{i}\t0\t1\t{10 + i // 3}\t60\t10M\t*\t0\t0\tACGTACGTAC\t{'5I+'[i % 3] * 10}\tRG:Z:a" for i in range(12)]
    reads, _ = load(spark, tmp_path, "low.sam", rows)
    ref = spark.range(0, 1000).select(F.lit(0).alias("ref_id"), F.col("id").cast("int").alias("pos"), F.substring(F.lit("ACGT"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    plain, low = (f(reads, force=True, recab={"refFile": ref}) for f in (tools.dedup, tools.dedup_LowMem))
    rows = lambda df: {r.rec_idx: (r.flag, r.qual) for r in df.collect()}
    a, b, before = rows(plain), rows(low), rows(reads)
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()} and sum(v[0] & 1024 > 0 for v in a.values()) == 8
    # The best of each place ('I') builds dedup's table, the first ('5') that of the other; only those qualities change.
    changed = lambda x: {before[k][1][0] for k in x if x[k][1] != before[k][1]}
    assert (changed(a), changed(b)) == ({"I"}, {"5"})
