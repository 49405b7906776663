import random
import re

import pytest
from pyspark.sql import functions as F

from readloom import tools
from readloom.functions import cigar as cg
from readloom.functions import tags as tg
from readloom.operators import dedup, diff, intervals, mates, merge, ordering, overlap, pileup, recab, rewrite, split, stats, validate

COLUMNS = "rec_idx long, read_name string, flag int, ref_id int, pos0 int, mapq int, cigar string, mate_ref_id int, mate_pos0 int, seq string, qual string"


def make(spark, rows):
    """Rows of (name, flag, ref, pos, cigar, mate_ref, mate_pos, qual char)."""
    out = []
    for i, (n, f, r, p, c, mr, mp, q) in enumerate(rows):
        k = sum(a for a, o in cg.parse(c) if o in cg.QUERY_OPS) or 10
        out.append((i, n, f, r, p, 60, c, mr, mp, "ACGTTGCAAC"[: k % 11] if k < 10 else ("ACGTTGCAAC" * 9)[:k], q * k))
    return spark.createDataFrame(out, COLUMNS)


def random_reads(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n // 2):
        a, b = rng.randrange(0, 60), rng.randrange(0, 60)
        lib = rng.choice("abc")
        ca, cb = rng.choice(["10M", "2S8M", "8M2S", "5M1D5M"]), rng.choice(["10M", "3S7M", "7M3S"])
        fa = 1 | 64 | rng.choice([0, 16]) | (8 if rng.random() < 0.1 else 0)
        fb = 1 | 128 | rng.choice([0, 16]) | (4 if fa & 8 else 0)
        q = chr(33 + rng.randrange(10, 40))
        rows.append((f"{lib}{i}", fa, 0, a, ca, 0, b, q))
        if rng.random() < 0.9:
            rows.append((f"{lib}{i}", fb, 0, b, cb, 0, a, chr(33 + rng.randrange(10, 40))))
        if rng.random() < 0.2:
            rows.append((f"u{i}", rng.choice([0, 16]), 0, rng.randrange(0, 60), "10M", -1, -1, q))
    rng.shuffle(rows)
    return make(spark, rows)


def brute_dedup(rows):
    """One pass over the records in Python: keys, pairs and bests by dictionaries."""
    fragments, pairs, dup = {}, {}, set()
    waiting = {}
    for r in rows:
        if r.flag & 0xB04:
            continue
        parts = cg.parse(r.cigar)
        lead = parts[0][0] if parts[0][1] == "S" else 0
        trail = parts[-1][0] if parts[-1][1] == "S" else 0
        end = r.pos0 + sum(n for n, o in parts if o in cg.REF_OPS) - 1
        key = (r.ref_id, end + trail if r.flag & 16 else r.pos0 - lead, bool(r.flag & 16))
        q = sum(ord(c) - 33 for c in r.qual if ord(c) >= 48)
        paired = bool(r.flag & 1) and not r.flag & 8
        fragments.setdefault(key, []).append((paired, q, r.rec_idx))
        if paired:
            at, to = (r.read_name, r.ref_id, r.pos0, r.mate_ref_id, r.mate_pos0), (r.read_name, r.mate_ref_id, r.mate_pos0, r.ref_id, r.pos0)
            if waiting.get(to):
                k2, q2, i2 = waiting[to].pop(0)
                lead = i2 if k2[:2] < key[:2] else r.rec_idx if key[:2] < k2[:2] else min(i2, r.rec_idx)
                pairs.setdefault(tuple(sorted((key, k2))), []).append((-(q + q2), lead, min(i2, r.rec_idx), max(i2, r.rec_idx)))
            else:
                waiting.setdefault(at, []).append((key, q, r.rec_idx))
    for own in fragments.values():
        lone = sorted((-q, i) for p, q, i in own if not p)
        dup |= {i for _, i in (lone if any(p for p, _, _ in own) else lone[1:])}
    for own in pairs.values():
        dup |= {i for *_, a, b in sorted(own)[1:] for i in (a, b)}
    return dup


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup_equals_one_pass(spark, seed):
    reads = random_reads(spark, seed=seed)
    want = brute_dedup(reads.orderBy("rec_idx").collect())
    marked = dedup.mark(reads)
    assert {r.rec_idx for r in marked.filter("(flag & 1024) <> 0").collect()} == want and len(want) > 20
    assert dedup.mark(reads, remove=True).count() == reads.count() - len(want)


def test_dedup_arguments(spark):
    reads = random_reads(spark, 20)
    with pytest.raises(ValueError):
        dedup.mark(reads, excluded=0x4)
    with pytest.raises(Exception, match="marked as duplicate"):
        dedup.mark(reads.withColumn("flag", F.col("flag").bitwiseOR(F.lit(1024))), force=False).collect()


def test_mates_with_equal_keys(spark):
    reads = make(spark, [("a", 65, 0, 5, "10M", 0, 5, "I")] * 4 + [("b", 65, 0, 5, "10M", 0, 9, "I"), ("b", 129, 0, 9, "10M", 0, 5, "I")])
    assert sorted((r.rec_idx1, r.rec_idx2) for r in mates.by_coordinate(reads, []).collect()) == [(0, 1), (2, 3), (4, 5)]
    assert sorted((r.rec_idx1, r.rec_idx2) for r in mates.by_adjacency(reads, []).collect()) == [(0, 1), (2, 3), (4, 5)]


def test_missing_mate(spark):
    reads = make(spark, [("a", 65, 0, 5, "10M", 0, 9, "I"), ("b", 65, 0, 5, "10M", 0, 9, "I"), ("b", 129, 0, 9, "10M", 0, 5, "I")])
    assert [r.rec_idx for r in mates.missing(reads).collect()] == [0]


@pytest.mark.parametrize("contained", [False, True])
def test_intervals_equal_nested_loops(spark, contained):
    rng = random.Random(3)
    r = [(i, rng.randrange(2), s := rng.randrange(1000), s + rng.randrange(1, 300)) for i in range(200)]
    g = [(i, rng.randrange(2), s := rng.randrange(1000), s + rng.randrange(0, 200)) for i in range(30)]
    reads = spark.createDataFrame(r, "rec_idx int, ref_id int, pos0 int, end0 int")
    regions = spark.createDataFrame(g, "region_no int, ref_id int, start0 int, end0_excl int")
    want = sorted((a[0], b[0]) for a in r for b in g if a[1] == b[1] and b[3] > b[2] and ((a[2] >= b[2] and a[3] < b[3]) if contained else (a[2] < b[3] and a[3] >= b[2])))
    got = intervals.overlap_join(reads, regions, bin_size=37, contained=contained)
    assert sorted((x.rec_idx, x.region_no) for x in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x.rec_idx for x in intervals.semi_join(reads, regions, bin_size=37, contained=contained).collect()} == {a for a, _ in want}


def ran(node):
    """The nodes of a plan that has run."""
    yield node
    name = node.nodeName()
    below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    for x in below:
        yield from ran(x)


def joined_rows(df):
    """The most rows that a join of a DataFrame made, after collect()."""
    return max(n.metrics().apply("numOutputRows").value() for n in ran(df._jdf.queryExecution().executedPlan()) if n.nodeName().endswith("Join"))


@pytest.mark.parametrize("contained", [False, True])
@pytest.mark.parametrize("few", [0, 1 << 20])
def test_semi_join_makes_no_pairs(spark, monkeypatch, contained, few):
    monkeypatch.setattr(intervals, "FEW", few)
    rng = random.Random(7)
    r = [(i, rng.randrange(2), s := rng.randrange(1000), s + rng.randrange(1, 200)) for i in range(300)]
    spans = [(rng.randrange(2), s := rng.randrange(1000), s + rng.randrange(0, 300)) for _ in range(12)]
    reads = spark.createDataFrame(r, "rec_idx int, ref_id int, pos0 int, end0 int")
    regions = spark.createDataFrame([(i, *g) for i, g in enumerate(spans * 50)], "region_no int, ref_id int, start0 int, end0_excl int")
    got = intervals.semi_join(reads, regions, contained=contained)
    want = [a for a in r if any(a[1] == f and e > s and ((a[2] >= s and a[3] < e) if contained else (a[2] < e and a[3] >= s)) for f, s, e in spans)]
    assert sorted(map(tuple, got.collect())) == want and want
    assert joined_rows(got) <= len(r)


@pytest.mark.parametrize("contained", [False, True])
@pytest.mark.parametrize("columns", [["region_no"], ["region_no", "name"], []])
def test_equal_regions_meet_a_read_once(spark, monkeypatch, contained, columns):
    monkeypatch.setattr(intervals, "MEMBERS", 20)
    rng = random.Random(8)
    r = [(i, rng.randrange(2), s := rng.randrange(1000), s + rng.randrange(1, 200)) for i in range(200)]
    spans = [(rng.randrange(2), s := rng.randrange(1000), s + rng.randrange(0, 300)) for _ in range(8)]
    g = [(i if i % 7 else None, *x, f"n{i // 3}") for i, x in enumerate(spans * 50 + spans[:3])]
    reads = spark.createDataFrame(r, "rec_idx int, ref_id int, pos0 int, end0 int")
    regions = spark.createDataFrame(g, "region_no int, ref_id int, start0 int, end0_excl int, name string").select(*columns, "end0_excl", "start0", "ref_id")
    got = intervals.overlap_join(reads, regions, contained=contained)
    assert got.columns == [*reads.columns, *columns, "end0_excl", "start0"]
    pairs = [(a, dict(zip(("region_no", "ref_id", "start0", "end0_excl", "name"), b, strict=True))) for a in r for b in g if a[1] == b[1] and b[3] > b[2] and ((a[2] >= b[2] and a[3] < b[3]) if contained else (a[2] < b[3] and a[3] >= b[2]))]
    want = sorted(str((*a, *[b[c] for c in columns], b["end0_excl"], b["start0"])) for a, b in pairs)
    assert sorted(str(tuple(x)) for x in got.collect()) == want and want
    assert joined_rows(got) <= len(want) // 15


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_reads_are_not_shuffled_to_few_regions(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    reads = spark.range(1000).selectExpr("id AS rec_idx", "CAST(id % 3 AS int) AS ref_id", "CAST(id AS int) AS pos0", "CAST(id + id % 150 AS int) AS end0")
    regions = spark.range(200).selectExpr("id AS region_no", "CAST(id % 4 AS int) AS ref_id", "CAST(id % 9 * 100 AS int) AS start0", "CAST(id % 9 * 100 + 70 AS int) AS end0_excl")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = intervals.overlap_join(reads, regions)
        pairs = sorted((x.rec_idx, x.region_no) for x in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pairs == [(a, b) for a in range(1000) for b in range(200) if a % 3 == b % 4 and a < b % 9 * 100 + 70 and a + a % 150 >= b % 9 * 100]
    assert {n.nodeName() for n in ran(got._jdf.queryExecution().executedPlan()) if n.nodeName().endswith("Join")} == {"BroadcastHashJoin" if few else "SortMergeJoin"}


def test_row_numbers_and_runs(spark):
    rng = random.Random(4)
    v = [(rng.randrange(1000), rng.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame([(a, i, b) for i, (a, b) in enumerate(v)], "a int, i int, b int")
    got = ordering.number_rows(df, F.floor(F.col("a") / 100), ["a", "i"], "n").collect()
    assert {(r.i, r.n) for r in got} == {(i, n) for n, (_, i) in enumerate(sorted((a, i) for i, (a, _) in enumerate(v)), 1)}
    seen = {}
    for i, (_, b) in enumerate(v):
        seen.setdefault(b, len(seen))
    assert {(r.b, r.new_id) for r in ordering.first_seen_ids(df, "b", "i", span=64).select("b", "new_id").distinct().collect()} == set(seen.items())


def test_diff(spark):
    a = make(spark, [("x", 65, 0, 5, "10M", 0, 9, "I"), ("y", 65, 0, 5, "10M", 0, 9, "I"), ("z", 65, 0, 5, "10M", 0, 9, "I"), ("z", 65, 0, 6, "10M", 0, 9, "I")])
    b = make(spark, [("x", 65, 0, 8, "10M", 0, 9, "I"), ("z", 65, 0, 5, "10M", 0, 9, "I"), ("w", 65, 0, 5, "10M", 0, 9, "I"), ("z", 65, 0, 200006, "10M", 0, 9, "I")])
    got = {(r.rec1, r.rec2, tuple(r.changed) if r.changed is not None else None) for r in tools.diff(a, b).collect()}
    assert got == {(0, 0, ("pos0",)), (1, None, None), (None, 2, None), (3, None, None), (None, 3, None)}
    assert [r.rec_idx for r in diff.only(a, b, [F.col("read_name")], "rec_idx").collect()] == [1]


def test_merge(spark):
    a = make(spark, [("a", 0, 0, 5, "10M", -1, -1, "I"), ("b", 16, 0, 9, "10M", -1, -1, "I"), ("u", 4, -1, -1, "*", -1, -1, "I")])
    b = make(spark, [("c", 0, 0, 9, "10M", -1, -1, "I"), ("d", 0, 0, 5, "10M", -1, -1, "I")])
    assert [r.read_name for r in merge.merge([a, b]).collect()] == ["a", "d", "c", "b", "u"]
    h = lambda rows: spark.createDataFrame(rows, "line_no int, type string, id string, raw string")
    one = h([(0, "HD", None, "@HD\tVN:1"), (1, "RG", "a", "@RG\tID:a\tPI:1"), (2, "PG", "p", "@PG\tID:p")])
    two = h([(0, "HD", None, "@HD\tVN:1"), (1, "RG", "a", "@RG\tID:a\tPI:2"), (2, "RG", "b", "@RG\tID:b"), (3, "PG", "p", "@PG\tID:p\tx")])
    assert {r.raw for r in merge.merge_headers([one, two], ignore_pi=True).collect()} == {"@HD\tVN:1", "@RG\tID:a\tPI:1", "@RG\tID:b"}
    with pytest.raises(Exception, match="differs between inputs"):
        merge.merge_headers([one, two]).collect()
    with pytest.raises(Exception, match="not in all inputs"):
        merge.merge_headers([one, two.filter("type <> 'HD'")], ignore_pi=True).collect()
    with pytest.raises(ValueError):
        tools.mergeBam([(a, one)])


def test_overlap_resolution():
    assert overlap.resolve("10M", 0, "5" * 10, False, "10M", 6, "I" * 10, True) == ("6M4S", 0, "10M", 6, 1, False)
    assert overlap.resolve("10M", 0, "I" * 10, False, "10M", 6, "5" * 10, True) == ("10M", 0, "4S6M", 10, 2, False)
    c1, p1, c2, p2, loser, whole = overlap.resolve("10M", 0, "I" * 10, True, "10M", 6, "5" * 10, False)
    assert (c2, loser, whole) == ("10S", 2, True) and (c1, p1) == ("6S4M", 6)
    # Complete overlaps: the loser is clipped where it is, between its hard clips.
    c = "3H3S3M3D3M3I3M3P3M3D3M3S3H"
    assert overlap.resolve(c, 9, "I" * 24, False, c, 9, "I" * 24, True)[:2] == ("3H24S3H", 9)
    assert overlap.resolve(c, 9, "I" * 24, False, c, 9, "5" * 24, True)[2:4] == ("3H24S3H", 9)
    assert overlap.resolve(c, 9, "I" * 24, False, c, 10, "I" * 24, True)[0] == "3H3S1M20S3H"


def test_overlap_clip_leaves_none(spark):
    reads = random_reads(spark, 200, 9)
    done = overlap.clip(reads)
    assert done.count() == reads.count()
    left = overlap.pairs(done.filter(~F.col("cigar").rlike("^[0-9]+S$")))
    wrong = left.filter(~(((F.col("flag1").bitwiseAND(16)) != 0) & (F.col("flag2").bitwiseAND(16) == 0)))
    assert wrong.count() == 0 and overlap.pairs(reads).count() > 10


def test_clip_and_trim(spark):
    reads = make(spark, [("a", 0, 0, 10, "10M", -1, -1, "I"), ("b", 16, 0, 10, "10M", -1, -1, "I"), ("c", 0, 0, 10, "4M", -1, -1, "I")])
    got = {r.read_name: (r.cigar, r.pos0, r.flag) for r in tools.trimBam(reads, left=3, right=1, clip=True).collect()}
    assert got == {"a": ("3S6M1S", 13, 0), "b": ("1S6M3S", 11, 16), "c": ("*", 10, 4)}
    got = {r.read_name: r.seq for r in tools.trimBam(reads, left=3, right=1).collect()}
    assert got["a"] == "NNNTTGCAAN" and got["b"] == "NCGTTGCNNN" and got["c"] == "NNNN"


def test_filter_mismatches(spark):
    ref = spark.createDataFrame([(0, "ACGTACGTACGTACGTACGT")], "ref_id int, bases string")
    rows = [(0, "same", 0, 0, 0, 60, "10M", -1, -1, "ACGTACGTAC", "I" * 10), (1, "ends", 0, 0, 0, 60, "10M", -1, -1, "TTGTACGTAC", "I" * 10), (2, "all", 0, 0, 0, 60, "10M", -1, -1, "TGCATGCATG", "I" * 10)]
    got = {r.read_name: (r.cigar, r.pos0, r.flag) for r in tools.filter(spark.createDataFrame(rows, COLUMNS), ref).collect()}
    assert got == {"same": ("10M", 0, 0), "ends": ("2S8M", 2, 0), "all": ("*", 0, 4)}


def test_revert_and_squeeze(spark):
    reads = make(spark, [("a", 0, 0, 10, "10M", -1, -1, "I"), ("b", 1024, 0, 10, "10M", -1, -1, "I"), ("a", 0, 0, 12, "10M", -1, -1, "I")])
    reads = reads.withColumn("tags", tg.parse(F.array(*[F.lit(x) for x in ("OC:Z:5S5M", "OP:i:3", "OQ:Z:JJJJJJJJJJ", "XX:i:1")])))
    r = tools.revert(reads, cigar=True, qual=True, rmTags="XX:i").filter("rec_idx = 0").first()
    assert (r.cigar, r.pos0, r.qual, dict(r.tags)) == ("5S5M", 2, "J" * 10, {})
    out, names = tools.squeeze(reads, readName=True, binQualS=[10, 30], rmTags="XX")
    assert [(x.read_name, x.qual[0]) for x in out.orderBy("rec_idx").collect()] == [("0", "?"), ("0", "?")] and [tuple(x) for x in names.collect()] == [("a", 0)]
    out, _ = tools.squeeze(reads, sReadName=True, keepDups=True)
    assert [x.read_name for x in out.orderBy("rec_idx").collect()] == ["0", "1", "2"]


def test_equals_and_bases(spark):
    ref = spark.createDataFrame([(0, "AACGTTGCAAC")], "ref_id int, bases string")
    reads = make(spark, [("a", 0, 0, 1, "10M", -1, -1, "I")])
    eq = tools.convert(reads, useEquals=True, refFile=ref)
    assert eq.first().seq == "=" * 10 and tools.convert(eq, useBases=True, refFile=ref).first().seq == "ACGTTGCAAC"


def test_fastq_roles(spark):
    reads = make(spark, [("a", 1 | 128, 0, 5, "10M", 0, 9, "I"), ("a", 1 | 64 | 16, 0, 9, "10M", 0, 5, "I"), ("b", 1, 0, 5, "10M", 0, 9, "I"), ("b", 1, 0, 9, "10M", 0, 5, "I"), ("c", 1 | 64, 0, 5, "10M", 0, 9, "I"), ("c", 1 | 64, 0, 9, "10M", 0, 5, "I"), ("d", 1 | 64, 0, 5, "10M", 0, 9, "I"), ("e", 0x100, 0, 5, "10M", -1, -1, "I")])
    got = {r.rec_idx: (r.role, r.fastq) for r in split.fastq(reads).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "second", 1: "first", 2: "first", 3: "second", 4: "second", 5: "first", 6: "single"}
    assert got[1][1] == "@a/1\nGTTGCAACGT\n+\nIIIIIIIIII"


def test_validation(spark):
    reads = make(spark, [("a", 0, 0, 5, "10M", -1, -1, "I"), ("b c", 70000, 9, 2, "9Q", -1, -1, "I"), ("c", 0, -1, -1, "10M", -1, -1, "I")])
    got = {(r.rec_idx, r.error) for r in tools.validate(reads, refs=2, so_coord=True).collect()}
    assert {(1, "INVALID_NAME"), (1, "INVALID_FLAG"), (1, "UNKNOWN_REF"), (1, "INVALID_CIGAR"), (2, "MAPPED_WITHOUT_REF")} <= got
    assert (0, "SORT_ORDER") not in got
    many = spark.range(0, 1000).select(F.col("id").alias("rec_idx"), F.lit(0).alias("ref_id"), ((F.col("id") * 7) % 100).cast("int").alias("pos0"))
    want = [i for i in range(1, 1000) if (i * 7) % 100 < ((i - 1) * 7) % 100]
    assert sorted(r.rec_idx for r in validate.unsorted(many, span=64).collect()) == want


def test_pileup_by_hand(spark):
    reads = make(spark, [("a", 1 | 2, 0, 10, "3M2D2M", -1, -1, "I"), ("b", 1024, 0, 11, "4M", -1, -1, "!"), ("c", 0, 0, 12, "2S2M", -1, -1, "!")])
    got = {r.pos: r for r in pileup.qc(reads).collect()}
    assert sorted(got) == [10, 11, 12, 13, 14, 15, 16]
    assert (got[12].total_reads, got[12].dups, got[12].mapped, got[12].depth, got[12].q20_bases) == (3, 1, 2, 2, 1)
    assert (got[13].total_reads, got[13].depth) == (3, 1) and got[16].depth == 1
    inside = spark.createDataFrame([(0, 12, 14)], "ref_id int, start0 int, end0_excl int")
    assert sorted(r.pos for r in pileup.qc(reads, regions=inside).collect()) == [12, 13]


def test_split_by_group(spark, tmp_path):
    reads = make(spark, [("a", 0, 0, 5, "10M", -1, -1, "I"), ("b", 0, 0, 5, "10M", -1, -1, "I")]).withColumn("rg", F.when(F.col("read_name") == "a", "x").otherwise("y"))
    split.write_by(reads, str(tmp_path / "o"), "rg")
    assert {r.rg for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {"x", "y"}
    with pytest.raises(Exception, match="without a known read group"):
        split.check_groups(reads, spark.createDataFrame([("x",)], "id string")).collect()


def test_empty_input(spark):
    reads = make(spark, []).withColumn("rg", F.lit("a"))
    assert dedup.mark(reads).count() == 0 and overlap.clip(reads).count() == 0 and pileup.qc(reads).count() == 0
    assert stats.basic(reads).first().total_reads == 0 and rewrite.clip(reads, 1, 1).count() == 0
    assert split.fastq(reads).count() == 0 and validate.unsorted(reads).count() == 0


def test_tools(spark):
    reads = random_reads(spark, 60)
    assert tools.writeRegion(reads, refID=0, start=20, end=30).count() > 0
    assert tools.findCigars(reads, csoftClip=True).filter("cigar = '10M'").count() == 0
    with pytest.raises(ValueError):
        tools.findCigars(reads)
    assert set(tools.stats(reads, basic=True, qual=True, cBaseQC=True, baseSum=True)) == {"basic", "qual", "cBaseQC", "baseSum"}
    assert tools.explainFlags("0x63")[0] == "paired" and tools.gapInfo(reads, detailed=True).columns[0] == "rec_idx"


def test_recalibration_in_place_equals_the_join(spark, monkeypatch):
    """Reverse reads, unknown letters and groups, several cigars, reads over a chunk's border, and a table that is too large to hold."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(60):
        cigar = rng.choice(["12M", "2S10M", "5M1I6M", "4M3D8M", "3M2N9M", "*"])
        seq = "".join(rng.choice("ACGTACGTNacg") for _ in range(12))
        qual = "*" if i % 13 == 0 else "".join(chr(33 + rng.choice([2, 5, 20, 30, 41])) for _ in range(12 if i % 11 else 9))
        rows.append((i, rng.choice([0, 16, 1 + 64, 1 + 128 + 16, 4]), 0 if i % 9 else -1, 1015 + i % 12, rng.choice([0, 60, 255, 30]), cigar, seq, qual, rng.choice(["a", "b", None])))
    reads = spark.createDataFrame(rows, "rec_idx long, flag int, ref_id int, pos0 int, mapq int, cigar string, seq string, qual string, rg string")
    bases = {p: "ACGTN"[(p * 7) % 5] for p in range(1000, 1060)}
    ref = spark.createDataFrame([(0, p, c) for p, c in bases.items()], "ref_id int, pos int, base string")
    sites = spark.createDataFrame([(0, 1020), (0, 1024), (0, 1025)], "ref_id int, pos0 int")
    cells = recab.covariates(reads, ref, sites=sites).cache()

    def brute():
        out, comp = {}, dict(zip("ACGT", "TGCA"))
        for _, flag, ref_id, pos, mapq, cigar, seq, qual, rg in rows:
            if flag & 0xF04 or mapq in (0, 255) or ref_id < 0 or len(seq) != len(qual):
                continue
            off = []
            at = 0
            for n, op in re.findall(r"(\d+)([MIDNS])", cigar):
                for _ in range(int(n)):
                    if op in "MIS":
                        off.append(at if op == "M" else None)
                    if op in "MDN":
                        at += 1
            off += [None] * (len(seq) - len(off))
            b = [(comp.get(c, c) if flag & 16 else c, ord(q) - 33, o) for c, q, o in zip(seq.upper(), qual, off)]
            b = b[::-1] if flag & 16 else b
            for i, (c, q, o) in enumerate(b):
                if o is None or q < 5 or c not in comp or bases.get(pos + o, "N") == "N" or pos + o in (1020, 1024, 1025):
                    continue
                prev = b[i - 1] if i else ("K", 0, None)
                if i and (prev[0] not in comp or prev[2] is None or abs(prev[2] - o) != 1 or pos + prev[2] in (1020, 1024, 1025)):
                    continue
                r = comp[bases[pos + o]] if flag & 16 else bases[pos + o]
                cell = out.setdefault((rg, q, i, bool(flag & 128), prev[0], c), [0, 0])
                cell[r != c] += 1
        return out

    assert {(r.rg, r.qual, r.cycle, r.second, r.prev, r.cur): [r.matches, r.mismatches] for r in cells.collect()} == brute() and cells.count() > 10
    held = sorted(map(tuple, recab.apply(reads, cells).select("rec_idx", "qual").collect()))
    monkeypatch.setattr(recab, "DENSE", 1)
    assert sorted(map(tuple, recab.apply(reads, cells).select("rec_idx", "qual").collect())) == held
    assert recab.apply(reads.limit(0), cells).count() == 0 and recab.covariates(reads.limit(0), ref).count() == 0
    assert [r.qual for r in recab.apply(reads, cells.limit(0)).orderBy("rec_idx").collect()] == [r[7] for r in rows]


def test_overlap_counts_by_strand(spark):
    rows = [(1, "p", 1 + 64 + 32, 0, 10, 0, 15, "10M", "ACGTACGTAC", "IIIIIIIIII"), (2, "p", 1 + 128 + 16, 0, 15, 0, 10, "10M", "ACGTACGTAC", "##########"), (3, "q", 1 + 64 + 16, 0, 30, 0, 32, "10M", "ACGTACGTAC", "##########"), (4, "q", 1 + 128 + 32, 0, 32, 0, 30, "10M", "ACGTACGTAC", "IIIIIIIIII"), (5, "z", 1 + 64, 0, 50, 0, 52, "10M", "ACGTACGTAC", "IIIIIIIIII")]
    reads = spark.createDataFrame([(*r[:8], 60, *r[8:]) for r in rows], "rec_idx long, read_name string, flag int, ref_id int, pos0 int, mate_ref_id int, mate_pos0 int, cigar string, mapq int, seq string, qual string")
    assert overlap.clip_counts(reads).first().asDict() == {"n_orientation": 1, "n_forward_clipped": 0, "n_reverse_clipped": 2, "n_missing_mates": 1}
