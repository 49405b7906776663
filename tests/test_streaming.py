import pandas as pd
from pyspark.sql import functions as F

from readloom.plans.reads import table
from readloom.streaming import batch, streams

from .conftest import DATA


def stream(spark, tmp_path):
    e = table(spark, f"{DATA}/sf0.001", "events").orderBy("ts")
    folder = str(tmp_path / "in")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(folder)
    # A last event far ahead moves the watermark past all others.
    late = e.limit(1).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).withColumn("user_id", F.lit(-1).cast("long"))
    late.write.mode("append").parquet(folder)
    return e, streams.source(spark, folder, e.schema)


def test_tumbling_equals_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    streams.run(streams.tumbling(s, ["event_type"], "ts", "400 days", "1 hour"), out, ck)
    want = e.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()
    got = spark.read.parquet(out).collect()
    assert {(r.bucket, r.event_type, r.n_events) for r in got if r.bucket.year < 2029} == {(r.bucket, r.event_type, r.n) for r in want}


def test_first_within(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    streams.run(streams.first_within(s, ["user_id", "event_type"], "ts", "3650 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("user_id >= 0").count()
    assert got == e.select("user_id", "event_type").distinct().count()


def test_match_equals_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    two = streams.source(spark, str(tmp_path / "in"), e.schema)
    m = streams.match(s.select("event_id", "user_id", "ts"), two.select("event_id", "user_id", "ts"), "user_id", "ts", "1 hour", 3600, "inner")
    streams.run(m, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("l_user_id >= 0")
    d = e.select("event_id", "user_id", "ts")
    want = batch.match_within(d, d, "user_id", "ts", 3600).count()
    assert got.count() == want


def test_two_pass(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    seen = []
    streams.two_pass(s, lambda df, epoch: seen.append(df.count()), str(tmp_path / "ck"))
    assert sum(seen) == e.count() + 1


def test_best_row_logic():
    from pyspark.sql.types import LongType, StructField, StructType

    class State:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class Handle:
        def __init__(self):
            self.timers = []

        def getValueState(self, *_):  # noqa: N802
            return State()

        def registerTimer(self, t):  # noqa: N802
            self.timers.append(t)

    class Times:
        getCurrentWatermarkInMs = lambda self: 100

    schema = StructType([StructField("k", LongType()), StructField("v", LongType())])
    p, h = streams._Best("v", ["k", "v"], schema, 50), Handle()
    p.init(h)
    list(p.handleInputRows(1, iter([pd.DataFrame({"k": [1, 1], "v": [3, 7]})]), Times()))
    list(p.handleInputRows(1, iter([pd.DataFrame({"k": [1], "v": [5]})]), Times()))
    (out,) = p.handleExpiredTimer(1, Times(), None)
    assert h.timers == [150] and out.v.tolist() == [7]
