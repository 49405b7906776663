"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset on one machine (as in tests), a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/readloom-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and any executor can read it again.

    The table's path is the attribute ``kept_at`` of the result; pass it to ``drop`` once nothing reads it any more.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(spark: SparkSession, *tables) -> None:
    """Delete kept tables (or paths)."""
    for t in tables:
        path = t if isinstance(t, str) else t.kept_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def share(spark: SparkSession, thing):
    """A function that gives each task its own copy of ``thing``, which the caller has checked to be of a bounded size.

    It is broadcast as bytes that hold its class too, so executors need no installed copy of this package.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(held.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *taken: str) -> tuple[DataFrame, list[str]]:
    """``df`` under the column names p0, p1, ..., which no operator uses for itself, and its own names.

    Columns named like one in ``taken`` (the operator's results, in any case) give way to that.
    """
    used = {t.lower() for t in taken}
    names = [c for c in df.columns if c.lower() not in used]
    return df.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(names)]), names


def unpacked(names: list[str], but: dict | None = None) -> list:
    """The columns that ``packed`` renamed, under their own names, or others in place of some."""
    return [((but or {}).get(c, F.col(f"p{i}"))).alias(c) for i, c in enumerate(names)]


def smallest(df: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    """Up to ``n`` rows with the least values of the hash ``key`` (64 bits, signed).

    Of many rows only those in the low end of the hash's range, about twice ``n``, are ordered, so what meets in one task
    doesn't grow with the rows or their partitions.
    """
    rows = df.count()
    bound = min(-(1 << 63) + int((1 << 64) * (2 * n + 50) / max(rows, 1)), (1 << 63) - 1)
    low = df.filter(F.col(key) <= F.lit(bound))
    # Where many rows share a hash, the low end may hold fewer than asked for; then all of them are ordered.
    return (low if low.count() >= n else df).orderBy(key, *ties).limit(n)


def crc_fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds
