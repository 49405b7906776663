"""Alignment-shaped views of the star-schema tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..operators.ordering import number_rows

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
HEX = "0123456789abcdef"
BASES, QUALS = "ACGTACGTACGTACGN", "#%()+-/13579;=?A"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates for every two lineitem rows; the formulas are those of the SQL below."""
    items = table(spark, sf_dir, "lineitem").select(*ORDER)
    numbered = number_rows(items, F.floor(F.col("l_orderkey") / 65536), ORDER, "n").select("n")
    v = numbered.select("n", F.floor((F.col("n") - 1) / 2).cast("long").alias("p"), ((F.col("n") - 1) % 2).cast("int").alias("k"))
    v = v.withColumn("s1", ((F.col("p") * 37) % 41) * 25).withColumn("s2", F.col("s1") + ((F.col("p") * 13) % 6) * 12 - 36)
    v = v.withColumn("h", F.md5(F.concat(F.lit("q"), F.col("n").cast("string"))))
    p, k = F.col("p"), F.col("k")
    flag = 1 + F.when(p % 3 == 0, 2).otherwise(0) + 16 * k + 32 * (1 - k) + 64 * (1 - k) + 128 * k + F.when(p % 29 == 0, F.when(k == 1, 4).otherwise(8)).otherwise(0) + F.when(p % 31 == 0, 512).otherwise(0) + F.when(p % 41 == 0, 1024).otherwise(0)
    cigar = F.element_at(F.array(*[F.lit(c) for c in ("20M", "3S17M", "10M2D10M", "8M1I11M")]), (p % 4 + 1).cast("int"))
    here = lambda first: 50 + F.when((k == 0) if first else (k == 1), F.col("s1")).otherwise(F.col("s2"))
    return v.select(
        F.col("n").alias("rec_idx"), F.concat(F.lit("r"), p.cast("string")).alias("read_name"), flag.cast("int").alias("flag"), (p % 5).cast("int").alias("ref_id"), (p % 5).cast("int").alias("mate_ref_id"),
        here(True).cast("int").alias("pos0"), here(False).cast("int").alias("mate_pos0"), F.when(p % 53 == 0, 255).otherwise(p % 61).cast("int").alias("mapq"), cigar.alias("cigar"),
        F.translate(F.substring("h", 1, 20), HEX, BASES).alias("seq"), F.translate(F.substring("h", 11, 20), HEX, QUALS).alias("qual"), F.concat(F.lit("rg"), (p % 3).cast("string")).alias("rg"),
    )


def with_ends(r: DataFrame) -> DataFrame:
    return r.withColumn("end0", cg.align_end(F.col("pos0"), F.col("cigar")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("region_no"), (F.col("p_partkey") % 5).cast("int").alias("ref_id"), (F.col("p_size") * 15).cast("int").alias("start0"), (F.col("p_size") * 15 + 25).cast("int").alias("end0_excl"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") % 5).cast("int").alias("ref_id"), ((F.col("s_suppkey") * 71) % 1000).cast("int").alias("pos0")).distinct()


#: A made-up reference: base number i of reference r.
def ref_base(ref_id, pos):
    return F.substring(F.lit("ACGT"), ((pos * 7 + ref_id * 3 + F.floor(pos / 5)) % 4 + 1).cast("int"), F.lit(1))


SQL_BASE = "substr('ACGT', CAST(({pos} * 7 + {ref} * 3 + CAST(floor({pos} / 5) AS BIGINT)) % 4 + 1 AS INTEGER), 1)"

SQL = f"""
n0 AS (SELECT row_number() OVER (ORDER BY {', '.join(ORDER)}) AS n FROM lineitem),
n1 AS (SELECT n, CAST(floor((n - 1) / 2) AS BIGINT) AS p, CAST((n - 1) % 2 AS INTEGER) AS k FROM n0),
n2 AS (SELECT *, ((p * 37) % 41) * 25 AS s1, md5(concat('q', CAST(n AS VARCHAR))) AS h FROM n1),
n3 AS (SELECT *, s1 + ((p * 13) % 6) * 12 - 36 AS s2 FROM n2),
r AS (SELECT n AS rec_idx, concat('r', CAST(p AS VARCHAR)) AS read_name,
  CAST(1 + CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END + 16 * k + 32 * (1 - k) + 64 * (1 - k) + 128 * k
    + CASE WHEN p % 29 = 0 THEN CASE WHEN k = 1 THEN 4 ELSE 8 END ELSE 0 END + CASE WHEN p % 31 = 0 THEN 512 ELSE 0 END + CASE WHEN p % 41 = 0 THEN 1024 ELSE 0 END AS INTEGER) AS flag,
  CAST(p % 5 AS INTEGER) AS ref_id, CAST(p % 5 AS INTEGER) AS mate_ref_id,
  CAST(50 + CASE WHEN k = 0 THEN s1 ELSE s2 END AS INTEGER) AS pos0, CAST(50 + CASE WHEN k = 0 THEN s2 ELSE s1 END AS INTEGER) AS mate_pos0,
  CAST(CASE WHEN p % 53 = 0 THEN 255 ELSE p % 61 END AS INTEGER) AS mapq,
  CASE p % 4 WHEN 0 THEN '20M' WHEN 1 THEN '3S17M' WHEN 2 THEN '10M2D10M' ELSE '8M1I11M' END AS cigar,
  translate(substr(h, 1, 20), '{HEX}', '{BASES}') AS seq, translate(substr(h, 11, 20), '{HEX}', '{QUALS}') AS qual,
  concat('rg', CAST(p % 3 AS VARCHAR)) AS rg,
  CAST(50 + CASE WHEN k = 0 THEN s1 ELSE s2 END + CASE p % 4 WHEN 0 THEN 19 WHEN 1 THEN 16 WHEN 2 THEN 21 ELSE 18 END AS INTEGER) AS end0,
  CASE WHEN p % 4 = 1 THEN 3 ELSE 0 END AS lead FROM n3),
regions AS (SELECT p_partkey AS region_no, CAST(p_partkey % 5 AS INTEGER) AS ref_id, CAST(p_size * 15 AS INTEGER) AS start0, CAST(p_size * 15 + 25 AS INTEGER) AS end0_excl FROM part),
sites AS (SELECT DISTINCT CAST(s_suppkey % 5 AS INTEGER) AS ref_id, CAST((s_suppkey * 71) % 1000 AS INTEGER) AS pos0 FROM supplier)"""


def sql(select: str, *more: str) -> str:
    """A query over r (reads), regions and sites, with further CTEs before it."""
    return "WITH " + ",\n".join([SQL, *more]) + "\n" + select
