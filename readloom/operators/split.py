"""Outputs split by a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bases as bs
from ..functions import flags as fl
from . import mates

UNKNOWN = "UnknownChrom"


def by_reference(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """With ref_name, UnknownChrom for none."""
    return reads.join(refs.select("ref_id", "name"), "ref_id", "left").withColumn("ref_name", F.coalesce("name", F.lit(UNKNOWN))).drop("name")


def check_groups(reads: DataFrame, groups: DataFrame, rg: str = "rg") -> DataFrame:
    """``reads``; reading a record without a known read group raises."""
    known = groups.select(F.col("id").alias("_g")).distinct()
    bad = F.when(F.col("_g").isNull(), F.raise_error(F.concat(F.lit("record without a known read group: "), F.coalesce(F.col("read_name"), F.lit("?")))))
    joined = reads.join(known, F.col(rg) == F.col("_g"), "left")
    return joined.withColumn(rg, F.coalesce(bad.cast("string"), F.col(rg))).drop("_g")


def write_by(df: DataFrame, path: str, *keys: str, fmt: str = "parquet") -> None:
    """One folder for each key value; rows are dealt by key and a salt first, so files are few and no key is in one task alone.

    The salt is a hash of the row, so a task that runs again deals its rows alike. Maps can't be hashed and don't count.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(16)).cast("int"))
    salted.repartition(*keys, "_salt").drop("_salt").write.partitionBy(*keys).mode("overwrite").format(fmt).save(path)


def _one_sided(reads: DataFrame) -> DataFrame:
    """Roles of pairs in which only the earlier record's mate position is the later record's place."""
    side = lambda t: reads.select(*[F.col(c).alias(f"{c}{t}") for c in ("rec_idx", "read_name", "flag", "ref_id", "pos0", "mate_ref_id", "mate_pos0")])
    a, b = side("1"), side("2")
    on = (F.col("read_name1") == F.col("read_name2")) & (F.col("mate_ref_id1") == F.col("ref_id2")) & (F.col("mate_pos01") == F.col("pos02")) & (F.col("rec_idx1") < F.col("rec_idx2"))
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("rec_idx1", "rec_idx2")) == 1
    p = a.join(b, on).withColumn("_a", first("rec_idx1")).withColumn("_b", first("rec_idx2")).filter("_a and _b")
    one, two = fl.has(F.col("flag1"), fl.FIRST), fl.has(F.col("flag2"), fl.FIRST)
    first_is_1 = F.when(one == two, ~one).otherwise(one)
    role = lambda i, when: F.struct(F.col(f"rec_idx{i}").alias("rec_idx"), F.when(when, "first").otherwise("second").alias("role"))
    return p.select(F.explode(F.array(role(1, first_is_1), role(2, ~first_is_1))).alias("x")).select("x.*")


def fastq(reads: DataFrame, *, by_name: bool = False, first_ext: str = "/1", second_ext: str = "/2", rn_plus: bool = False, reverse_comp: bool = True, excluded: int = 0x900) -> DataFrame:
    """rec_idx, rg (if there), role (first, second, single) and the four-line text of each primary record.

    The fragment bits give a pair's roles. Where both mates have the first bit, the later is first; where neither has, the
    earlier. Paired records without their mate, and unpaired ones, are single.
    """
    own = reads.filter(~fl.has(F.col("flag"), excluded))
    paired = own.filter(fl.has(F.col("flag"), fl.PAIRED))
    pairs = (mates.by_adjacency if by_name else mates.by_coordinate)(paired, ["flag"])
    one, two = fl.has(F.col("flag1"), fl.FIRST), fl.has(F.col("flag2"), fl.FIRST)
    first_is_1 = F.when(one == two, ~one).otherwise(one)
    roles = pairs.select(F.explode(F.array(F.struct(F.col("rec_idx1").alias("rec_idx"), F.when(first_is_1, "first").otherwise("second").alias("role")), F.struct(F.col("rec_idx2").alias("rec_idx"), F.when(first_is_1, "second").otherwise("first").alias("role")))).alias("x")).select("x.*")
    if not by_name:
        roles = roles.unionByName(_one_sided(paired.join(roles, "rec_idx", "left_anti")))
    out = own.join(roles, "rec_idx", "left").withColumn("role", F.coalesce("role", F.lit("single")))
    back = fl.has(F.col("flag"), fl.REVERSE) if reverse_comp else F.lit(False)
    seq = F.when(back, bs.reverse_complement(F.col("seq"))).otherwise(F.upper("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    name = F.concat(F.col("read_name"), F.when(F.col("role") == "first", first_ext).when(F.col("role") == "second", second_ext).otherwise(""))
    text = F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+"), name if rn_plus else F.lit(""), F.lit("\n"), qual)
    return out.select("rec_idx", *[c for c in ("rg",) if c in reads.columns], "role", text.alias("fastq"))


def fastq_manifest(entries: DataFrame, base: str) -> DataFrame:
    """merge_name, fastq1, fastq2, rg: the files of each read group."""
    has = lambda r: F.max(F.col("role") == r)
    name = lambda part: F.concat(F.lit(base + "."), F.col("rg"), F.lit(part))
    g = entries.groupBy("rg").agg(has("first").alias("_p"), has("single").alias("_s"))
    rows = F.array_compact(F.array(F.when(F.col("_p"), F.struct(name("_1.fastq").alias("fastq1"), name("_2.fastq").alias("fastq2"))), F.when(F.col("_s"), F.struct(name(".fastq").alias("fastq1"), F.lit(".").alias("fastq2")))))
    return g.select("rg", F.explode(rows).alias("x")).select(F.lit(base).alias("merge_name"), "x.fastq1", "x.fastq2", "rg")
