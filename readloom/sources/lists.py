"""Small text inputs: regions, sites, names, manifests, sequences, indexes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _columns(lines: DataFrame, pattern: str = "\t"):
    return lines.withColumn("_p", F.split(F.trim("value"), pattern))


def regions(spark: SparkSession, path: str, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, rejected) from three tab-separated columns or more; ends exclude their base, an end of -1 is the reference's.

    A line whose numbers aren't whole, whose start isn't before its end, or whose reference is unknown is rejected.
    """
    d = _columns(spark.read.text(path).filter(F.trim("value") != ""))
    at = lambda i: F.try_element_at("_p", F.lit(i))
    d = d.select("value", at(1).alias("name"), at(2).try_cast("int").alias("start0"), at(3).try_cast("int").alias("_e")).join(refs.withColumnRenamed("name", "_n"), F.col("name") == F.col("_n"), "left")
    d = d.withColumn("end0_excl", F.when(F.col("_e") == -1, F.col("length")).otherwise(F.col("_e")))
    ok = F.coalesce(F.col("ref_id").isNotNull() & (F.col("start0") < F.col("end0_excl")), F.lit(False))
    return d.filter(ok).select("ref_id", "start0", "end0_excl"), d.filter(~ok).select("value")


def bed(spark: SparkSession, path: str, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, rejected) of exactly three columns, in rising order of start for each reference; an unknown name is tried without 'chr'."""
    d = _columns(spark.read.text(path).filter(F.trim("value") != "").withColumn("_i", F.monotonically_increasing_id()))
    at = lambda i: F.try_element_at("_p", F.lit(i))
    d = d.select("_i", "value", F.size("_p").alias("_n"), at(1).alias("_name"), at(2).try_cast("int").alias("start0"), at(3).try_cast("int").alias("end0_excl"))
    one, two = refs.select(F.col("name").alias("_a"), F.col("ref_id").alias("_ia")), refs.select(F.col("name").alias("_b"), F.col("ref_id").alias("_ib"))
    d = d.join(one, F.col("_name") == F.col("_a"), "left").join(two, F.regexp_replace("_name", "^chr", "") == F.col("_b"), "left").withColumn("ref_id", F.coalesce("_ia", "_ib"))
    ok = F.coalesce((F.col("_n") == 3) & F.col("ref_id").isNotNull() & (F.col("start0") < F.col("end0_excl")), F.lit(False))
    good = d.filter(ok).withColumn("_before", F.max("start0").over(Window.partitionBy("ref_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)))
    sorted_ = F.coalesce(F.col("_before") <= F.col("start0"), F.lit(True))
    return good.filter(sorted_).select("ref_id", "start0", "end0_excl"), d.filter(~ok).select("value").unionByName(good.filter(~sorted_).select("value"))


def sites(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """ref_id, pos0 of lines with a name and a number; blank lines, comments and unknown names are skipped."""
    d = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("_p")).filter(F.size("_p") >= 2)
    return d.select(F.col("_p")[0].alias("name"), F.col("_p")[1].try_cast("int").alias("pos0")).join(refs, "name").filter("pos0 is not null").select("ref_id", "pos0").distinct()


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names between commas, spaces, tabs and line ends."""
    return spark.read.text(path).select(F.explode(F.split("value", r"[,\s]+")).alias("read_name")).filter("read_name <> ''").distinct()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header line; BAM, ID and SM must be there, and every line must have as many columns."""
    df = spark.read.option("mode", "FAILFAST").csv(path, sep="\t", header=True, enforceSchema=False)
    lacking = {"BAM", "ID", "SM"} - set(df.columns)
    if lacking:
        raise ValueError(f"the manifest has no column {', '.join(sorted(lacking))}")
    return df


def fasta(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """name, length, md5 (of the upper-case bases) and bases of each sequence; with ``chunk`` in pieces: name, chunk_no, bases.

    A sequence is put together by its line numbers, so it may span any number of the scan's splits.
    """
    d = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_i"), F.input_file_name().alias("_f"))
    heads = d.filter(F.col("value").startswith(">")).select("_i", F.split(F.substring("value", 2, 1 << 20), r"\s+")[0].alias("name"))
    marked = d.join(heads, "_i", "left")
    run = Window.partitionBy("_f").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    body = marked.withColumn("name", F.last("name", ignorenulls=True).over(run)).filter(~F.col("value").startswith(">") & F.col("name").isNotNull())
    s = body.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.trim("value").alias("v")))), lambda x: x["v"]), "").alias("bases"))
    s = heads.select("name").join(s, "name", "left").withColumn("bases", F.coalesce("bases", F.lit("")))
    if chunk:
        n = F.greatest(F.ceil(F.length("bases") / chunk), F.lit(1)).cast("int")
        return s.select("name", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"), "bases").select("name", "chunk_no", F.substring("bases", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("bases"))
    return s.select("name", F.length("bases").alias("length"), F.md5(F.upper("bases")).alias("md5"), "bases")


def read_reference(sequences: DataFrame, name: str, start0: int, *, end0: int | None = None, bases: int | None = None) -> str:
    """A stretch of one sequence; an unknown name is an error."""
    if (end0 is None) == (bases is None):
        raise ValueError("give either an end or a number of bases")
    n = bases if bases is not None else end0 - start0
    got = sequences.filter(F.col("name") == name).select(F.substring("bases", start0 + 1, n)).first()
    if got is None:
        raise ValueError(f"no sequence named {name}")
    return got[0]


def region(text: str) -> tuple[str, int, int | None]:
    """(name, start0, end or None) of 'name[:start[-end]]' with 1-based inclusive numbers."""
    name, _, rest = text.partition(":")
    if not rest:
        return name, 0, None
    first, dash, last = rest.partition("-")
    try:
        start, end = int(first) - 1, int(last) if dash else None
    except ValueError:
        raise ValueError(f"region {text!r}: positions must be whole numbers") from None
    if start < 0 or (end is not None and end <= start):
        raise ValueError(f"region {text!r}: the end must not be before the start, and that not before 1")
    return name, start, end


def bai(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, n_bins, n_chunks, n_linear, mapped, unmapped of each reference of BAM indexes (null counts where the index has none)."""

    def decode(content: bytes) -> list[tuple]:
        if content[:4] != b"BAI\x01":
            raise ValueError("not a BAM index")
        (refs,), at, out = struct.unpack_from("<i", content, 4), 8, []
        for ref in range(refs):
            (bins,), at = struct.unpack_from("<i", content, at), at + 4
            real = chunks = 0
            mapped = unmapped = None
            for _ in range(bins):
                number, n = struct.unpack_from("<Ii", content, at)
                at += 8
                if number == 37450:
                    mapped, unmapped = struct.unpack_from("<QQ", content, at + 16)
                else:
                    real, chunks = real + 1, chunks + n
                at += 16 * n
            (linear,), at = struct.unpack_from("<i", content, at), at + 4 
            at += 8 * linear
            out.append((ref, real, chunks, linear, mapped, unmapped))
        return out

    def run(parts):
        for pdf in parts:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in decode(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "ref_id", "n_bins", "n_chunks", "n_linear", "mapped", "unmapped"]).astype({"mapped": "Int64", "unmapped": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ref_id int, n_bins int, n_chunks int, n_linear int, mapped long, unmapped long")
