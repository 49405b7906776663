"""SAM text as DataFrames: a distributed scan by byte ranges, header tables and an ordered sink.

The scan reads lines with Spark's text reader, so any store that Spark reads will do and files are split over tasks. ``rec_idx``
rises with the order of the scan's splits and of the lines in them; write the records to a table before joining by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tags as tg

FIELDS = ("read_name", "flag", "ref_name", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "insert_size", "seq", "qual")


def header(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), type, id, tags (map), raw. Headers are few lines at the top."""
    return header_of(spark.read.text(path))


def header_of(lines: DataFrame, order: Column | None = None) -> DataFrame:
    """The header of lines (column value) in the order of the scan or of ``order``."""
    h = lines.filter(F.col("value").startswith("@")).select("value", (order if order is not None else F.monotonically_increasing_id()).alias("_i"))
    parts = F.split("value", "\t")
    pairs = F.filter(F.slice(parts, 2, 1000), lambda x: F.substring(x, 3, 1) == ":")
    # A repeated key keeps its last value.
    kept = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, 1000), lambda y: F.substring(y, 1, 2) == F.substring(x, 1, 2)))
    tags = F.map_from_entries(F.transform(kept, lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(4), F.length(x)))))
    kind = F.substring(parts[0], 2, 2)
    h = h.select((F.row_number().over(Window.orderBy("_i")) - 1).alias("line_no"), kind.alias("type"), F.when(kind == "CO", F.create_map().cast("map<string,string>")).otherwise(tags).alias("tags"), F.col("value").alias("raw"))
    key = F.when(F.col("type") == "SQ", F.col("tags")["SN"]).otherwise(F.col("tags")["ID"])
    return h.select("line_no", "type", key.alias("id"), "tags", "raw")


def references(head: DataFrame) -> DataFrame:
    """ref_id (from 0, in header order), name, length."""
    sq = head.filter("type = 'SQ'")
    return sq.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("ref_id"), F.col("tags")["SN"].alias("name"), F.col("tags")["LN"].cast("int").alias("length"))


def read_groups(head: DataFrame) -> DataFrame:
    """id, library, sample, lib_id: libraries numbered from 1 by first sight; 0 if there is one at most. At most 255."""
    rg = head.filter("type = 'RG'").select("line_no", "id", F.col("tags")["LB"].alias("library"), F.col("tags")["SM"].alias("sample"))
    first = rg.filter("library is not null").groupBy("library").agg(F.min("line_no").alias("_at"))
    ids = first.withColumn("lib_id", F.row_number().over(Window.orderBy("_at")))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ids = ids.withColumn("lib_id", F.when(n > 255, F.raise_error(F.lit("more than 255 libraries"))).when(n <= 1, 0).otherwise(F.col("lib_id"))).drop("_at")
    return rg.join(ids, "library", "left").select("id", "library", "sample", F.coalesce("lib_id", F.lit(0)).cast("int").alias("lib_id"))


def parse(lines: DataFrame, refs: DataFrame | None = None, *, order: Column | None = None) -> DataFrame:
    """Records from lines (column value): the fixed columns, 0-based positions (-1 none), tags, and ref ids by name.

    A line that isn't a record has its text in _corrupt_record and nulls elsewhere.
    """
    body = lines.filter(~F.col("value").startswith("@") & (F.length(F.trim("value")) > 0))
    p = F.split("value", "\t")
    number = lambda i: p[i].try_cast("int") if hasattr(Column, "try_cast") else p[i].cast("int")
    ok = (F.size(p) >= 11) & number(1).isNotNull() & number(3).isNotNull() & number(4).isNotNull() & number(7).isNotNull() & number(8).isNotNull()
    ok = ok & F.forall(F.slice(p, 12, 10000), tg.well_formed)
    pick = lambda c: F.when(F.col("_ok"), c)
    r = body.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("rec_idx", order if order is not None else F.monotonically_increasing_id())
    mate = F.when(p[6] == "=", p[2]).otherwise(p[6])
    r = r.select(
        "rec_idx", pick(p[0]).alias("read_name"), pick(number(1)).alias("flag"), pick(p[2]).alias("ref_name"), pick(number(3) - 1).alias("pos0"), pick(number(4)).alias("mapq"), pick(p[5]).alias("cigar"),
        pick(mate).alias("mate_ref_name"), pick(number(7) - 1).alias("mate_pos0"), pick(number(8)).alias("insert_size"), pick(p[9]).alias("seq"), pick(p[10]).alias("qual"), pick(tg.parse(F.slice(p, 12, 10000))).alias("tags"), F.when(~F.col("_ok"), F.col("value")).alias("_corrupt_record"),
    )
    if refs is None:
        return r
    ids = refs.select(F.col("name").alias("_n"), F.col("ref_id").alias("_i"))
    r = r.join(ids.withColumnsRenamed({"_n": "_n1", "_i": "_i1"}), F.col("ref_name") == F.col("_n1"), "left").join(ids.withColumnsRenamed({"_n": "_n2", "_i": "_i2"}), F.col("mate_ref_name") == F.col("_n2"), "left")
    return r.withColumns({"ref_id": F.coalesce("_i1", F.lit(-1)), "mate_ref_id": F.coalesce("_i2", F.lit(-1))}).drop("_n1", "_i1", "_n2", "_i2")


def read(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """(records, header) of a SAM text file. Modes as in Spark's readers: PERMISSIVE, DROPMALFORMED, FAILFAST."""
    head = header(spark, path)
    r = parse(spark.read.text(path), references(head))
    if mode == "DROPMALFORMED":
        r = r.filter("_corrupt_record is null")
    elif mode == "FAILFAST":
        r = r.withColumn("read_name", F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("not a record: "), F.col("_corrupt_record")))).otherwise(F.col("read_name")))
    return r, head


def usable(reads: DataFrame, recover: bool) -> DataFrame:
    """Records without those lines that aren't one; unless ``recover``, such a line is an error."""
    if "_corrupt_record" not in reads.columns:
        return reads
    if recover:
        return reads.filter("_corrupt_record is null")
    fault = F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("not a record (recover leaves it out): "), F.col("_corrupt_record"))))
    return reads.withColumn("read_name", F.coalesce(fault.cast("string"), F.col("read_name")))


def lines(reads: DataFrame) -> DataFrame:
    """rec_idx, value: records as SAM text with tags by name."""
    mate = F.when((F.col("mate_ref_name") == F.col("ref_name")) & (F.col("ref_name") != "*"), "=").otherwise(F.col("mate_ref_name"))
    fixed = ["read_name", F.col("flag").cast("string"), "ref_name", (F.col("pos0") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", mate, (F.col("mate_pos0") + 1).cast("string"), F.col("insert_size").cast("string"), "seq", "qual"]
    tags = tg.text(F.col("tags"))
    return reads.select("rec_idx", F.concat_ws("\t", *fixed, F.when(tags != "", tags)).alias("value"))


def write(reads: DataFrame, head: DataFrame, path: str, single: bool = False) -> None:
    """SAM text in record order; the header is a file of its own that sorts first. ``single`` makes one file of it all."""
    top = head.select(F.col("line_no").cast("long").alias("_k"), F.lit(0).alias("_b"), F.col("raw").alias("value"))
    body = lines(reads).select(F.col("rec_idx").alias("_k"), F.lit(1).alias("_b"), "value")
    both = top.unionByName(body)
    out = both.coalesce(1).sortWithinPartitions("_b", "_k") if single else both.repartitionByRange("_b", "_k").sortWithinPartitions("_b", "_k")
    out.select("value").write.mode("overwrite").text(path)


def edit_header(head: DataFrame, add: list[str], *, checks: dict[str, tuple[int, str]] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Append lines (a literal backslash-t is a tab; HD and RG at most once) and, with ``checks`` (name to length and md5), complete SQ lines."""
    spark = head.sparkSession
    made = [x.replace("\\t", "\t") for x in add]
    for x in made:
        if not x.startswith(("@HD", "@RG", "@PG", "@CO")):
            raise ValueError(f"not a header line of a kind that can be added: {x!r}")
    for kind in ("@HD", "@RG"):
        if sum(x.startswith(kind) for x in made) > 1:
            raise ValueError(f"more than one {kind} line")
    n = head.agg(F.max("line_no")).first()[0]
    base = 0 if n is None else n + 1
    new = spark.createDataFrame([(base + i, x[1:3], x) for i, x in enumerate(made)], "line_no int, type string, raw string")
    out = head.select("line_no", "type", "id", "raw")
    if checks is not None:
        c = spark.createDataFrame([(k, v[0], v[1]) for k, v in checks.items()], "_n string, _len int, _md5 string")
        j = out.join(c, (F.col("type") == "SQ") & (F.col("id") == F.col("_n")), "left")
        length = F.regexp_extract("raw", "\tLN:([0-9]+)", 1).cast("int")
        wrong = F.when(F.col("_n").isNotNull() & (length != F.col("_len")), F.raise_error(F.concat(F.lit("length of sequence differs: "), F.col("id"))))
        added = F.concat(F.col("raw"), F.when(~F.col("raw").contains("\tM5:"), F.concat(F.lit("\tM5:"), F.col("_md5"))).otherwise(""), *[F.when(~F.col("raw").contains(f"\t{k}:"), F.lit(f"\t{k}:{v}")).otherwise("") for k, v in (extra or {}).items()])
        out = j.withColumn("raw", F.coalesce(wrong.cast("string"), F.when(F.col("_n").isNotNull(), added).otherwise(F.col("raw")))).select("line_no", "type", "id", "raw")
    ids = F.regexp_extract("raw", "\tID:([^\t]*)", 1)
    return out.unionByName(new.select("line_no", "type", F.when(ids != "", ids).alias("id"), "raw"))
