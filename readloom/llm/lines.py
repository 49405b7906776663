"""Line dedup: repeated runs of lines, found with a suffix array over line numbers (operator 3). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: A run of lines is a copy if it holds this many words.
MIN_WORDS = 50
WORD = "[^\\x20\\x09-\\x0D]+"
DOC = ["_d", "_t"]


def _ranked(keys: DataFrame, by: list[str], name: str, rank: str) -> DataFrame:
    """Distinct rows with a number that rises with their order: range partitions in order, and the place in each."""
    return store.keep(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(rank, F.monotonically_increasing_id()), name)


def _doc_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_d (the id, nulls last) and _t (a hash of the text): the order of documents, and what joins them."""
    last = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1))
    return docs.withColumn("_d", last).withColumn("_t", F.xxhash64(F.col(f"`{text}`")))


def repeated_runs(docs: DataFrame, *, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines to delete: _d, _t, s, e (first and last line number, from 0) of every stretch that copies an earlier run.

    Suffixes of the sequences of line numbers are ranked by distributed prefix doubling: ranks of the first 2^k lines and of
    the 2^k after them, sorted, give the ranks of the first 2^(k+1). Lines and prefixes that occur once drop out, so the work
    is on repeated stretches of ``min_words`` words only. Suffixes that share at least m lines are one interval of the suffix
    array, which the ranks of the first and the last 2^k <= m of those lines name; m is, for every line, the least number of
    lines from it on (and up to it) that hold ``min_words`` words. All of an interval but its first member are copies, and the
    stretches that these cover are the maximal repeated runs: any line of a run of enough words is in the shortest stretch of
    enough words that starts at it, or else in the one that ends with the run.
    """
    spark = docs.sparkSession
    long_enough = F.length(F.col(f"`{text}`")) >= 2 * min_words - 1
    each = _doc_keys(docs, doc_id, text).filter(long_enough).select(*DOC, F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("pos", "line"))
    # Two hashes of 64 bits name a line.
    lines = store.keep(each.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.coalesce(F.regexp_count("line", F.lit(WORD)), F.lit(0)).alias("words")), "lines")
    held = [lines]
    seen = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    names = _ranked(seen, ["h1", "h2"], "line-ranks", "r0")
    held.append(names)
    of_doc = Window.partitionBy(*DOC).orderBy("pos")
    stretch = Window.partitionBy(*DOC, "seg")
    # Rows with equal id and text are one document: each of its lines stays once. The windows use the same partitions.
    once = lines.join(names, ["h1", "h2"]).select(*DOC, "pos", "words", "r0").repartition(*DOC).distinct()
    u = once.withColumn("seg", F.col("pos") - F.row_number().over(of_doc))
    u = u.withColumn("all", F.sum("words").over(stretch)).filter(F.col("all") >= min_words).drop("all")
    u = store.keep(u, "stretches")
    held.append(u)

    # For each line the end of the least stretch of enough words that starts there, and the start of the one that ends there.
    along = stretch.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    w = u.select(*DOC, "seg", "pos", F.sum("words").over(along).alias("upto"), "words").withColumn("before", F.col("upto") - F.col("words"))

    def pointed(data, query, order):
        """Of each line the last data line in ``order`` that comes no later than its query value."""
        events = F.explode(F.array(F.struct(F.col(data).alias("v"), F.lit(0).alias("kind"), F.col("pos").alias("p")), F.struct(query.alias("v"), F.lit(1).alias("kind"), F.col("pos").alias("p"))))
        e = w.select(*DOC, "seg", events.alias("e")).select(*DOC, "seg", "e.*")
        run = stretch.orderBy(order("v"), "kind", order("p")).rowsBetween(Window.unboundedPreceding, 0)
        got = e.withColumn("to", F.last(F.when(F.col("kind") == 0, F.col("p")), ignorenulls=True).over(run))
        return got.filter("kind = 1 and to is not null")

    ahead = pointed("upto", F.col("before") + min_words, F.desc).select(*DOC, F.col("p").alias("start"), (F.col("to") - F.col("p") + 1).alias("len"))
    back = pointed("before", F.col("upto") - min_words, F.asc).select(*DOC, F.col("to").alias("start"), (F.col("p") - F.col("to") + 1).alias("len"))
    windows = store.keep(ahead.unionByName(back).distinct().withColumn("k", F.floor(F.log2("len") + 1e-9).cast("int")), "windows")
    held.append(windows)

    levels = windows.agg(F.max("k")).first()[0] or 0
    for k in range(levels):
        nxt = F.lead(f"r{k}", 1 << k).over(stretch.orderBy("pos"))
        two = u.withColumn("_next", F.when(F.col(f"r{k}").isNotNull(), nxt))
        pairs = two.filter("_next is not null").groupBy(f"r{k}", "_next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(f"r{k}", "_next")
        ranks = _ranked(pairs, [f"r{k}", "_next"], "prefix-ranks", f"r{k + 1}")
        u = store.keep(two.join(ranks, [f"r{k}", "_next"], "left").drop("_next"), "doubled")
        held += [ranks, u]

    at_level = F.element_at(F.array(*[F.col(f"r{k}") for k in range(levels + 1)]), F.col("k") + 1)
    second = F.col("start") + F.col("len") - F.pow(F.lit(2), F.col("k")).cast("int")
    at = u.select(*DOC, F.col("pos"), *[f"r{k}" for k in range(levels + 1)])
    a = windows.join(at.withColumnRenamed("pos", "start"), [*DOC, "start"]).select(*DOC, "start", "len", "k", at_level.alias("first"))
    b = a.withColumn("pos", second).join(at, [*DOC, "pos"]).select(*DOC, "start", "len", "first", at_level.alias("last")).filter("first is not null and last is not null")
    b = store.keep(b, "intervals")
    held.append(b)
    place = F.struct(*DOC, "start")
    # A table of its own, so that the join's sides are plain and Spark can split an interval that very many lines are in.
    least = store.keep(b.groupBy("len", "first", "last").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first-members")
    held.append(least)
    copies = b.join(least, ["len", "first", "last"]).filter(place > F.col("least")).select(*DOC, "start", (F.col("start") + F.col("len") - 1).alias("end"))
    before = F.max("end").over(Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("before").isNull() | (F.col("start") > F.col("before") + 1), 1).otherwise(0)
    merged = copies.withColumn("before", before).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(Window.partitionBy(*DOC).orderBy("start", "end")))
    out = store.keep(merged.groupBy(*DOC, "island").agg(F.min("start").alias("s"), F.max("end").alias("e")).drop("island"), "copied-runs")
    store.drop(spark, *held)
    return out


def drop_copies(docs: DataFrame, *, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of copied runs deleted, in its own columns, and n_lines, n_removed (lines; columns of these names give way).

    The earliest copy of a run (by id, nulls last, then text, then line) stays. A null text has no lines and stays null; an
    empty one has one line. Rows with equal id and text count as one document and are treated alike. A text whose lines are
    all copies becomes empty. Text of runs shorter than ``min_words`` words isn't touched.
    """
    docs, names = store.packed(docs, "n_lines", "n_removed")
    doc_id, text = (f"p{names.index(c)}" for c in (doc_id, text))
    runs = repeated_runs(docs, min_words=min_words, doc_id=doc_id, text=text)
    cuts = runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_cuts"))
    # The cuts grow with the documents, so they are never broadcast: the plan is the same at every size.
    keyed = _doc_keys(docs, doc_id, text).join(cuts.hint("merge"), DOC, "left")
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    removed = F.coalesce(F.aggregate("_cuts", F.lit(0), lambda n, c: n + c["e"] - c["s"] + 1), F.lit(0))
    start = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at("_cuts", i)["e"] + 1)
    stop = lambda i: F.when(i == F.size("_cuts"), F.size("_lines")).otherwise(F.try_element_at("_cuts", i + 1)["s"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_cuts")), lambda i: F.slice(F.col("_lines"), start(i) + 1, F.greatest(stop(i) - start(i), F.lit(0)))))
    out = keyed.withColumn("_lines", lines).withColumn("_new", F.when(F.col("_cuts").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n")))
    own = store.unpacked(names, {names[int(text[1:])]: F.col("_new")})
    return out.select(*own, F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
