"""From documents to a training mix: quality, line dedup, near-duplicates, benchmark decontamination, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontaminate, lines, mixing, neardup, quality, store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts (a score of 0.3 or more).

    Null and empty texts are judged by their structure features; equal rows are kept or go together; without labels of both
    classes all have one score; an empty table stays empty. Columns named score or predicted pass through unharmed.
    """
    model = quality.fit(docs, store.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are deleted; a document of which no word is left goes.

    Null, blank and short texts stay as they are; the earliest copy (by id, nulls last, then text) stays; rows with equal id
    and text are cut alike. n_chars follows the text that is left.
    """
    cleaned = lines.drop_copies(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(lines.WORD)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.filter(left).withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more): that of the smallest id.

    Null and blank texts have no copies and all stay; a row that is there twice with its id and text stays once; null ids
    come last.
    """
    return neardup.drop_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go; an item without an id counts as well.

    Null and empty texts stay, and so does everything where the benchmark is empty.
    """
    items = store.table(spark, sf_dir, "benchmark").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    return decontaminate.decontaminate(docs, items, min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with size, source_size, target, copies, taken and copy_no.

    A null source is a source; documents without words, and those of which no copy is taken, go; columns of these names give
    way; an empty table stays empty.
    """
    return mixing.expand(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: A trained model decides in the first stage, so SQL can't give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and read again, and goes once the next one is."""
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(before, "kept_at"):
            store.drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
