"""Summaries of a run as text, and errors that end it."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger("readloom")


class ToolError(RuntimeError):
    """A tool can't go on; ``status`` is its return code."""

    def __init__(self, message: str, status: int = -1):
        super().__init__(message)
        self.status = status


def error(message: str, status: int = -1) -> None:
    """Log and raise."""
    LOG.error(message)
    raise ToolError(message, status)


def summary_lines(counters: DataFrame) -> DataFrame:
    """A one-row table of counters as lines ``name<tab>value``, in the order of its columns; nulls are empty."""
    rows = [F.struct(F.lit(i).alias("i"), F.concat_ws("\t", F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value")) for i, c in enumerate(counters.columns)]
    return counters.select(F.explode(F.array(*rows)).alias("x")).orderBy("x.i").select("x.value")


def write_summary(counters: DataFrame, path: str, title: str | None = None) -> None:
    """Write a one-row table of counters as a text file in the folder ``path``, and log it."""
    lines = [r.value for r in summary_lines(counters).collect()]  # a line for each column
    for line in [title, *lines] if title else lines:
        LOG.info(line)
    text = "\n".join([title, *lines] if title else lines)
    counters.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
