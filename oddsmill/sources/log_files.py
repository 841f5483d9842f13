"""Text logs as ordered lines: numbers for files that are read in splits, heartbeat, last scan and the text of error alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.scratch import cut

# What marks a line as an error, a heartbeat as failed, and the end of a scan.
ERROR_WORDS = ("Error", "ERROR", "Traceback", "KeyError", "Exception")
FAILED_WORDS = ("Error", "错误")
SCAN_DONE = "扫描完成"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files, n from 1 in each file.

    A file is read in splits. The lines of one are consecutive in their task, so a line's place in it is its running number less the
    least of the split; the lines of the splits before it come on top. Only one row for each split is summed in order, lines aren't sorted.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "block").agg(F.min("i").alias("least"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("least") + 1).alias("shift")), "log-splits")
    return lines.join(starts, ["file", "block"]).select("file", (F.col("i") + F.col("shift")).alias("n"), "line")


def holds_any(line: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | line.contains(w)
    return out


def heartbeats(lines: DataFrame, marker: str = SCAN_DONE, failed: Sequence[str] = FAILED_WORDS, log: str = "file") -> DataFrame:
    """Each log's lines, last line that isn't blank, if that is free of failure, and the number of the last line with the marker."""
    text = F.trim("line")
    by = lines.groupBy(log).agg(
        F.count("*").alias("lines"), F.max_by(F.when(text != "", text), F.when(text != "", F.col("n"))).alias("last_line"), F.max(F.when(F.col("line").contains(marker), F.col("n"))).alias("last_scan")
    )
    alive = F.coalesce(~holds_any(F.col("last_line"), failed), F.lit(False))
    return by.select(log, "lines", "last_line", alive.alias("heartbeat"), "last_scan", F.col("last_scan").isNotNull().alias("scanned"))


def error_messages(lines: DataFrame, words: Sequence[str] = ERROR_WORDS, shown: int = LIMITS.log_lines_shown, length: int = LIMITS.log_line_length, log: str = "file") -> DataFrame:
    """(log, errors, message) of each log with errors: the first `shown` lines at `length` characters, and how many are left."""
    bad = lines.where(holds_any(F.col("line"), words)).select(log, "n", F.trim("line").alias("line"))
    first = bad.withColumn("k", F.row_number().over(Window.partitionBy(log).orderBy("n"))).where(F.col("k") <= shown)
    listed = first.groupBy(log).agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("rows"))
    row = lambda r: F.concat(r["k"].cast("string"), F.lit(". `"), F.substring(r["line"], F.lit(1), F.lit(length)), F.lit("...`"))
    counted = bad.groupBy(log).agg(F.count("*").alias("errors")).join(listed, log)
    more = F.when(F.col("errors") > shown, F.concat(F.lit("\n... and "), F.col("errors") - shown, F.lit(" more"))).otherwise("")
    message = F.concat(F.lit("Errors in "), F.col(log), F.lit(": "), F.col("errors"), F.lit("\n"), F.array_join(F.transform("rows", row), "\n"), more)
    return counted.select(log, "errors", message.alias("message"))
