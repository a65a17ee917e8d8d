"""Normalization of streams. The normalizers keep no state, so a stream takes the same expressions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import marked
from ..operators.normalize import normalize_rows


def normalize_stream(rows: DataFrame) -> DataFrame:
    """A stream of rows (field, value, ...) with normalized and confidence."""
    return normalize_rows(rows)


def first_seen(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """The first row of each (field, normalized value) within the watermark's delay."""
    return normalize_rows(rows).withWatermark(time, delay).dropDuplicatesWithinWatermark(["field", "normalized"])


def changes_by_window(rows: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Counts of rows and changes by time window and field; late rows count until the watermark passes their window."""
    found = marked(normalize_rows(rows)).withWatermark(time, delay)
    return found.groupBy(F.window(time, width).alias("window"), "field").agg(F.count("*").alias("total"), F.count_if("changed").alias("changed"))
