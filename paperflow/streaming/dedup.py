"""Streaming forms of the ledger's window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """Rows whose keys have not come within the horizon of event time."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, at: str, late: str, width: str, slide: str, *by: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, slide), *by).agg(F.count(F.lit(1)).alias("n"))
