"""Per-merchant window totals: recomputed where touched, closed by the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import MONEY

KEY = ["window_start", "window_end", "merchant_id"]


def touched(rows: DataFrame) -> DataFrame:
    """The distinct windows that rows fall into."""
    return rows.select(*KEY).distinct()


def totals(events: DataFrame) -> DataFrame:
    """Count and sum of every window; a total is derived, never added to."""
    return events.groupBy(*KEY).agg(
        F.count("*").alias("tx_count"), F.sum("amount").cast(MONEY).alias("total_amount")
    )


def refreshed(events: DataFrame, windows: DataFrame) -> DataFrame:
    """The totals of ``windows`` alone."""
    return totals(events.join(windows, KEY, "left_semi"))


def due(windows: DataFrame, watermark: Column) -> DataFrame:
    """Open windows that the watermark has passed."""
    return windows.where(~F.col("is_final") & (F.col("window_end") <= watermark))
