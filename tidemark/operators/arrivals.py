"""What happens to arriving records before they are written: checks, dedup, windows, routing.

Each operator is a DataFrame to DataFrame function that Catalyst can see through; none runs a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import MONEY, REQUIRED


def malformed(columns: Sequence[str] = REQUIRED) -> Column:
    """Whether a record lacks something it must have."""
    found = F.lit(False)
    for name in columns:
        found = found | F.col(name).isNull()
    return found


def first_arrival(rows: DataFrame, order: Sequence[str], key: str = "transaction_id") -> DataFrame:
    """One row a key, the first by ``order`` (nulls first). Planned with a group limit, so copies are cut before the shuffle."""
    place = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def tumbling(rows: DataFrame, seconds: int, time: str = "event_time") -> DataFrame:
    """Adds ``window_start`` and ``window_end`` of the epoch-aligned window ``[start, end)``; rows without a time are lost, so they
    are refused before."""
    return (
        rows.withColumn("_window", F.window(time, f"{seconds} seconds"))
        .withColumns({"window_start": F.col("_window.start"), "window_end": F.col("_window.end")})
        .drop("_window")
    )


def enrich(rows: DataFrame, seconds: int, processing_time: Column, batch_id: Column) -> DataFrame:
    """Windows, money and the batch's stamps."""
    return tumbling(rows, seconds).withColumns(
        {
            "amount": F.col("amount").cast(MONEY),
            "processing_time": processing_time,
            "batch_id": batch_id.cast("long"),
        }
    )


def is_late(watermark: Column, window_end: str = "window_end") -> Column:
    """A record is late if its window had closed; without a watermark nothing is."""
    return F.coalesce(F.col(window_end) <= watermark, F.lit(False))


def lateness(event_micros: Column, watermark_micros: Column) -> Column:
    """Seconds that an event is behind the watermark."""
    return (watermark_micros - event_micros) / F.lit(1_000_000.0)


def unseen(rows: DataFrame, known: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows whose key isn't in ``known``: the history is first cut to the batch's keys by a semi join, of which only the key
    column is read, so that the anti join's other side isn't larger than the batch."""
    own = rows.select(key).distinct()
    met = known.select(key).join(own, key, "left_semi")
    return rows.join(met, key, "left_anti")


def seen_before(rows: DataFrame, known: DataFrame, key: str = "transaction_id", *, send: bool = False) -> DataFrame:
    """Adds ``seen``, whether ``known`` has a row's key; one row a key on both sides. ``send``: few enough rows that their keys
    go to the history, which is then read where it lies and not shuffled."""
    own = rows.select(key)
    met = known.select(key).join(F.broadcast(own) if send else own, key, "left_semi").withColumn("_met", F.lit(True))
    marked = rows.join(F.broadcast(met) if send else met, key, "left")
    return marked.select(*[rows[c] for c in rows.columns], F.coalesce("_met", F.lit(False)).alias("seen"))
