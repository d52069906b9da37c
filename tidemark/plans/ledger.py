"""The whole ledger of a feed as one plan: no state, no batches one after the other.

A batch's watermark is a running maximum over batches, so which records are late, which copy of a transaction counts and what each
window's row says can all be told at once. It is the independent form of what the streaming job does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import ntz_micros
from tidemark.operators.arrivals import is_late, lateness, tumbling
from tidemark.operators.windows import totals
from tidemark.schema import MONEY
from tidemark.sources.feed import FEED_SQL, LATENESS_SECONDS, SIZED_SQL, WINDOW_SECONDS, feed


def chain(arrivals: DataFrame, lateness_seconds: int = LATENESS_SECONDS) -> DataFrame:
    """One row a batch: what it held, the watermark it was judged by and the one it left. (A window over batches alone.)"""
    by_batch = Window.orderBy("batch_id")
    batches = arrivals.groupBy("batch_id").agg(F.max("event_time").alias("batch_max"), F.count("*").alias("rows_in"))
    return (
        batches.withColumn(
            "max_event_time", F.max("batch_max").over(by_batch.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("watermark", F.expr(f"max_event_time - INTERVAL {lateness_seconds} SECONDS"))
        .withColumn("watermark_applied", F.lag("watermark").over(by_batch))
        .withColumn("processing_time", F.expr("batch_max + INTERVAL 1 SECOND"))
    )


def judged(arrivals: DataFrame, chained: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Every arrival with its window, whether it was late, and its place among its transaction's arrivals."""
    place = Window.partitionBy("transaction_id").orderBy("batch_id", "pos", "copy")
    return (
        tumbling(arrivals, window_seconds)
        .join(chained.select("batch_id", "watermark_applied", "processing_time"), "batch_id")
        .withColumn("late", is_late(F.col("watermark_applied")))
        .withColumn("place", F.row_number().over(place))
    )


_EVENT = ["transaction_id", "merchant_id", "account_id", "amount", "currency", "method", "event_time", "window_start", "window_end", "processing_time", "batch_id"]


def events_of(rows: DataFrame) -> DataFrame:
    return rows.where("place = 1 AND NOT late").select(*_EVENT)


def late_events_of(rows: DataFrame) -> DataFrame:
    seconds = lateness(ntz_micros("event_time"), ntz_micros("watermark_applied"))
    return rows.where("place = 1 AND late").select(
        *_EVENT, F.col("watermark_applied").alias("watermark_at_arrival"), seconds.alias("lateness_seconds")
    )


def windows_of(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """Totals, whether they are final, and the batch that last wrote them.

    A window is final from the first batch whose watermark reaches its end; before that, every batch with an on-time record of it (a
    copy too) writes it.
    """
    on_time = rows.where("NOT late")
    last = on_time.groupBy("window_start", "window_end", "merchant_id").agg(F.max("batch_id").alias("last_batch"))
    # one row a distinct end or batch: the first batch whose watermark is at the end or beyond
    ends = on_time.select(F.col("window_end").alias("at"), F.lit(None).cast("long").alias("batch_id")).distinct()
    marks = chained.select(F.col("watermark").alias("at"), F.col("batch_id").cast("long"))
    beyond = Window.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    closing = (
        ends.union(marks)
        .withColumn("closing_batch", F.min("batch_id").over(beyond))
        .where("batch_id IS NULL")
        .select(F.col("at").alias("window_end"), "closing_batch")
    )
    return (
        totals(events_of(rows))
        .join(last, ["window_start", "window_end", "merchant_id"])
        .join(closing, "window_end", "left")
        .select(
            "window_start",
            "window_end",
            "merchant_id",
            "tx_count",
            F.col("total_amount").cast(MONEY).alias("total_amount"),
            F.col("closing_batch").isNotNull().alias("is_final"),
            F.coalesce("closing_batch", "last_batch").alias("updated_batch_id"),
        )
    )


def state_of(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """The batch ledger."""
    counts = rows.groupBy("batch_id").agg(
        F.count_if(F.expr("place = 1 AND NOT late")).alias("rows_on_time"),
        F.count_if(F.expr("place = 1 AND late")).alias("rows_late"),
        F.count_if(F.expr("place > 1")).alias("rows_duplicate"),
    )
    return chained.join(counts, "batch_id").select(
        "batch_id", "watermark_applied", "max_event_time", "watermark", "rows_in", "rows_on_time", "rows_late",
        "rows_duplicate", "processing_time",
    )


class Ledger:
    """The four tables of the feed over ``events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.arrivals = feed(spark, sf_dir)
        self.chain = chain(self.arrivals)
        self.judged = judged(self.arrivals, self.chain)
        self.events = events_of(self.judged)
        self.late_events = late_events_of(self.judged)
        self.windows = windows_of(self.judged, self.chain)
        self.state = state_of(self.judged, self.chain)


LEDGER_SQL = f"""
WITH {SIZED_SQL.strip()},
{FEED_SQL.strip()},
batches AS (SELECT batch_id, max(event_time) AS batch_max, count(*) AS rows_in FROM feed GROUP BY batch_id),
marks AS (
  SELECT *, max(batch_max) OVER (ORDER BY batch_id) AS max_event_time,
         max(batch_max) OVER (ORDER BY batch_id) - INTERVAL {LATENESS_SECONDS} SECOND AS watermark,
         batch_max + INTERVAL 1 SECOND AS processing_time
  FROM batches
),
chain AS (SELECT *, lag(watermark) OVER (ORDER BY batch_id) AS watermark_applied FROM marks),
windowed AS (
  SELECT *, time_bucket(INTERVAL {WINDOW_SECONDS} SECOND, event_time) AS window_start,
         time_bucket(INTERVAL {WINDOW_SECONDS} SECOND, event_time) + INTERVAL {WINDOW_SECONDS} SECOND AS window_end
  FROM feed
),
judged AS (
  SELECT w.*, c.watermark_applied, c.processing_time,
         coalesce(w.window_end <= c.watermark_applied, false) AS late,
         row_number() OVER (PARTITION BY transaction_id ORDER BY w.batch_id, pos, copy) AS place
  FROM windowed w JOIN chain c ON w.batch_id = c.batch_id
),
ledger_events AS (
  SELECT {", ".join(_EVENT)} FROM judged WHERE place = 1 AND NOT late
),
ledger_late AS (
  SELECT {", ".join(_EVENT)}, watermark_applied AS watermark_at_arrival,
         (epoch_us(watermark_applied) - epoch_us(event_time)) / 1000000.0::DOUBLE AS lateness_seconds
  FROM judged WHERE place = 1 AND late
),
last_touch AS (
  SELECT window_start, window_end, merchant_id, max(batch_id) AS last_batch FROM judged WHERE NOT late GROUP BY ALL
),
closing AS (
  SELECT window_end, min(batch_id) AS closing_batch
  FROM (SELECT DISTINCT window_end FROM judged WHERE NOT late) JOIN chain ON watermark >= window_end GROUP BY window_end
),
totals AS (
  SELECT window_start, window_end, merchant_id, count(*) AS tx_count, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amount
  FROM ledger_events GROUP BY ALL
),
ledger_windows AS (
  SELECT t.window_start, t.window_end, t.merchant_id, t.tx_count, t.total_amount,
         c.closing_batch IS NOT NULL AS is_final, coalesce(c.closing_batch, l.last_batch) AS updated_batch_id
  FROM totals t
  JOIN last_touch l ON t.window_start = l.window_start AND t.merchant_id = l.merchant_id
  LEFT JOIN closing c ON t.window_end = c.window_end
),
ledger_state AS (
  SELECT c.batch_id, c.watermark_applied, c.max_event_time, c.watermark, c.rows_in,
         count(*) FILTER (WHERE place = 1 AND NOT late) AS rows_on_time,
         count(*) FILTER (WHERE place = 1 AND late) AS rows_late,
         count(*) FILTER (WHERE place > 1) AS rows_duplicate, c.processing_time
  FROM chain c JOIN judged j ON c.batch_id = j.batch_id GROUP BY ALL
)
"""
