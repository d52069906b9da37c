"""A misbehaving feed made of the ``events`` table, in SQL that every engine reads alike.

A tenth of the events arrives a fifth of the feed late, the rest is shuffled a little; a tenth is sent twice, the copy at once or an
eighth of the feed later. ``batch_id`` cuts the arrivals into about twenty batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import MONEY

WINDOW_SECONDS = 3600
LATENESS_SECONDS = 7200
BATCHES = 20


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transaction_id, merchant_id, account_id, amount, currency, method, event_time`` (NTZ), ``copy, pos, batch_id``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sized = events.crossJoin(F.broadcast(events.agg(F.count("*").alias("n"))))  # one row
    base = sized.select(
        "*",
        F.expr("event_id + CASE WHEN event_id % 10 = 7 THEN n div 5 ELSE (event_id * 7) % 10 END").alias("pos0"),
    )
    sends = F.when(
        F.expr("event_id % 20 IN (3, 7)"),
        F.array(F.struct(F.lit(0).alias("copy"), F.col("pos0").alias("pos")),
                F.struct(F.lit(1).alias("copy"), F.expr("pos0 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE n div 8 END").alias("pos"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("copy"), F.col("pos0").alias("pos"))))
    return base.select("*", F.explode(sends).alias("sent")).select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("merchant_id"),
        F.concat(F.lit("A"), (F.col("user_id") % 50).cast("string")).alias("account_id"),
        F.col("value").cast(MONEY).alias("amount"),
        F.lit("BRL").alias("currency"),
        F.col("event_type").alias("method"),
        F.col("ts").alias("event_time"),
        "sent.copy",
        "sent.pos",
        F.expr(f"sent.pos * {BATCHES} div n").alias("batch_id"),
    )


FEED_SQL = f"""
feed AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS merchant_id,
         'A' || CAST(user_id % 50 AS VARCHAR) AS account_id, CAST(value AS DECIMAL(18,2)) AS amount,
         'BRL' AS currency, event_type AS method, ts AS event_time, copy, pos, (pos * {BATCHES}) // n AS batch_id
  FROM (
    SELECT *, 0 AS copy, pos0 AS pos FROM sized
    UNION ALL
    SELECT *, 1 AS copy, pos0 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE n // 8 END AS pos
    FROM sized WHERE event_id % 20 IN (3, 7)
  )
)"""
SIZED_SQL = """
sized AS (
  SELECT e.*, c.n, event_id + CASE WHEN event_id % 10 = 7 THEN c.n // 5 ELSE (event_id * 7) % 10 END AS pos0
  FROM events e, (SELECT count(*) AS n FROM events) c
)"""
