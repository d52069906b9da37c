"""The feed of ``events`` as JSON on the wire, through the real streaming job, a file a batch."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.clock import ntz_to_instant
from tidemark.sources.feed import LATENESS_SECONDS, WINDOW_SECONDS, feed
from tidemark.sources.streams import json_files
from tidemark.sources.wire import encode, parse
from tidemark.streaming.query import start_query
from tidemark.streaming.store import LedgerStore


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a log's records, with ``batch_id``; arrival is the order of positions."""
    rows = feed(spark, sf_dir).withColumn("time", ntz_to_instant("event_time"))
    return rows.select(
        encode(F.col("time"), 6).alias("value"), F.lit(0).alias("partition"), (F.col("pos") * 2 + F.col("copy")).alias("offset"),
        F.timestamp_seconds(F.col("pos")).alias("timestamp"), "batch_id",
    )


def write_arrivals(spark: SparkSession, sf_dir: str, folder: str) -> int:
    """The feed's batches as files of ``folder``, in the order of their names and dates; how many there are."""
    staging = f"{folder}-staging"
    records(spark, sf_dir).repartition("batch_id").write.partitionBy("batch_id").json(staging)
    os.makedirs(folder)
    found = glob.glob(f"{staging}/batch_id=*/*.json")
    assert len(found) == len(os.listdir(staging)) - sum(not n.startswith("batch_id=") for n in os.listdir(staging)), "a file a batch"
    for path in found:
        number = int(os.path.basename(os.path.dirname(path)).removeprefix("batch_id="))
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
        os.replace(path, f"{folder}/{number:06d}.json")
    return len(found)


def run_feed(spark: SparkSession, sf_dir: str, folder: str) -> LedgerStore:
    """Write the feed's batches as files, read them as a stream one file a trigger, and return the ledger."""
    write_arrivals(spark, sf_dir, f"{folder}/arrivals")
    settings = Settings(
        root=f"{folder}/ledger", checkpoint=f"{folder}/checkpoint", window_seconds=WINDOW_SECONDS,
        allowed_lateness_seconds=LATENESS_SECONDS,
    )
    start_query(spark, parse(json_files(spark, f"{folder}/arrivals")), settings, available_now=True).awaitTermination()
    return LedgerStore(spark, settings.root)
