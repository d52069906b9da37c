"""The streaming job: a parsed stream into the ledger."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import Settings
from tidemark.session import build_session
from tidemark.sources.streams import kafka
from tidemark.sources.wire import parse
from tidemark.streaming.batch import process_batch
from tidemark.streaming.store import LedgerStore

log = logging.getLogger("tidemark.stream")


def start_query(
    spark: SparkSession,
    records: DataFrame,
    settings: Settings,
    *,
    available_now: bool = False,
    now: Callable[[int], datetime] | None = None,
) -> StreamingQuery:
    """Start writing a parsed stream. The checkpoint names a batch's offsets before it runs, so an interrupted batch comes again
    with its number; the store makes that harmless. ``now`` gives a batch's processing time, for tests."""

    def write(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        store = LedgerStore(session, settings.root)
        report = process_batch(
            session, rows, batch_id, settings, store=store, stream=stream, now=now(batch_id) if now else None
        )
        log.info("%s", report)

    trigger = {"availableNow": True} if available_now else {"processingTime": f"{settings.trigger_seconds} seconds"}
    return (
        records.writeStream.queryName("tidemark")
        .option("checkpointLocation", settings.checkpoint)
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def main() -> None:
    logging.basicConfig(level=logging.INFO)
    settings = Settings.from_env()
    spark = build_session("tidemark-stream")
    start_query(spark, parse(kafka(spark, settings)), settings).awaitTermination()


if __name__ == "__main__":
    main()
