"""One micro-batch, from parsed records to one commit.

A record is late if its window had closed by the watermark that the batch before left; the batch's own newest event moves the
watermark, which then closes windows. First arrival of a transaction wins, in the batch and over all batches, whichever
of the two tables took it.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.clock import from_micros, instant, to_micros
from tidemark.operators.arrivals import enrich, is_late, lateness, malformed, seen_before
from tidemark.operators.windows import KEY
from tidemark.schema import MONEY, REQUIRED
from tidemark.streaming.store import EVERY, LedgerStore

ARRIVAL = ("kafka_timestamp", "kafka_partition", "kafka_offset")
#: A batch of no more keys than this is sent to the history as it is; a larger one meets it by a shuffle.
SENT_KEYS = 500_000


class MalformedBatch(RuntimeError):
    """Records without what they must have: the batch stops before a write, nothing is dropped."""


@dataclass(frozen=True)
class BatchReport:
    batch_id: int
    watermark_applied: datetime | None
    max_event_time: datetime | None
    watermark: datetime | None
    rows_in: int
    rows_on_time: int
    rows_late: int
    rows_duplicate: int


def _report(state: dict) -> BatchReport:
    times = {k: from_micros(state[k]) for k in ("watermark_applied", "max_event_time", "watermark")}
    return BatchReport(**{k: times.get(k, state[k]) for k in BatchReport.__dataclass_fields__})


def process_batch(
    spark: SparkSession,
    rows: DataFrame,
    batch_id: int,
    settings: Settings,
    *,
    store: LedgerStore | None = None,
    now: datetime | None = None,
    stream: str | None = None,
) -> BatchReport:
    """Write a batch, or return the report of the one that has been committed under its number."""
    store = store or LedgerStore(spark, settings.root)
    number = batch_id + (store.base(stream) if stream else 0)
    done = store.committed(number)
    if done is not None:
        return _report(done)
    log = store.log(number - 1)
    previous = store.last_state(log)
    applied, known_max = previous.get("watermark"), previous.get("max_event_time")
    stamp = to_micros(now or datetime.now(timezone.utc))

    arrived = _arrived(rows).persist()
    held = [arrived]
    try:
        seen = arrived.agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"),
            F.max("_newest").alias("newest"),
            F.count("*").alias("keys"),
        ).first()
        if seen["bad"]:
            raise MalformedBatch(f"batch {number}: {seen['bad']} of {seen['n']} records lack one of {', '.join(REQUIRED)}")
        newest = max((m for m in (known_max, seen["newest"]) if m is not None), default=None)
        lateness_micros = settings.allowed_lateness_seconds * 1_000_000
        watermark = None if newest is None else newest - lateness_micros

        history = {t: store.read(log.parts[t], t) for t in ("events", "late_events")}
        known = history["events"].select("transaction_id").unionAll(history["late_events"].select("transaction_id"))
        stamped = enrich(arrived.select("_first.*"), settings.window_seconds, instant(stamp), F.lit(number))
        judged = seen_before(stamped.withColumn("late", is_late(instant(applied))), known, send=seen["keys"] <= SENT_KEYS).persist()
        held.append(judged)
        new = ~F.col("seen")
        fresh = judged.where(new)
        counts = judged.agg(F.count_if(new & ~F.col("late")).alias("on_time"), F.count_if(new & F.col("late")).alias("late")).first()

        folders = {}
        if counts["late"]:
            evidence = {
                "watermark_at_arrival": instant(applied),
                "lateness_seconds": lateness(F.unix_micros("event_time"), F.lit(applied)),
            }
            folders["late_events"] = store.stage("late_events", fresh.where("late").withColumns(evidence), number)
        if counts["on_time"]:
            folders["events"] = store.stage("events", fresh.where("NOT late"), number)
        changes = _window_changes(store, log, history["events"], judged, applied, watermark, number, stamp)
        if changes is not None:
            folders["merchant_windows"] = store.stage("merchant_windows", changes, number)
    finally:
        for frame in held:
            frame.unpersist()

    report = BatchReport(
        number, from_micros(applied), from_micros(newest), from_micros(watermark), seen["n"], counts["on_time"], counts["late"],
        seen["n"] - counts["on_time"] - counts["late"],
    )
    state = asdict(report) | {
        "watermark_applied": applied, "max_event_time": newest, "watermark": watermark, "processing_time": stamp
    }
    state = store.commit(number, folders, state)
    if len(log.tail) + 1 >= EVERY:
        store.maintain()
    return _report(state)


def _arrived(rows: DataFrame) -> DataFrame:
    """One row a transaction: its first arrival, and what all its records add to the batch's counts; rows are read and shuffled once."""
    return rows.groupBy("transaction_id").agg(
        F.min_by(F.struct(*rows.columns), F.struct(*ARRIVAL)).alias("_first"),
        F.count("*").alias("_copies"),
        F.count_if(malformed()).alias("_bad"),
        F.max(F.unix_micros("event_time")).alias("_newest"),
    )


def _window_changes(store, log, events, judged, applied, watermark, number, stamp) -> DataFrame | None:
    """One row for each window that the batch writes or closes.

    Windows that ended by the watermark applied are final and never met again: neither their rows nor their events are read. All
    open windows are totalled by one aggregation of their events, old and new, with the changelog's flags beside them.
    """
    if watermark is None:
        return None
    changelog = store.read(log.parts["merchant_windows"], "merchant_windows")
    if applied is not None:
        still_open = F.col("window_end") > instant(applied)
        changelog, events = changelog.where(still_open), events.where(still_open)
    no, new = F.lit(False), ~F.col("seen")
    own = judged.where("NOT late").select(
        *KEY, F.when(new, F.col("amount")).alias("amount"), new.alias("counts"), F.lit(True).alias("touched"), no.alias("is_final")
    )
    old = events.select(*KEY, "amount", F.lit(True).alias("counts"), no.alias("touched"), no.alias("is_final"))
    flags = changelog.select(*KEY, F.lit(None).cast(MONEY).alias("amount"), no.alias("counts"), no.alias("touched"), "is_final")
    totals = own.unionAll(old).unionAll(flags).groupBy(*KEY).agg(
        F.count_if("counts").alias("tx_count"),
        F.sum("amount").cast(MONEY).alias("total_amount"),
        F.max("touched").alias("touched"),
        F.max("is_final").alias("was_final"),  # goes one way, so any row of the changelog that has it will do
    )
    passed = F.col("window_end") <= instant(watermark)
    return totals.where((F.col("tx_count") > 0) & (F.col("touched") | (~F.col("was_final") & passed))).select(
        *KEY,
        "tx_count",
        "total_amount",
        (F.col("was_final") | passed).alias("is_final"),
        F.lit(number).cast("long").alias("updated_batch_id"),
        instant(stamp).alias("updated_at"),
    )
