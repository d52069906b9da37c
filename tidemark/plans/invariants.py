"""Seven properties that hold of the four tables after any batches, restarts and replays.

Each is a one-row DataFrame ``check_name, violations`` over tables of any origin.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import totals

Tables = Mapping[str, DataFrame]


def _named(name: str, counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(name).alias("check_name"), F.col("violations").cast("long").alias("violations"))


def _count(rows: DataFrame, *where: Column | str) -> DataFrame:
    for condition in where:
        rows = rows.where(condition)
    return rows.agg(F.count("*").alias("violations"))


def reconciled(t: Tables) -> DataFrame:
    """The ledger's sums beside the tables' sizes."""
    sums = t["stream_state"].agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("rows_in", "rows_on_time", "rows_late", "rows_duplicate")]
    )
    sizes = t["events"].agg(F.count("*").alias("events")).crossJoin(t["late_events"].agg(F.count("*").alias("late_events")))
    return sums.crossJoin(sizes)  # one row each


def ledger_matches_tables(t: Tables) -> DataFrame:
    off = (
        (F.col("rows_on_time") != F.col("events")).cast("int")
        + (F.col("rows_late") != F.col("late_events")).cast("int")
        + (F.col("rows_in") != F.col("rows_on_time") + F.col("rows_late") + F.col("rows_duplicate")).cast("int")
    )
    return _named("ledger matches tables", reconciled(t).select(off.alias("violations")))


def one_row_a_transaction(t: Tables) -> DataFrame:
    """Surplus rows of transactions over both tables together."""
    ids = t["events"].select("transaction_id").unionAll(t["late_events"].select("transaction_id"))
    surplus = ids.groupBy("transaction_id").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")
    )
    return _named("one row per transaction", surplus)


def mismatched(t: Tables) -> DataFrame:
    """Windows that differ from a fresh count of ``events``, from either side."""
    fresh = totals(t["events"]).select(
        "window_start", "merchant_id", F.col("tx_count").alias("n"), F.col("total_amount").alias("total")
    )
    stored = t["merchant_windows"].select("window_start", "merchant_id", "tx_count", "total_amount")
    met = fresh.join(stored, ["window_start", "merchant_id"], "full")
    return met.where(~(F.col("n").eqNullSafe(F.col("tx_count")) & F.col("total").eqNullSafe(F.col("total_amount"))))


def windows_recounted(t: Tables) -> DataFrame:
    return _named("windows equal a fresh recount", _count(mismatched(t)))


def late_has_evidence(t: Tables) -> DataFrame:
    bad = (F.col("window_end") > F.col("watermark_at_arrival")) | (F.col("lateness_seconds") <= 0)
    return _named("late rows carry their evidence", _count(t["late_events"], bad))


def watermark_monotonic(t: Tables) -> DataFrame:
    """Each batch is judged by the watermark before it, which never falls. (A window over the batches, one row each.)"""
    order = Window.orderBy("batch_id")
    state = t["stream_state"].withColumns(
        {"before": F.lag("watermark").over(order), "place": F.row_number().over(order)}
    )
    broken = (~F.col("watermark_applied").eqNullSafe(F.col("before"))).cast("int")
    fallen = F.coalesce((F.col("watermark") < F.col("before")).cast("int"), F.lit(0))
    counted = state.where("place > 1").agg(F.coalesce(F.sum(broken + fallen), F.lit(0)).alias("violations"))
    return _named("watermark never moves backwards", counted)


def final_windows_frozen(t: Tables) -> DataFrame:
    """Events that came after their window closed, and windows that should be closed."""
    closed = t["merchant_windows"].where("is_final").select("window_start", "merchant_id", "updated_batch_id")
    after = t["events"].join(closed, ["window_start", "merchant_id"]).where("batch_id > updated_batch_id").select(F.lit(1))
    last = t["stream_state"].agg(F.max("watermark").alias("last"))  # one row
    open_ = t["merchant_windows"].where("NOT is_final").crossJoin(F.broadcast(last)).where("window_end <= last").select(F.lit(1))
    return _named("final windows never change", _count(after.unionAll(open_)))


def two_clocks(t: Tables) -> DataFrame:
    """Event and processing time are different clocks, and processing follows the log."""
    e = t["events"]
    bad = (F.col("processing_time") == F.col("event_time")).cast("int")
    if "kafka_timestamp" in e.columns:
        bad = bad + F.coalesce((F.col("processing_time") < F.col("kafka_timestamp")).cast("int"), F.lit(0))
    return _named("two clocks", e.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("violations")))


CHECKS = (
    ledger_matches_tables, one_row_a_transaction, windows_recounted, late_has_evidence, watermark_monotonic,
    final_windows_frozen, two_clocks,
)


def all_checks(t: Tables) -> DataFrame:
    found = CHECKS[0](t)
    for check in CHECKS[1:]:
        found = found.unionAll(check(t))
    return found
