"""Registered queries over the feed of ``events``, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import instant_to_ntz, ntz_to_instant
from tidemark.operators.arrivals import enrich, first_arrival, malformed, tumbling, unseen
from tidemark.operators.keyed import insert_only, upsert
from tidemark.operators.windows import due, refreshed, touched
from tidemark.plans import invariants
from tidemark.plans.ledger import LEDGER_SQL, Ledger
from tidemark.schema import MONEY
from tidemark.shared import mounted, shared_dir
from tidemark.sources.feed import WINDOW_SECONDS, feed
from tidemark.sources.wire import encode, parse

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Batches at or above this are "new" in the queries that split the feed in two.
SPLIT = 10


def query(name: str, sql: str | None):
    """Register a function under a name; ``sql`` follows the ledger's common tables."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = LEDGER_SQL + sql
        return function

    return add


def _tables(ledger: Ledger) -> dict[str, DataFrame]:
    return {
        "events": ledger.events, "late_events": ledger.late_events,
        "merchant_windows": ledger.windows, "stream_state": ledger.state,
    }


_KEEP = ("transaction_id", "merchant_id", "amount", "event_time")


# --- the wire, windows, dedup ---


@query("wire_encode", """
SELECT transaction_id, '{"transaction_id":"' || transaction_id || '","merchant_id":"' || merchant_id ||
       '","account_id":"' || account_id || '","amount":"' || CAST(amount AS VARCHAR) || '","currency":"' || currency ||
       '","method":"' || method || '","event_time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00"}' AS payload
FROM feed WHERE copy = 0
""")  # fmt: skip
def wire_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).where("copy = 0").withColumn("time", ntz_to_instant("event_time"))
    return rows.select("transaction_id", encode(F.col("time")).alias("payload"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a log would hold it; one record in 97 is no JSON."""
    rows = feed(spark, sf_dir).withColumn("time", ntz_to_instant("event_time"))
    text = F.when(F.col("pos") % 97 == 0, F.lit("{broken")).otherwise(encode(F.col("time")))
    return rows.select(
        text.cast("binary").alias("value"), F.lit(0).alias("partition"), (F.col("pos") * 2 + F.col("copy")).alias("offset"),
        F.expr("time + INTERVAL 1 SECOND").alias("timestamp"),
    )


@query("wire_parse", """
SELECT CASE WHEN pos % 97 <> 0 THEN transaction_id END AS transaction_id, CASE WHEN pos % 97 <> 0 THEN amount END AS amount,
       CASE WHEN pos % 97 <> 0 THEN date_trunc('millisecond', event_time) END AS event_time, pos * 2 + copy AS kafka_offset
FROM feed
""")  # fmt: skip
def wire_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse(_raw(spark, sf_dir))
    return parsed.select("transaction_id", "amount", instant_to_ntz("event_time").alias("event_time"), "kafka_offset")


@query("malformed_count", """
SELECT count(*) FILTER (WHERE pos % 97 = 0) AS malformed, count(*) AS rows_in FROM feed
""")  # fmt: skip
def malformed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_raw(spark, sf_dir)).agg(F.count_if(malformed()).alias("malformed"), F.count("*").alias("rows_in"))


@query("tumbling_assign", "SELECT transaction_id, copy, event_time, window_start, window_end FROM windowed")
def tumbling_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tumbling(feed(spark, sf_dir), WINDOW_SECONDS)
    return rows.select("transaction_id", "copy", "event_time", "window_start", "window_end")


@query("enrich", """
SELECT transaction_id, copy, amount, window_start, window_end, event_time + INTERVAL 1 SECOND AS processing_time,
       CAST(7 AS BIGINT) AS batch_id
FROM windowed
""")  # fmt: skip
def enrich_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).withColumn("amount", F.col("amount").cast("string"))
    out = enrich(rows, WINDOW_SECONDS, F.expr("event_time + INTERVAL 1 SECOND"), F.lit(7))
    return out.select("transaction_id", "copy", "amount", "window_start", "window_end", "processing_time", "batch_id")


@query("dedup_first_arrival", """
SELECT transaction_id, merchant_id, amount, event_time, pos, copy FROM judged WHERE place = 1
""")  # fmt: skip
def dedup_first_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_arrival(feed(spark, sf_dir), ["batch_id", "pos", "copy"])
    return rows.select(*_KEEP, "pos", "copy")


# --- routing ---


@query("watermark_chain", "SELECT batch_id, rows_in, max_event_time, watermark, watermark_applied FROM chain")
def watermark_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).chain.select("batch_id", "rows_in", "max_event_time", "watermark", "watermark_applied")


@query("route_on_time", "SELECT transaction_id, copy, batch_id, window_end FROM judged WHERE NOT late")
def route_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).judged.where("NOT late").select("transaction_id", "copy", "batch_id", "window_end")


@query("route_late", "SELECT transaction_id, copy, batch_id, window_end, watermark_applied FROM judged WHERE late")
def route_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Ledger(spark, sf_dir).judged.where("late")
    return rows.select("transaction_id", "copy", "batch_id", "window_end", "watermark_applied")


@query("late_evidence", "SELECT transaction_id, watermark_at_arrival, lateness_seconds FROM ledger_late")
def late_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).late_events.select("transaction_id", "watermark_at_arrival", "lateness_seconds")


@query("late_not_known", f"""
SELECT transaction_id, copy, batch_id FROM judged l
WHERE late AND batch_id >= {SPLIT}
  AND NOT EXISTS (SELECT 1 FROM ledger_events e WHERE e.batch_id < {SPLIT} AND e.transaction_id = l.transaction_id)
""")  # fmt: skip
def late_not_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    late = ledger.judged.where(f"late AND batch_id >= {SPLIT}").select("transaction_id", "copy", "batch_id")
    return unseen(late, ledger.events.where(f"batch_id < {SPLIT}"))


@query("touched_windows", f"SELECT DISTINCT window_start, window_end, merchant_id FROM judged WHERE NOT late AND batch_id = {SPLIT}")
def touched_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return touched(Ledger(spark, sf_dir).judged.where(f"NOT late AND batch_id = {SPLIT}"))


@query("refresh_windows", f"""
SELECT window_start, window_end, merchant_id, count(*) AS tx_count, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amount
FROM ledger_events e
WHERE batch_id <= {SPLIT} AND EXISTS (
  SELECT 1 FROM judged j WHERE NOT late AND batch_id = {SPLIT} AND j.window_start = e.window_start AND j.merchant_id = e.merchant_id)
GROUP BY ALL
""")  # fmt: skip
def refresh_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    own = touched(ledger.judged.where(f"NOT late AND batch_id = {SPLIT}"))
    return refreshed(ledger.events.where(f"batch_id <= {SPLIT}"), own)


@query("close_windows", f"""
SELECT t.window_start, t.window_end, t.merchant_id
FROM (SELECT DISTINCT window_start, window_end, merchant_id FROM ledger_events WHERE batch_id <= {SPLIT}) t
WHERE t.window_end <= (SELECT watermark FROM chain WHERE batch_id = {SPLIT})
""")  # fmt: skip
def close_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    windows = touched(ledger.events.where(f"batch_id <= {SPLIT}")).withColumn("is_final", F.lit(False))
    mark = ledger.chain.where(f"batch_id = {SPLIT}").select("watermark")  # one row
    closed = due(windows.crossJoin(F.broadcast(mark)), F.col("watermark"))
    return closed.select("window_start", "window_end", "merchant_id")


# --- keyed writes: even batches stand, odd ones come ---

_HALVES = """, halves AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id, batch_id % 2 ORDER BY batch_id, pos, copy) AS own FROM feed
)
"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = feed(spark, sf_dir)
    order = ["batch_id", "pos", "copy"]
    return tuple(
        first_arrival(rows.where(F.col("batch_id") % 2 == k), order).select("transaction_id", "merchant_id", "amount", "batch_id")
        for k in (0, 1)
    )


@query("merge_insert_only", _HALVES + """
SELECT transaction_id, merchant_id, amount, batch_id FROM halves WHERE batch_id % 2 = 0 AND own = 1
UNION ALL
SELECT transaction_id, merchant_id, amount, batch_id FROM halves h WHERE batch_id % 2 = 1 AND own = 1
  AND NOT EXISTS (SELECT 1 FROM halves t WHERE t.batch_id % 2 = 0 AND t.transaction_id = h.transaction_id)
""")  # fmt: skip
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _halves(spark, sf_dir)
    return insert_only(target, source, ["transaction_id"])


@query("merge_upsert", _HALVES + """
, target AS (SELECT * FROM halves WHERE batch_id % 2 = 0 AND own = 1), source AS (SELECT * FROM halves WHERE batch_id % 2 = 1 AND own = 1)
SELECT coalesce(t.transaction_id, s.transaction_id) AS transaction_id, coalesce(t.merchant_id, s.merchant_id) AS merchant_id,
       coalesce(t.amount, s.amount) AS amount, coalesce(s.batch_id, t.batch_id) AS batch_id
FROM target t FULL JOIN source s ON t.transaction_id = s.transaction_id
""")  # fmt: skip
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _halves(spark, sf_dir)
    return upsert(target, source, ["transaction_id"], ["batch_id"])


# --- the tables ---


@query("ledger_events", "SELECT * FROM ledger_events")
def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).events


@query("ledger_late_events", "SELECT * FROM ledger_late")
def ledger_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).late_events


@query("ledger_merchant_windows", "SELECT * FROM ledger_windows")
def ledger_merchant_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).windows


@query("ledger_stream_state", "SELECT * FROM ledger_state")
def ledger_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).state


@query("stream_file_ledger", "SELECT * FROM ledger_windows")
def stream_file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job itself over the feed's batches, written as files and read as a stream."""
    from tidemark.streaming.replay import run_feed

    store = run_feed(spark, sf_dir, _work_folder(spark))
    return store.table("merchant_windows").select(
        instant_to_ntz("window_start").alias("window_start"), instant_to_ntz("window_end").alias("window_end"), "merchant_id",
        "tx_count", "total_amount", "is_final", "updated_batch_id",
    )


def _work_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return tempfile.mkdtemp(prefix="ledger-", dir=mounted(shared_dir(spark)))


# --- reads ---


@query("previous_state", f"""
SELECT batch_id, watermark, max_event_time FROM ledger_state WHERE batch_id < {SPLIT} ORDER BY batch_id DESC LIMIT 1
""")  # fmt: skip
def previous_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = Ledger(spark, sf_dir).state.where(f"batch_id < {SPLIT}")
    return state.orderBy(F.desc("batch_id")).limit(1).select("batch_id", "watermark", "max_event_time")


@query("stamped_counts", "SELECT batch_id, count(*) AS stamped FROM ledger_events GROUP BY batch_id")
def stamped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).events.groupBy("batch_id").agg(F.count("*").alias("stamped"))


@query("final_windows", "SELECT window_start, merchant_id, tx_count, total_amount, updated_batch_id FROM ledger_windows WHERE is_final")
def final_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Ledger(spark, sf_dir).windows.where("is_final")
    return rows.select("window_start", "merchant_id", "tx_count", "total_amount", "updated_batch_id")


@query("last_batches", """
SELECT batch_id, rows_in, rows_on_time, rows_late, rows_duplicate, strftime(watermark, '%H:%M:%S') AS watermark,
       strftime(processing_time, '%H:%M:%S') AS processed_at
FROM ledger_state ORDER BY batch_id DESC LIMIT 10
""")  # fmt: skip
def last_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    counts = ["batch_id", "rows_in", "rows_on_time", "rows_late", "rows_duplicate"]
    # the newest are picked first (a top ten a task), then set in order
    newest = Ledger(spark, sf_dir).state.sort(F.col("batch_id").desc()).limit(10)
    return newest.select(*counts, clock("watermark").alias("watermark"), clock("processing_time").alias("processed_at")).sort("batch_id")


@query("table_sizes", """
SELECT 'events' AS table_name, count(*) AS n_rows FROM ledger_events UNION ALL
SELECT 'late_events', count(*) FROM ledger_late UNION ALL
SELECT 'merchant_windows', count(*) FROM ledger_windows UNION ALL
SELECT 'stream_state', count(*) FROM ledger_state
""")  # fmt: skip
def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(Ledger(spark, sf_dir)).items()
    sizes = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables]
    return reduce(DataFrame.unionAll, sizes)


@query("recount", """
SELECT window_start, merchant_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM ledger_events GROUP BY ALL
""")  # fmt: skip
def recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Ledger(spark, sf_dir).events.groupBy("window_start", "merchant_id")
    return rows.agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"))


@query("ledger_reconcile", """
SELECT CAST(sum(rows_in) AS BIGINT) AS rows_in, CAST(sum(rows_on_time) AS BIGINT) AS rows_on_time,
       CAST(sum(rows_late) AS BIGINT) AS rows_late, CAST(sum(rows_duplicate) AS BIGINT) AS rows_duplicate,
       (SELECT count(*) FROM ledger_events) AS events, (SELECT count(*) FROM ledger_late) AS late_events
FROM ledger_state
""")  # fmt: skip
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants.reconciled(_tables(Ledger(spark, sf_dir)))


# --- invariants; some over a damaged copy, so that they have something to find ---


def _damaged(ledger: Ledger) -> dict[str, DataFrame]:
    """Every table with a few rows made wrong, by rules that SQL states too."""
    t = _tables(ledger)
    bad_window = F.col("merchant_id").cast("long") % 11 == 3
    events = t["events"].unionAll(t["events"].where("CAST(transaction_id AS BIGINT) % 101 = 5"))
    return t | {
        "events": events.withColumn(
            "processing_time",
            F.when(F.expr("CAST(transaction_id AS BIGINT) % 103 = 7"), F.col("event_time")).otherwise(F.col("processing_time")),
        ),
        "late_events": t["late_events"].withColumn(
            "lateness_seconds",
            F.when(F.expr("CAST(transaction_id AS BIGINT) % 50 = 7"), -F.col("lateness_seconds")).otherwise(F.col("lateness_seconds")),
        ),
        "merchant_windows": t["merchant_windows"]
        .withColumn("tx_count", F.when(bad_window, F.col("tx_count") + 1).otherwise(F.col("tx_count")))
        .withColumn("updated_batch_id", F.when(bad_window, F.col("updated_batch_id") - 3).otherwise(F.col("updated_batch_id"))),
        "stream_state": t["stream_state"].withColumn(
            "watermark", F.when(F.expr("batch_id % 7 = 3"), F.expr("watermark - INTERVAL 5 DAYS")).otherwise(F.col("watermark"))
        ),
    }


_DAMAGED = """
, bad_events AS (
  SELECT * REPLACE (CASE WHEN CAST(transaction_id AS BIGINT) % 103 = 7 THEN event_time ELSE processing_time END AS processing_time)
  FROM (SELECT * FROM ledger_events UNION ALL SELECT * FROM ledger_events WHERE CAST(transaction_id AS BIGINT) % 101 = 5)
), bad_late AS (
  SELECT * REPLACE (CASE WHEN CAST(transaction_id AS BIGINT) % 50 = 7 THEN -lateness_seconds ELSE lateness_seconds END AS lateness_seconds)
  FROM ledger_late
), bad_windows AS (
  SELECT * REPLACE (CASE WHEN CAST(merchant_id AS BIGINT) % 11 = 3 THEN tx_count + 1 ELSE tx_count END AS tx_count,
                    CASE WHEN CAST(merchant_id AS BIGINT) % 11 = 3 THEN updated_batch_id - 3 ELSE updated_batch_id END AS updated_batch_id)
  FROM ledger_windows
), bad_state AS (
  SELECT * REPLACE (CASE WHEN batch_id % 7 = 3 THEN watermark - INTERVAL 5 DAY ELSE watermark END AS watermark) FROM ledger_state
)
"""


LOGGED_SQL = """
, logged AS (
  SELECT event_time, CASE WHEN CAST(transaction_id AS BIGINT) % 109 = 5 THEN event_time ELSE processing_time END AS processing_time,
         CASE WHEN CAST(transaction_id AS BIGINT) % 107 = 3 THEN processing_time + INTERVAL 1 SECOND
              ELSE event_time + INTERVAL 1 SECOND END AS kafka_timestamp
  FROM ledger_events
)
"""


@query("recount_mismatch", _DAMAGED + """
SELECT coalesce(e.window_start, w.window_start) AS window_start, coalesce(e.merchant_id, w.merchant_id) AS merchant_id,
       e.n, e.total, w.tx_count, w.total_amount
FROM (SELECT window_start, merchant_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM bad_events GROUP BY ALL) e
FULL JOIN bad_windows w ON e.window_start = w.window_start AND e.merchant_id = w.merchant_id
WHERE e.n IS DISTINCT FROM w.tx_count OR e.total IS DISTINCT FROM w.total_amount
""")  # fmt: skip
def recount_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = invariants.mismatched(_damaged(Ledger(spark, sf_dir)))
    return rows.select("window_start", "merchant_id", "n", "total", "tx_count", "total_amount")


def _violations(name: str, key: str, check, sql: str) -> None:
    text = _DAMAGED + f"SELECT '{name}' AS check_name, CAST(({sql}) AS BIGINT) AS violations"
    query(key, text)(lambda spark, sf_dir: check(_damaged(Ledger(spark, sf_dir))))


_violations("one row per transaction", "no_duplicates_check", invariants.one_row_a_transaction, """
  SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM
    (SELECT transaction_id FROM bad_events UNION ALL SELECT transaction_id FROM bad_late) GROUP BY transaction_id)
""")  # fmt: skip
_violations("late rows carry their evidence", "late_evidence_check", invariants.late_has_evidence, """
  SELECT count(*) FROM bad_late WHERE window_end > watermark_at_arrival OR lateness_seconds <= 0
""")  # fmt: skip
_violations("watermark never moves backwards", "watermark_monotonic_check", invariants.watermark_monotonic, """
  SELECT sum(CAST(watermark_applied IS DISTINCT FROM before AS INT) + CAST(coalesce(watermark < before, false) AS INT))
  FROM (SELECT *, lag(watermark) OVER (ORDER BY batch_id) AS before, row_number() OVER (ORDER BY batch_id) AS place FROM bad_state)
  WHERE place > 1
""")  # fmt: skip
_violations("final windows never change", "final_frozen_check", invariants.final_windows_frozen, """
  SELECT (SELECT count(*) FROM bad_events e JOIN bad_windows w ON e.window_start = w.window_start AND e.merchant_id = w.merchant_id
   WHERE w.is_final AND e.batch_id > w.updated_batch_id)
  + (SELECT count(*) FROM bad_windows WHERE NOT is_final AND window_end <= (SELECT max(watermark) FROM bad_state))
""")  # fmt: skip
_violations("two clocks", "two_clocks_check", invariants.two_clocks, """
  SELECT count(*) FROM bad_events WHERE processing_time = event_time
""")  # fmt: skip


@query("two_clocks_broker_check", LOGGED_SQL + """
SELECT 'two clocks' AS check_name,
       CAST(count(*) FILTER (WHERE processing_time = event_time) + count(*) FILTER (WHERE processing_time < kafka_timestamp) AS BIGINT) AS violations
FROM logged
""")  # fmt: skip
def two_clocks_broker_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the log's time, in some of which the log has them after they were processed."""
    number = F.col("transaction_id").cast("long")
    after = F.when(number % 107 == 3, F.expr("processing_time + INTERVAL 1 SECOND"))
    same = F.when(number % 109 == 5, F.col("event_time")).otherwise(F.col("processing_time"))
    logged = Ledger(spark, sf_dir).events.withColumn("kafka_timestamp", F.coalesce(after, F.expr("event_time + INTERVAL 1 SECOND")))
    return invariants.two_clocks({"events": logged.withColumn("processing_time", same)})


@query("all_invariants", """
SELECT unnest(['ledger matches tables', 'one row per transaction', 'windows equal a fresh recount', 'late rows carry their evidence',
               'watermark never moves backwards', 'final windows never change', 'two clocks']) AS check_name,
       CAST(0 AS BIGINT) AS violations
""")  # fmt: skip
def all_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over tables that are written once, not built anew by each check."""
    folder = f"{shared_dir(spark)}/invariants-{uuid.uuid4().hex}"
    stored = {}
    for name, rows in _tables(Ledger(spark, sf_dir)).items():
        rows.write.parquet(f"{folder}/{name}")
        stored[name] = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
    return invariants.all_checks(stored)
