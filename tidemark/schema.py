"""Column layouts: the record on the wire, and the four tables of the ledger.

Three clocks stay apart: ``event_time`` (set by the sender, the only one that windows), ``kafka_timestamp`` (when the log
took the record) and ``processing_time`` (one value a batch). Money is DECIMAL(18,2), a string on the wire.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _table(spec: str) -> T.StructType:
    """``name type`` items, ``!`` after the type for not null."""
    kinds = {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "money": MONEY,
    }
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


WIRE = _table(
    "transaction_id string, merchant_id string, account_id string, amount string, currency string, "
    "method string, event_time timestamp"
)
EVENTS = _table(
    "transaction_id string!, merchant_id string!, account_id string, amount money!, currency string, method string, "
    "event_time timestamp!, window_start timestamp!, window_end timestamp!, kafka_partition int, kafka_offset long, "
    "kafka_timestamp timestamp, processing_time timestamp!, batch_id long!"
)
LATE_EVENTS = T.StructType(EVENTS.fields + _table("watermark_at_arrival timestamp!, lateness_seconds double!").fields)
MERCHANT_WINDOWS = _table(
    "window_start timestamp!, window_end timestamp!, merchant_id string!, tx_count long!, total_amount money!, "
    "is_final boolean!, updated_batch_id long!, updated_at timestamp!"
)
STREAM_STATE = _table(
    "batch_id long!, watermark_applied timestamp, max_event_time timestamp, watermark timestamp, rows_in long!, "
    "rows_on_time long!, rows_late long!, rows_duplicate long!, processing_time timestamp!"
)
TABLES = {
    "events": EVENTS,
    "late_events": LATE_EVENTS,
    "merchant_windows": MERCHANT_WINDOWS,
    "stream_state": STREAM_STATE,
}
KEYS = {
    "events": ["transaction_id"],
    "late_events": ["transaction_id"],
    "merchant_windows": ["window_start", "merchant_id"],
    "stream_state": ["batch_id"],
}
#: What an arriving record must have; anything else stops its batch before a write.
REQUIRED = ("transaction_id", "merchant_id", "amount", "event_time")
