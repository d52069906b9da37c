"""Records on the wire: JSON in, JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import MONEY, WIRE


def parse(raw: DataFrame) -> DataFrame:
    """``value`` (JSON, binary or string), ``partition, offset, timestamp`` to typed columns.

    Text that is no JSON gives nulls throughout, a bad time a null time; an amount that is no decimal stops the job.
    """
    event = F.from_json(F.col("value").cast("string"), WIRE)
    flat = raw.select(event.alias("event"), "partition", "offset", "timestamp").select(
        "event.*",
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").cast("long").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
    )
    return flat.withColumn("amount", F.col("amount").cast(MONEY))


def encode(time: Column, digits: int = 3) -> Column:
    """The wire form of a row with the wire's columns; ``time`` is its event time as a TIMESTAMP, to ``digits`` of a second."""
    names = [f.name for f in WIRE.fields if f.name != "event_time"]
    fields = [F.col(n).cast("string").alias(n) for n in names]
    return F.to_json(
        F.struct(*fields, time.alias("event_time")),
        {"timestampFormat": f"yyyy-MM-dd'T'HH:mm:ss.{'S' * digits}xxx", "timeZone": "UTC"},
    )
