"""Streaming sources of raw records: files by default, Kafka where its connector is on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.config import Settings

RAW = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def json_files(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of one JSON object a line, with the columns of a log's records."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def kafka(spark: SparkSession, settings: Settings) -> DataFrame:
    """A topic; loss of data stops the query, and a trigger takes a bounded number of records."""
    options = {
        "kafka.bootstrap.servers": settings.bootstrap_servers,
        "subscribe": settings.topic,
        "startingOffsets": settings.starting_offsets,
        "maxOffsetsPerTrigger": str(settings.max_offsets_per_trigger),
        "failOnDataLoss": "true",
    }
    return spark.readStream.format("kafka").options(**options).load().select("value", "partition", "offset", "timestamp")
