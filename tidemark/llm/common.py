"""What the operators share: cutting lineage, ASCII words and case, ids, memory of workers."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import shared_dir

#: Java and RE2 class of the separators ``[\x20\x09-\x0D]``.
SPACE = r"[ \t-\r]"
#: The same characters as a string.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Stands for a null id: ordered before every other id.
NO_ID = -(2**63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` computed once: written as a Parquet table in the shared folder and read again, so that a lost
    executor costs a read and later reads prune columns. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(line: Column) -> Column:
    """``A-Z`` lower-cased and nothing else; the slow character map runs only where ``lower`` would touch other letters."""
    rest = F.regexp_replace(line, r"[\x00-\x7f]+", "")
    return (
        F.when(F.octet_length(line) == F.char_length(line), F.lower(line))
        .when(F.lower(rest) == rest, F.lower(line))
        .otherwise(F.translate(line, _UPPER, _LOWER))
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def id_column(df: DataFrame, name: str = "doc_id") -> Column:
    """The integer id, with a null standing before every other id."""
    return F.coalesce(df[name].cast("long"), F.lit(NO_ID))


def restored(column: Column) -> Column:
    """Undo ``id_column``."""
    return F.when(column != F.lit(NO_ID), column)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, where ``PYTHONPATH`` or the working folder doesn't already."""
    package = Path(__file__).resolve().parents[1]
    home = str(package.parent)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in known or getattr(ship, "done", None) == spark.sparkContext.applicationId:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", home, package.name)
    spark.sparkContext.addPyFile(archive)
    ship.done = spark.sparkContext.applicationId


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for ``mapInArrow``; when a task ends its worker gives freed memory back to the system, as idle workers live on."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
