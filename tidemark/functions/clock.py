"""Timestamps as epoch microseconds, without the session's time zone.

``TIMESTAMP_NTZ`` columns count as UTC. Python's datetimes cross the border to the JVM as microseconds only.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_micros(moment: datetime | None) -> int | None:
    return None if moment is None else (moment - EPOCH) // timedelta(microseconds=1)


def from_micros(micros: int | None) -> datetime | None:
    return None if micros is None else EPOCH + timedelta(microseconds=micros)


def instant(micros: int | None) -> Column:
    """A TIMESTAMP literal."""
    return F.timestamp_micros(F.lit(micros).cast("long"))


def ntz_micros(name: str) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(MICROSECOND, {_NTZ_EPOCH}, {name})")


def ntz_to_instant(name: str) -> Column:
    return F.timestamp_micros(ntz_micros(name))


def instant_to_ntz(name: str) -> Column:
    """A TIMESTAMP column as TIMESTAMP_NTZ in UTC."""
    return F.expr(f"{_NTZ_EPOCH} + unix_micros({name}) * INTERVAL '0.000001' SECOND")
