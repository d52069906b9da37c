"""Keyed writes as joins: insert what is new, replace what matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_only(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it lacks; what stands is never touched."""
    return target.unionByName(source.join(target.select(*key), list(key), "left_anti"))


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], update: Sequence[str]) -> DataFrame:
    """``target`` with the ``update`` columns of matching rows of ``source``, and its other rows."""
    old, new = target.alias("old"), source.alias("new")
    on = None
    for name in key:
        same = F.col(f"old.{name}") == F.col(f"new.{name}")
        on = same if on is None else on & same
    has_old, has_new = F.col(f"old.{key[0]}").isNotNull(), F.col(f"new.{key[0]}").isNotNull()
    columns = []
    for name in target.columns:
        if name in key:
            value = F.coalesce(f"old.{name}", f"new.{name}")
        elif name in update:
            value = F.when(has_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        else:
            value = F.when(has_old, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))
        columns.append(value.alias(name))
    return old.join(new, on, "full").select(*columns)


def latest(changes: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The newest row of each key of a changelog: one aggregation, combined before the shuffle."""
    rest = [c for c in changes.columns if c not in key]
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(*key, "_row.*").select(*changes.columns)
