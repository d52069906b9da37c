"""Every registered ledger query against its SQL, on the small tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"stream_file_ledger"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(frame: pd.DataFrame) -> list:
    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and pd.isna(x)):
            return None
        return round(float(x), 6) if isinstance(x, (float, Decimal)) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([value(x) for x in row]) for row in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs) and len(ours)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_the_job_equals_the_single_plan(spark, tmp_path):
    """The real stream over the feed, against the plan that knows no batches."""
    from tidemark.functions.clock import instant_to_ntz
    from tidemark.plans.ledger import Ledger
    from tidemark.streaming.checks import run_checks
    from tidemark.streaming.replay import run_feed

    store, ledger = run_feed(spark, DATA, str(tmp_path)), Ledger(spark, DATA)
    assert all(r.ok for r in run_checks(store) if r.name != "two clocks")
    for table, plan in (("merchant_windows", ledger.windows), ("events", ledger.events), ("late_events", ledger.late_events)):
        stored = store.table(table)
        for name, kind in stored.dtypes:
            if kind == "timestamp":
                stored = stored.withColumn(name, instant_to_ntz(name))
        columns = [c for c in plan.columns if c not in ("processing_time",)]
        assert plain(stored.select(*columns).toPandas()) == plain(plan.select(*columns).toPandas()), table
