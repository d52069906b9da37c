"""Batches of payments for the scenarios, and a plain model of the ledger to hold it against."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import Decimal

from conftest import at, parsed_schema

from tidemark.config import Settings
from tidemark.streaming.batch import process_batch
from tidemark.streaming.store import LedgerStore


def payment(name, seconds, merchant="M1", amount="10.00", offset=None, sent=None):
    """A parsed record; ``seconds`` may be None for one without an event time."""
    when = None if seconds is None else at(seconds)
    log_time = sent if sent is not None else at((seconds or 0) + 1)
    return [name, merchant, "A00001", amount, "BRL", "pix", when, 0, offset, log_time]


class Runner:
    """A ledger in a folder of its own, and batches into it."""

    def __init__(self, spark, folder, fault=None, window=60, lateness=120):
        self.spark = spark
        self.settings = Settings(root=str(folder), checkpoint=f"{folder}-checkpoint", window_seconds=window, allowed_lateness_seconds=lateness)
        self.store = LedgerStore(spark, str(folder), fault)

    def frame(self, rows):
        rows = [[*r[:8], i if r[8] is None else r[8], r[9]] for i, r in enumerate(rows)]
        return self.spark.createDataFrame([tuple(r) for r in rows], parsed_schema())

    def run(self, number, rows, now=100_000):
        return process_batch(self.spark, self.frame(rows), number, self.settings, store=self.store, now=at(now))

    def ids(self, table, batch=None):
        return {r["transaction_id"] for r in self.store.table(table, batch=batch).select("transaction_id").collect()}

    def rows(self, table):
        return sorted(map(tuple, self.store.table(table).collect()), key=repr)

    def windows(self):
        found = self.store.table("merchant_windows").collect()
        return {(int((r["window_start"].replace(tzinfo=at(0).tzinfo) - at(0)).total_seconds()), r["merchant_id"]): r for r in found}


@dataclass
class Model:
    """The ledger, one record after the other."""

    window: int = 60
    lateness: int = 120
    events: dict = field(default_factory=dict)
    late: dict = field(default_factory=dict)
    state: list = field(default_factory=list)
    newest: datetime | None = None

    def run(self, number, rows):
        applied = self.state[-1]["watermark"] if self.state else None
        order = sorted(enumerate(rows), key=lambda p: (p[1][9], p[1][7], p[0] if p[1][8] is None else p[1][8]))
        on_time = late = 0
        for _, r in order:
            start = at(0) + timedelta(seconds=(r[6] - at(0)).total_seconds() // self.window * self.window)
            end = start + timedelta(seconds=self.window)
            if r[0] in self.events or r[0] in self.late:
                continue
            if applied is not None and end <= applied:
                self.late[r[0]] = (applied, (applied - r[6]).total_seconds())
                late += 1
            else:
                self.events[r[0]] = (start, r[1], Decimal(r[3]), number)
                on_time += 1
        times = [r[6] for r in rows] + ([self.newest] if self.newest else [])
        self.newest = max(times, default=None)
        mark = self.newest - timedelta(seconds=self.lateness) if self.newest else None
        self.state.append({"applied": applied, "watermark": mark, "counts": (len(rows), on_time, late, len(rows) - on_time - late)})

    def totals(self):
        out: dict = {}
        for start, merchant, amount, _ in self.events.values():
            n, total = out.get((int((start - at(0)).total_seconds()), merchant), (0, Decimal(0)))
            out[int((start - at(0)).total_seconds()), merchant] = (n + 1, total + amount)
        return out
