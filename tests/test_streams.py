"""The wire, the streaming query over files, restarts, the generator and the command lines."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import sys
import time
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from conftest import START, at

from tidemark.config import Settings
from tidemark.session import build_session
from tidemark.sources.generator import Feed, Knobs, Undelivered, encode, main, to_files, to_kafka
from tidemark.sources.streams import RAW, json_files
from tidemark.sources.wire import parse
from tidemark.streaming import checks
from tidemark.streaming.query import start_query
from tidemark.streaming.store import LedgerStore

CLOCK = lambda: at(0)


def wire(name, seconds, zone="+00:00", **more):
    event = {"transaction_id": name, "merchant_id": "M1", "account_id": "A00001", "amount": "12.34", "currency": "BRL", "method": "pix",
             "event_time": at(seconds).replace(tzinfo=None).isoformat(timespec="milliseconds") + zone}
    return json.dumps(event | more)


def test_wire_forms(spark):
    texts = [wire("a", 30), wire("b", 30, "Z"), "{broken", wire("c", 30, extra=1), wire("d", 30, amount=5)]
    raw = spark.createDataFrame([(t, 0, i, at(31)) for i, t in enumerate(texts)], RAW)
    rows = parse(raw).orderBy("kafka_offset").collect()
    assert [r["transaction_id"] for r in rows] == ["a", "b", None, "c", "d"]
    assert {r["event_time"] for r in rows if r["event_time"]} == {at(30).replace(tzinfo=None)}
    assert str(rows[0]["amount"]) == "12.34" and str(rows[4]["amount"]) == "5.00"


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"value": r, "partition": 0, "offset": number * 100 + i, "timestamp": at(86_400).isoformat()}) for i, r in enumerate(rows)]
    path = folder / f"{number:04d}.json"
    path.write_text("\n".join(lines) + "\n")
    # the source takes the oldest first
    os.utime(path, (START + number, START + number))


def run(spark, source, settings):
    query = start_query(spark, parse(json_files(spark, str(source))), settings, available_now=True, now=lambda n: at(200_000 + n))
    query.awaitTermination()


def test_stream_restart_and_idle_restart(spark, tmp_path):
    source, settings = tmp_path / "in", Settings(root=str(tmp_path / "ledger"), checkpoint=str(tmp_path / "checkpoint"))
    put(source, 0, [wire(f"a{i}", i) for i in range(3)])
    put(source, 1, [wire(f"b{i}", 100 + i) for i in range(3)])
    run(spark, source, settings)
    store = LedgerStore(spark, settings.root)
    assert [s["batch_id"] for s in store.states(store.log())] == [0, 1]
    run(spark, source, settings)
    assert [s["batch_id"] for s in store.states(store.log())] == [0, 1]
    put(source, 2, [wire("a0", 0), wire("c0", 200)])
    run(spark, source, settings)
    assert [s["batch_id"] for s in store.states(store.log())] == [0, 1, 2] and store.table("events").count() == 7 and checks.ingested(store) == 8
    assert all(r.ok for r in checks.run_checks(store))
    # a lost checkpoint: everything comes again under numbers of its own, and is known
    run(spark, source, Settings(root=settings.root, checkpoint=str(tmp_path / "other")))
    assert [s["batch_id"] for s in store.states(store.log())] == [0, 1, 2, 3, 4, 5] and store.table("events").count() == 7
    assert store.table("stream_state").where("rows_duplicate < 0").count() == 0
    assert all(r.ok for r in checks.run_checks(store))


def test_waiting(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    assert checks.wait_for_rows(store, 0, 1) == 0
    with pytest.raises(TimeoutError):
        checks.wait_for_rows(store, 1, 0.05, pause=0.01)


def test_generated_feed_through_the_stream(spark, tmp_path):
    now = {"s": 0.0}

    def clock():
        now["s"] += 0.5
        return at(now["s"])

    kinds = to_files(Feed(Knobs(count=240, seed=5), clock), str(tmp_path / "in"), 120, clock)
    settings = Settings(root=str(tmp_path / "ledger"), checkpoint=str(tmp_path / "checkpoint"))
    run(spark, tmp_path / "in", settings)
    store = LedgerStore(spark, settings.root)
    assert checks.ingested(store) == sum(kinds.values()) == 240
    assert store.table("events").count() + store.table("late_events").count() == kinds["fresh"] + kinds["late"]
    assert all(r.ok for r in checks.run_checks(store))


class Broker:
    """Takes what a Kafka producer takes; refuses some, and is full now and then."""

    def __init__(self, refuse=(), stuck=0):
        self.taken, self.open, self.refuse, self.stuck, self.full = [], [], set(refuse), stuck, 0

    def produce(self, topic, key, value, on_delivery):
        if len(self.open) >= 3:
            self.full += 1
            raise BufferError("full")
        self.taken.append((topic, key, json.loads(value)))
        self.open.append((on_delivery, "refused" if len(self.taken) in self.refuse else None))

    def poll(self, seconds):
        while seconds and self.open:
            answer, error = self.open.pop(0)
            answer(error, None)

    def flush(self):
        self.poll(1)
        return self.stuck


def test_events_to_a_broker():
    broker = Broker()
    kinds = to_kafka(Feed(Knobs(count=40, seed=2), CLOCK), broker, "payments")
    assert len(broker.taken) == sum(kinds.values()) == 40 and broker.full > 0
    assert all(topic == "payments" and key == event["merchant_id"] for topic, key, event in broker.taken)
    assert [e for _, _, e in broker.taken] == [e for e, _ in Feed(Knobs(count=40, seed=2), CLOCK)]
    with pytest.raises(Undelivered, match="2 refused"):
        to_kafka(Feed(Knobs(count=9), CLOCK), Broker(refuse=(2, 5)), "payments")
    with pytest.raises(Undelivered, match="4 still waiting"):
        to_kafka(Feed(Knobs(count=9), CLOCK), Broker(stuck=4), "payments")
    began = time.monotonic()
    to_kafka(Feed(Knobs(count=5), CLOCK), Broker(), "payments", rate=25)
    assert 0.15 <= time.monotonic() - began < 2


KILLED = """
import sys
from conftest import SESSION, at
from pyspark.sql import SparkSession
from tidemark.config import Settings
from tidemark.sources.streams import json_files
from tidemark.sources.wire import parse
from tidemark.streaming.query import start_query

root = sys.argv[1]
spark = SparkSession.builder.config(map=SESSION | {"spark.master": "local[2]", "spark.driver.memory": "1g"}).getOrCreate()
settings = Settings(root=f"{root}/ledger", checkpoint=f"{root}/checkpoint")
start_query(spark, parse(json_files(spark, f"{root}/in")), settings, available_now=True, now=lambda n: at(200_000 + n)).awaitTermination()
"""


def test_a_killed_process(spark, tmp_path):
    """SIGKILL to the driver and its JVM while batches land; the restart finishes, and everything is there once."""
    now = {"s": 0.0}

    def clock():
        now["s"] += 0.5
        return at(now["s"])

    kinds = to_files(Feed(Knobs(count=480, seed=9), clock), str(tmp_path / "in"), 40, clock)
    script = tmp_path / "job.py"
    script.write_text(KILLED)
    home = Path(__file__).resolve().parent
    env = os.environ | {"PYTHONPATH": f"{home.parent}{os.pathsep}{home}"}
    job = subprocess.Popen([sys.executable, str(script), str(tmp_path)], env=env, start_new_session=True, stderr=subprocess.DEVNULL)
    settings = Settings(root=str(tmp_path / "ledger"), checkpoint=str(tmp_path / "checkpoint"))
    store, end = LedgerStore(spark, settings.root), time.monotonic() + 120
    while len(store._numbers("_commits")) < 3 and time.monotonic() < end and job.poll() is None:
        time.sleep(0.05)
    assert job.poll() is None
    os.killpg(job.pid, signal.SIGKILL)
    job.wait()
    before = store.newest()
    assert 2 <= before < 11 and all(r.ok for r in checks.run_checks(store))
    run(spark, tmp_path / "in", settings)
    assert store.newest() == 11 and checks.ingested(store) == 480
    assert store.table("events").count() + store.table("late_events").count() == kinds["fresh"] + kinds["late"]
    assert all(r.ok for r in checks.run_checks(store))


def test_command_line(spark, tmp_path, capsys):
    """Exit codes and what is printed, on a good ledger and on one whose log was tampered with."""
    settings = Settings(root=str(tmp_path / "ledger"), checkpoint=str(tmp_path / "checkpoint"))
    put(tmp_path / "in", 0, [wire("a", 600), wire("b", 30)])
    put(tmp_path / "in", 1, [wire("c", 100), wire("d", 900), wire("a", 600)])
    run(spark, tmp_path / "in", settings)
    root = ["--root", settings.root]
    level = spark.sparkContext.setLogLevel
    assert checks.main([*root, "--ingested"]) == 0 and capsys.readouterr().out == "5\n"
    assert checks.main([*root, "--status", "--wait-for-rows", "5"]) == 0
    shown = capsys.readouterr().out
    assert "events" in shown and "3 rows" in shown and "stream_state" in shown and "rows_duplicate" in shown
    assert checks.main(root) == 0
    said = capsys.readouterr().out
    assert "5 in, 3 on time, 1 late, 1 copies" in said and "7 of 7 hold" in said and "FAIL" not in said
    assert checks.main([*root, "--wait-for-rows", "6", "--timeout", "0"]) == 2
    path = tmp_path / "ledger" / "_commits" / f"{1:020d}.json"
    path.write_text(path.read_text().replace('"rows_on_time": 1', '"rows_on_time": 2'))
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert checks.main(root) == 1
    said = capsys.readouterr().out
    assert "FAIL ledger matches tables: 2 violations" in said and "6 of 7 hold" in said
    level("ERROR")


def test_a_trigger_of_time(spark, tmp_path):
    """Without ``available_now`` the query goes on, takes what comes later, and stops when asked."""
    settings = Settings(root=str(tmp_path / "ledger"), checkpoint=str(tmp_path / "checkpoint"), trigger_seconds=1)
    put(tmp_path / "in", 0, [wire("a", 600)])
    query = start_query(spark, parse(json_files(spark, str(tmp_path / "in"))), settings, now=lambda n: at(200_000 + n))
    store = LedgerStore(spark, settings.root)
    try:
        checks.wait_for_rows(store, 1, 60, pause=0.2)
        put(tmp_path / "in", 1, [wire("b", 700), wire("c", 10)])
        assert checks.wait_for_rows(store, 3, 60, pause=0.2) == 3
    finally:
        query.stop()
    assert store.newest() == 1 and all(r.ok for r in checks.run_checks(store))


def test_session(spark):
    found = build_session("other", shuffle_partitions=4, spark__sql__ansi__enabled="true")
    assert found.conf.get("spark.sql.session.timeZone") == "UTC" and found.conf.get("spark.sql.adaptive.enabled") == "true"


def test_generator_repeats_itself():
    make = lambda seed: [(encode(e), k) for e, k in Feed(Knobs(count=100, seed=seed), CLOCK)]
    assert make(1) == make(1) != make(2) and len(make(1)) == 100


def test_generator_kinds():
    knobs = Knobs(count=2000, seed=3, late_fraction=0.2, duplicate_fraction=0.2)
    seen, kinds = {}, {"fresh": 0, "late": 0, "duplicate": 0}
    for event, kind in Feed(knobs, CLOCK):
        kinds[kind] += 1
        if kind == "duplicate":
            assert seen[event["transaction_id"]] == event
        seen[event["transaction_id"]] = event
        age = at(0) - datetime.fromisoformat(event["event_time"])
        if kind == "late":
            assert age >= timedelta(seconds=185)
        elif kind == "fresh":
            assert age <= timedelta(seconds=5.001)
        assert len(event["amount"].partition(".")[2]) == 2
    assert 250 < kinds["late"] < 450 and 300 < kinds["duplicate"] < 500


def test_generator_in_order_without_shuffling():
    tick = iter(range(10**6))
    feed = Feed(Knobs(count=50, shuffle=1, jitter_seconds=0, late_fraction=0, duplicate_fraction=0), lambda: at(next(tick)))
    times = [e["event_time"] for e, _ in feed]
    assert times == sorted(times)


def test_generator_command(capsys):
    main(["--count", "5", "--seed", "1"])
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == 5 and json.loads(lines[0])["currency"] == "BRL"


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("TIDEMARK_WINDOW_SECONDS", "30")
    monkeypatch.setenv("TIDEMARK_TRIGGER_SECONDS", "")
    found = Settings.from_env()
    assert found.window == timedelta(seconds=30) and found.trigger_seconds == 5
    assert at(0).tzinfo == timezone.utc
