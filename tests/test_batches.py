"""Watermark, lateness, dedup, closing: second-exact scenarios."""

from __future__ import annotations

import pytest
from conftest import at
from ledger_tools import Runner, payment

from tidemark.streaming.batch import MalformedBatch


@pytest.fixture
def ledger(spark, tmp_path):
    return Runner(spark, tmp_path / "ledger")


def test_first_batch_has_no_late_rows(ledger):
    report = ledger.run(0, [payment("a", -3600), payment("b", 600)])
    assert (report.rows_on_time, report.rows_late) == (2, 0)
    assert report.watermark_applied is None and report.watermark == at(480)


def test_past_closed_window_is_late_with_evidence(ledger):
    ledger.run(0, [payment("a", 600)])
    report = ledger.run(1, [payment("b", 300)])
    assert (report.rows_on_time, report.rows_late) == (0, 1)
    row = ledger.store.table("late_events").first()
    assert row["watermark_at_arrival"].replace(tzinfo=at(0).tzinfo) == at(480) and row["lateness_seconds"] == 180.0
    assert len(row) == 16


@pytest.mark.parametrize(("first", "second", "late"), [(600, 500, 0), (610, 485, 0), (600, 479, 1), (600, 480, 0)])
def test_lateness_is_of_the_window_end(ledger, first, second, late):
    ledger.run(0, [payment("a", first)])
    assert ledger.run(1, [payment("b", second)]).rows_late == late


def test_watermark_does_not_fall(ledger):
    ledger.run(0, [payment("a", 600)])
    report = ledger.run(1, [payment("b", 100), payment("c", 50)])
    assert report.rows_late == 2 and report.watermark == at(480)


def test_chain_of_watermarks(ledger):
    reports = [ledger.run(i, [payment(str(i), s)]) for i, s in enumerate((600, 900, 700))]
    assert [r.watermark_applied for r in reports] == [None, at(480), at(780)]
    assert [r.watermark for r in reports] == [at(480), at(780), at(780)]


def test_empty_batch_keeps_the_watermark(ledger):
    ledger.run(0, [payment("a", 600)])
    report = ledger.run(1, [])
    assert report.watermark == at(480) and report.rows_in == 0
    assert ledger.store.table("stream_state").count() == 2


def test_windows_close_and_stay(ledger):
    ledger.run(0, [payment("a", 10), payment("b", 50)])
    assert not ledger.windows()[0, "M1"]["is_final"]
    ledger.run(1, [payment("c", 300)])
    closed = ledger.windows()[0, "M1"]
    assert closed["is_final"] and closed["updated_batch_id"] == 1 and closed["tx_count"] == 2
    assert ledger.run(2, [payment("d", 30)]).rows_late == 1
    assert ledger.windows()[0, "M1"] == closed


def test_window_made_and_closed_in_one_batch(ledger):
    ledger.run(0, [payment("a", 10), payment("b", 1000)])
    assert ledger.windows()[0, "M1"]["is_final"]


@pytest.mark.parametrize("column", [0, 1, 3, 6])
def test_malformed_stops_before_a_write(ledger, column):
    bad = payment("b", 20)
    bad[column] = None
    with pytest.raises(MalformedBatch):
        ledger.run(0, [payment("a", 10), bad])
    assert ledger.store.batches() == [] and ledger.store.table("events").count() == 0


def test_first_arrival_wins_in_a_batch(ledger):
    sent = at(100)
    ledger.run(0, [payment("a", 10, amount="99.00", offset=8, sent=sent), payment("a", 10, amount="10.00", offset=7, sent=sent)])
    row = ledger.store.table("events").first()
    assert row["kafka_offset"] == 7 and str(row["amount"]) == "10.00"


def test_copy_in_a_later_batch_is_absorbed(ledger):
    ledger.run(0, [payment("a", 10)])
    report = ledger.run(1, [payment("a", 10)])
    assert report.rows_duplicate == 1 and ledger.store.table("events").first()["batch_id"] == 0


def test_late_copy_of_a_known_row_is_a_duplicate(ledger):
    ledger.run(0, [payment("a", 100), payment("b", 600)])
    report = ledger.run(1, [payment("a", 100)])
    assert (report.rows_late, report.rows_duplicate) == (0, 1) and ledger.ids("late_events") == set()


def test_late_id_sent_again_on_time_stays_late(ledger):
    ledger.run(0, [payment("a", 600)])
    ledger.run(1, [payment("b", 100)])
    report = ledger.run(2, [payment("b", 700)])
    assert report.rows_duplicate == 1 and ledger.ids("events") == {"a"}


def test_clocks_are_kept_apart(ledger):
    ledger.run(0, [payment("a", 30)], now=86_400)
    row, window = ledger.store.table("events").first(), ledger.windows()[0, "M1"]
    zone = at(0).tzinfo
    assert row["event_time"].replace(tzinfo=zone) == at(30) and row["processing_time"].replace(tzinfo=zone) == at(86_400)
    assert window["updated_at"].replace(tzinfo=zone) == at(86_400)


def test_amounts_round_half_up_and_bad_ones_stop(ledger):
    ledger.run(0, [payment("a", 10, amount="12.345"), payment("b", 11, amount="-12.345")])
    assert sorted(str(r["amount"]) for r in ledger.store.table("events").collect()) == ["-12.35", "12.35"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ledger.run(1, [payment("c", 12, amount="abc")])
    assert ledger.store.batches() == [0]


def test_a_batch_takes_few_jobs(spark, ledger):
    """Its records are read and shuffled once, its keys go to the history, one aggregation totals its windows."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    for number in range(3):
        before = jobs()
        report = ledger.run(number, [payment(f"{number}{i}", 600 * number + 60 * i, merchant=f"M{i}") for i in range(-10, 4)])
        taken = jobs() - before
    assert report.rows_late and report.rows_on_time
    assert taken <= 14
