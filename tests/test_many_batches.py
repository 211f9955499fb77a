"""Streams over several batches: late rows, state that ends, files that change."""

import datetime as dt
import hashlib
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from folioscope.sources import listing
from folioscope.streaming import ingest, jobs

T0 = dt.datetime(2024, 5, 1)
NAMES = ("stream_late_rows", "stream_units_with_end", "stream_unfinished_spans", "stream_ingest")


@pytest.mark.parametrize("name", NAMES)
def test_stream_of_many_batches_equals_its_sql(spark, sf, name):
    from tools.check_queries import TABLES, compare

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    message, good = compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], sf)
    assert good, message


def test_late_rows_are_counted_by_window(spark, tmp_path):
    schema = "arrival int, started_at timestamp, category string, status string"
    at = lambda hours: T0 + dt.timedelta(hours=hours, minutes=5)
    rows = [(0, at(0), "c", "ok"), (0, at(4), "c", "error"), (1, at(1), "c", "ok"), (1, at(2), "d", "error"), (1, at(9), "c", "ok"), (2, at(4), "c", "error"), (2, at(8), "c", "error"), (3, None, "c", "ok")]
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    given = spark.createDataFrame(rows, schema)
    batches = []

    def run(stream):
        jobs.error_rates_with_late(stream, "1 hour", dt.timedelta(hours=2), state, target)
        batches.append(jobs.rates_with_late(spark, target).count())

    jobs.replay(given, "arrival", "late", run)
    got = {((r["window_start"] - T0).seconds // 3600, r["category"]): (r["span_count"], r["error_count"], r["late_count"]) for r in jobs.rates_with_late(spark, target).collect()}
    # after the first arrival the newest time is 4:05, so windows that end by 2:05 are closed; after the second 7:05
    assert got == {(0, "c"): (1, 0, 0), (4, "c"): (1, 1, 1), (1, "c"): (0, 0, 1), (2, "d"): (1, 1, 0), (9, "c"): (1, 0, 0), (8, "c"): (1, 1, 0)}
    assert batches == [2, 5, 6, 6]


def test_state_of_ended_units_is_dropped(spark, tmp_path):
    schema = "arrival int, ingest_run_id long, work_key string, ts timestamp, seq long, status string"
    rows = []
    for day in range(8):
        for k in range(20):
            at = T0 + dt.timedelta(days=day, minutes=k)
            rows += [(day, 1, f"unit-{day}-{k}", at, 2 * k, "running"), (day, 1, f"unit-{day}-{k}", at + dt.timedelta(minutes=1), 2 * k + 1, "ok")]
    rows += [(1, 1, "again", T0 + dt.timedelta(days=1), 90, "error"), (4, 1, "again", T0 + dt.timedelta(days=4), 91, "running")]
    inbox_state, target = str(tmp_path / "state"), str(tmp_path / "out")
    kept, tables = [], []

    def run(stream):
        live = jobs.live_units_with_end(stream.drop("arrival"), dt.timedelta(days=2), dt.timedelta(hours=1))
        tables.append(jobs.run_to_table(live, "units", "update", inbox_state, target, kept))

    jobs.replay(spark.createDataFrame(rows, schema), "arrival", "units", run)
    last = {(r["work_key"], r["opened_at"]): (r["status"], r["attempt_count"]) for r in jobs.latest_updates(tables[-1], ["work_key", "opened_at"]).collect()}
    assert len(last) == 8 * 20 + 2 and last["again", T0 + dt.timedelta(days=4)] == ("running", 1) and last["again", T0 + dt.timedelta(days=1)] == ("error", 0)
    assert len(kept) == 8 and max(kept) <= 2 * 20 + 1
    assert set(v for k, v in last.items() if k[0] != "again") == {("ok", 1)}


def test_files_that_change_move_and_stay(spark, tmp_path):
    folder, inbox, store, state = tmp_path / "in", str(tmp_path / "inbox"), str(tmp_path / "store"), str(tmp_path / "state")
    (folder / ".hidden").mkdir(parents=True)
    for name, body in (("a.pdf", b"one"), ("_b.txt", b"two"), (".hidden/c", b"three"), ("same", b"one")):
        (folder / name).write_bytes(body)
    day = lambda n: dt.datetime(2024, 1, n)
    ingest.announce(spark, str(folder), inbox, day(1))
    ingest.ingest(spark, inbox, store, state)
    (folder / "a.pdf").write_bytes(b"changed")
    os.rename(folder / "_b.txt", folder / "d.txt")
    os.utime(folder / ".hidden" / "c", (1, 1))
    ingest.announce(spark, str(folder), inbox, day(2))
    ingest.ingest(spark, inbox, store, state)
    ingest.ingest(spark, inbox, store, state)
    log = {(r["scanned_at"].day, os.path.relpath(r["path"], folder)): (r["status"], r["read"]) for r in ingest.ingest_log(spark, store).collect()}
    assert log == {
        (1, "a.pdf"): ("new", True), (1, "_b.txt"): ("new", True), (1, ".hidden/c"): ("new", True), (1, "same"): ("new", True),
        (2, "a.pdf"): ("changed", True), (2, "d.txt"): ("moved", True), (2, ".hidden/c"): ("unchanged", True), (2, "same"): ("unchanged", False),
    }
    digest = lambda body: hashlib.sha256(body).hexdigest()
    files = {r["file_hash"]: (r["filename"], r["first_seen_at"].day, r["last_seen_at"].day) for r in ingest.stored_files(spark, store).collect()}
    assert files == {digest(b"one"): ("same", 1, 2), digest(b"two"): ("d.txt", 1, 2), digest(b"three"): ("c", 1, 2), digest(b"changed"): ("a.pdf", 2, 2)}
    places = {(os.path.relpath(r["path"], folder), r["file_hash"]): r["newest"] for r in ingest.stored_locations(spark, store).collect()}
    assert places == {("a.pdf", digest(b"one")): False, ("a.pdf", digest(b"changed")): True, ("_b.txt", digest(b"two")): True, ("d.txt", digest(b"two")): True, (".hidden/c", digest(b"three")): True, ("same", digest(b"one")): True}


def test_files_are_put_and_removed_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "x" / f"{i}"), bytes([i])) for i in range(5)], "path string, body binary")
    listing.put_files(rows.repartition(3))
    listing.put_files(rows.limit(1).select("path", F.lit(None).cast("binary").alias("body")))
    assert len(os.listdir(tmp_path / "x")) == 4


def test_news_of_a_unit_are_ordered_without_pandas(monkeypatch):
    """One call for each unit and batch: rows of several frames, out of order, are told in the order of their time."""
    class State:
        hasTimedOut, exists, kept = False, False, None

        def update(self, value):
            self.kept = value

        def setTimeoutTimestamp(self, at):
            self.at = at

    def refuse(*args, **options):
        raise AssertionError("a frame was joined or sorted for one unit")

    monkeypatch.setattr(pd, "concat", refuse)
    monkeypatch.setattr(pd.DataFrame, "sort_values", refuse)
    at = lambda hour: pd.Timestamp(2024, 1, 1, hour)
    frames = [pd.DataFrame({"ts": [at(t) for t, _, _ in rows], "seq": [n for _, n, _ in rows], "status": [s for *_, s in rows]}) for rows in ([(3, 2, "ok"), (1, 0, "running")], [(3, 1, "running"), (9, 3, "running")])]
    state = State()
    shown = pd.DataFrame(next(jobs._unit_updater(dt.timedelta(hours=12), dt.timedelta(hours=1))((1, "u"), iter(frames), state)))
    assert [tuple(r) for r in shown[["status", "attempt_count"]].itertuples(index=False)] == [("ok", 2), ("running", 1)]
    assert shown["finished_at"].iloc[0] == at(3) and state.kept[0] == at(9)
