"""Streaming jobs against their batch forms, and the registered queries."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as contract
from folioscope.operators import runs
from folioscope.plans.registry import QUERIES
from folioscope.sources import keyed
from folioscope.streaming import jobs

T0 = dt.datetime(2024, 5, 1)
LOG = "ingest_run_id long, work_key string, seq long, ts timestamp, status string, error string"
SAMPLE = ("file_upsert", "character_chunks", "ranked_snippets", "layout_regions", "five_breakdowns", "best_pages", "stream_sessions")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def log_files(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_live_units_equal_batch_over_many_batches(spark, tmp_path):
    order = ["planned", "running", "error", "running", "ok"]
    rows = [(1, f"k{i % 5}", i, T0 + dt.timedelta(seconds=i), order[(i // 5) % 5], None) for i in range(60)]
    stream = log_files(spark, str(tmp_path / "in"), [rows[:20], rows[20:40], rows[40:]])
    table = jobs.run_to_table(jobs.live_units(stream), "live", "update")
    assert table.select("batch_id").distinct().count() == 3
    live = jobs.latest_updates(table, ["ingest_run_id", "work_key"])
    batch = runs.current_units(spark.createDataFrame(rows, LOG))
    columns = ["work_key", "status", "attempt_count", "started_at"]
    assert sorted(map(tuple, live.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "started_at timestamp, category string, status string"
    hours = [[0, 1, 2], [9], [0, 9]]
    for i, part in enumerate(hours):
        rows = [(T0 + dt.timedelta(hours=h, minutes=5), "c", "error") for h in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    table = jobs.run_to_table(jobs.error_rates(stream, "1 hour", delay="1 hour"), "late", "update")
    counts = {r["window_start"].hour: r["error_count"] for r in jobs.latest_updates(table, ["window_start", "category"]).collect()}
    assert counts == {0: 1, 1: 1, 2: 1, 9: 2}


def test_spans_complete_within_bounds(spark, tmp_path):
    starts = [(1, "a", "c", T0), (1, "b", "c", T0 + dt.timedelta(minutes=1))]
    ends = [(1, "a", T0 + dt.timedelta(seconds=3), "ok"), (1, "b", T0 + dt.timedelta(hours=5), "ok")]
    spark.createDataFrame(starts, "ingest_run_id long, span_id string, category string, started_at timestamp").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame(ends, "ingest_run_id long, span_id string, ended_at timestamp, status string").write.parquet(str(tmp_path / "e"))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    rows = jobs.run_to_table(jobs.complete_spans(read("s"), read("e")), "pairs").collect()
    assert [(r["span_id"], r["duration_ms"]) for r in rows] == [("a", 3000.0)]


def test_incremental_files_pick_up_only_new_ones(spark, tmp_path):
    inbox, table, state = tmp_path / "inbox", str(tmp_path / "files"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"one")

    def stream():
        return spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(str(inbox)).schema).load(str(inbox))

    seen = []

    def merge(batch, _batch_id):
        rows = [r["filename"] for r in batch.select("filename").collect()]
        seen.extend(rows)
        batch.select("file_hash", "filename").write.mode("append").parquet(table)

    jobs.incremental_upsert(jobs.incremental_files(stream()), merge, state)
    (inbox / "b.pdf").write_bytes(b"two")
    jobs.incremental_upsert(jobs.incremental_files(stream()), merge, state)
    assert sorted(seen) == ["a.pdf", "b.pdf"]
    stored = spark.read.parquet(table)
    assert keyed.upsert(stored, stored, ["file_hash"]).count() == 2


def test_entry_runs(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["query_id", "position", "chunk_id", "score", "snippet"]
    assert rows.count() > 0


def test_registry_is_consistent():
    names, sql = set(contract.queries()), set(contract.oracle_sql())
    assert sql <= names and len(names) >= 120
    assert set(QUERIES) - sql == {"global_search"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf, name):
    from tools.check_queries import compare

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    message, good = compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], sf)
    assert good, message


def test_matching_plan_has_no_cross_join(spark, sf):
    plan = contract.queries()["chunk_text_matches"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_id", "ingest_run_id")
    plan = runs.filter_rows(events, run_id=5).select("value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,5)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    """Large tables are folders of files; an empty one gives no batch, and no rows."""
    rows = [(1, "one text", "en", "web", 8), (2, "one text", "en", "web", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, made in (("full", rows), ("none", [])):
        spark.createDataFrame(made, schema).repartition(2).write.parquet(str(tmp_path / name / "documents.parquet"))
    found = contract.queries()["stream_new_files"](spark, str(tmp_path / "full")).collect()
    assert [row["path_count"] for row in found] == [2]
    stream = jobs.parquet_stream(spark, str(tmp_path / "none" / "documents.parquet"), schema)
    (tmp_path / "none" / "documents.parquet" / "_SUCCESS").touch()
    assert jobs.run_to_table(stream.filter("doc_id > 5"), "none").count() == 0
