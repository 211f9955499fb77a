"""Run analytics, work planning and streaming over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import ids, kinds
from folioscope.functions.grouping import top_per_group
from folioscope.operators import runs, work
from folioscope.plans import corpus, roles
from folioscope.plans.registry import query, view
from folioscope.session import scratch_path
from folioscope.sources import files, keyed, listing
from folioscope.streaming import ingest, jobs

RUN = runs.RUN


def rounded(*names: str) -> list[Column]:
    return [F.round(name, 3).alias(name) for name in names]


def us(name: str) -> Column:
    return runs.micros(F.col(name))


SPAN_TOTALS = """
    CAST(count(*) AS BIGINT) AS span_count, CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS error_count, CAST(count(DISTINCT file_hash) AS BIGINT) AS file_count,
    CAST(count(DISTINCT file_hash || ':' || page_no) AS BIGINT) AS page_count, min(ts_us) AS first_us, max(end_us) AS last_us
"""
view("run_totals", f"SELECT ingest_run_id, {SPAN_TOTALS} FROM span_rows GROUP BY 1")


# --- runs and traces ---------------------------------------------------------


@query(
    "run_list",
    "SELECT r.ingest_run_id, round(greatest(0, last_us - first_us) / 1000.0, 3) AS duration_ms, span_count, error_count, file_count, page_count FROM run_rows r JOIN run_totals USING (ingest_run_id)",
)
def run_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.run_list(roles.runs(spark, sf), roles.spans(spark, sf))
    return rows.select(RUN, *rounded("duration_ms"), "span_count", "error_count", "file_count", "page_count")


@query("newest_runs", "SELECT ingest_run_id, started_us FROM run_rows ORDER BY started_us DESC, ingest_run_id DESC LIMIT 5")
def newest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.newest_runs(roles.runs(spark, sf), 5).select(RUN, us("started_at").alias("started_us"))


@query("latest_run", "SELECT arg_max(ingest_run_id, (started_us, ingest_run_id)) AS ingest_run_id FROM run_rows")
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest_run(roles.runs(spark, sf))


@query(
    "trace_spans",
    """
    SELECT span_id, ingest_run_id, ts_us AS started_us FROM span_rows WHERE status = 'error' AND page_no = 2
      AND (name ILIKE '%e_ror%' OR pipeline_step ILIKE '%e_ror%' OR category ILIKE '%e_ror%' OR coalesce(annotation_engine, '') ILIKE '%e_ror%' OR coalesce(error_message, '') ILIKE '%e_ror%')
    """,
)
def trace_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Failed spans of one page number with a wildcard in the text filter."""
    rows = runs.trace_spans(roles.spans(spark, sf), status="error", page_no=2, text=" E_ror ")
    return rows.select("span_id", RUN, us("started_at").alias("started_us"))


@query("trace_events", "SELECT span_id FROM span_rows WHERE file_hash = 'file-7' AND (name ILIKE '%RUN-1%' OR coalesce(error_message, '') ILIKE '%RUN-1%')")
def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    events = roles.spans(spark, sf).withColumn("message", F.col("error_message"))
    return runs.trace_events(events, status="error", file_hash="file-7", text="RUN-1").select("span_id")


@query("trace_summary", "SELECT status, span_count, error_count, file_count, page_count, round(greatest(0, last_us - first_us) / 1000.0, 3) AS duration_ms FROM (SELECT status, " + SPAN_TOTALS + " FROM span_rows GROUP BY 1)")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.trace_summary(roles.spans(spark, sf), ["status"])
    return rows.select("status", "span_count", "error_count", "file_count", "page_count", *rounded("duration_ms"))


@query(
    "event_scope",
    "SELECT e.span_id, coalesce(s.file_hash, 'own-' || e.user_id) AS file_hash, coalesce(s.page_no, e.user_id) AS page_no FROM span_rows e LEFT JOIN span_rows s ON s.ingest_run_id = e.ingest_run_id AND s.span_id = e.parent_span_id",
)
def event_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a parent span: its file and page, else their own."""
    spans = roles.spans(spark, sf)
    events = spans.select(
        RUN, F.col("span_id").alias("event"), F.col("parent_span_id").alias("span_id"),
        F.concat(F.lit("own-"), F.col("user_id").cast("string")).alias("file_hash"), F.col("user_id").alias("page_no"),
    )
    return runs.scope_events(events, spans).select(F.col("event").alias("span_id"), "file_hash", "page_no")


# --- progress ----------------------------------------------------------------


@query(
    "work_unit_rows",
    """
    SELECT work_unit_id, filename, coalesce(path, '/in/user-' || user_id || '.pdf') AS source_path,
           CAST(CASE phase WHEN 'orientation' THEN 1 WHEN 'artifact' THEN 2 WHEN 'annotation' THEN 3 WHEN 'markdown' THEN 4 ELSE 9 END AS INTEGER) AS phase_rank
    FROM unit_rows LEFT JOIN run_files USING (file_hash) LEFT JOIN (SELECT file_hash, min(path) AS path FROM run_locations GROUP BY 1) USING (file_hash)
    """,
)
def work_unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = named_units(spark, sf).select("work_unit_id", "filename", "source_path", "phase")
    return rows.select("work_unit_id", "filename", "source_path", runs.phase_rank(F.col("phase")).alias("phase_rank"))


def named_units(spark: SparkSession, sf: str) -> DataFrame:
    return runs.work_unit_rows(roles.work_units(spark, sf), roles.run_files(spark, sf), roles.run_locations(spark, sf))


@query(
    "first_units_in_order",
    """
    SELECT ingest_run_id, work_unit_id, CAST(pos AS INTEGER) AS pos FROM (SELECT ingest_run_id, work_unit_id, row_number() OVER (PARTITION BY ingest_run_id ORDER BY
      CASE phase WHEN 'orientation' THEN 1 WHEN 'artifact' THEN 2 WHEN 'annotation' THEN 3 WHEN 'markdown' THEN 4 ELSE 9 END, 'local:' || engine, file_hash NULLS FIRST, page_no NULLS FIRST, work_unit_id) AS pos FROM unit_rows) WHERE pos <= 25
    """,
)
def first_units_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of the progress list of every run."""
    units = roles.work_units(spark, sf)
    return runs.top_per_group(units, [RUN], runs.work_unit_order(), 25, "pos").select(RUN, "work_unit_id", "pos")


@query(
    "progress_summary",
    """
    SELECT ingest_run_id, CAST(count(*) AS BIGINT) AS total_units, CAST(count(*) FILTER (WHERE status = 'planned') AS BIGINT) AS planned_units, CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS completed_units,
           CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS failed_units, round(count(*) FILTER (WHERE status IN ('ok', 'error', 'skipped')) * 100.0::DOUBLE / count(*), 3) AS percent_complete,
           round(avg(duration_ms) FILTER (WHERE status IN ('ok', 'error', 'skipped')) * (count(*) FILTER (WHERE status NOT IN ('ok', 'error', 'skipped'))), 3) AS estimated_remaining_ms
    FROM unit_rows GROUP BY 1
    """,
)
def progress_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.progress_summary(roles.work_units(spark, sf))
    return rows.select(RUN, "total_units", "planned_units", "completed_units", "failed_units", *rounded("percent_complete", "estimated_remaining_ms"))


@query(
    "progress_tree",
    """
    SELECT ingest_run_id, file_key, page_key, phase_key, unit_key, CAST(4 - bit_count(g) AS INTEGER) AS node_level, round(duration_ms, 3) AS duration_ms, CAST(unit_count AS BIGINT) AS unit_count, status FROM (
      SELECT ingest_run_id, file_key, page_key, phase_key, unit_key, CAST(grouping_id(ingest_run_id, file_key, page_key, phase_key, unit_key) AS INTEGER) AS g, sum(coalesce(duration_ms, 0)) AS duration_ms, count(*) AS unit_count,
        CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'ok') THEN 'ok' WHEN bool_and(status = 'skipped') THEN 'skipped' ELSE 'planned' END AS status
      FROM (SELECT ingest_run_id, coalesce(file_hash, 'run') AS file_key, coalesce(CAST(page_no AS VARCHAR), 'document') AS page_key, phase AS phase_key, work_unit_id AS unit_key, status, duration_ms FROM unit_rows)
      GROUP BY ROLLUP (ingest_run_id, file_key, page_key, phase_key, unit_key)) WHERE ingest_run_id IS NOT NULL
    """,
)
def progress_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.progress_tree(roles.work_units(spark, sf))
    return rows.select(RUN, "file_key", "page_key", "phase_key", "unit_key", "node_level", *rounded("duration_ms"), "unit_count", "status")


# --- breakdowns --------------------------------------------------------------


@query(
    "five_breakdowns",
    """
    SELECT ingest_run_id, kind, id, label, round(d, 3) AS duration_ms, CAST(n AS BIGINT) AS unit_count, CAST(errors AS BIGINT) AS error_count, CAST(files AS BIGINT) AS file_count, CAST(pages AS BIGINT) AS page_count,
           round(longest, 3) AS max_duration_ms, round(d / total * 100, 3) AS share_percent
    FROM (SELECT *, sum(d) OVER (PARTITION BY ingest_run_id, kind) AS total, row_number() OVER (PARTITION BY ingest_run_id, kind ORDER BY round(d, 6) DESC, id) AS rank FROM (
      SELECT ingest_run_id, kind, id, min(label) AS label, sum(coalesce(duration_ms, 0)) AS d, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS errors, count(DISTINCT file_hash) AS files,
             count(DISTINCT file_hash || ':' || page_no) AS pages, max(coalesce(duration_ms, 0)) AS longest
      FROM (SELECT *, unnest(['phase', 'engine', 'model', 'file', 'page']) AS kind, unnest([phase, phase || ':' || engine, provider || ':' || model, file_hash, file_hash || ':' || page_no]) AS id,
                   unnest([phase, phase || ' / ' || engine, provider || ' / ' || model, flabel, flabel || ' · page ' || page_no]) AS label
            FROM (SELECT u.*, coalesce(filename, regexp_extract(path, '[^/]*$'), 'user-' || user_id || '.pdf') AS flabel FROM unit_rows u LEFT JOIN run_files USING (file_hash)
                  LEFT JOIN (SELECT file_hash, min(path) AS path FROM run_locations GROUP BY 1) USING (file_hash)))
      WHERE id IS NOT NULL GROUP BY 1, 2, 3)) WHERE rank <= 50
    """,
)
def five_breakdowns(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.five_breakdowns(named_units(spark, sf), 50)
    return rows.select(
        RUN, "kind", "id", "label", *rounded("duration_ms"), "unit_count", "error_count", "file_count", "page_count", *rounded("max_duration_ms", "share_percent")
    )


@query(
    "error_breakdown",
    """
    SELECT ingest_run_id, id, round(sum(duration_ms), 3) AS duration_ms, CAST(count(*) AS BIGINT) AS unit_count, CAST(count(DISTINCT file_hash) AS BIGINT) AS file_count,
           coalesce(arg_max(error_message, (duration_ms, span_id)) FILTER (WHERE error_message <> ''), '-') AS sample_error, round(coalesce(sum(duration_ms) / any_value(wall) * 100, 0), 3) AS share_percent
    FROM (SELECT *, coalesce(nullif(annotation_engine, ''), nullif(category, ''), pipeline_step) AS id FROM span_rows WHERE status = 'error')
    JOIN (SELECT ingest_run_id, (finished_us - started_us) / 1000.0::DOUBLE AS wall FROM run_rows) USING (ingest_run_id) GROUP BY 1, 2
    """,
)
def error_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    walls = roles.runs(spark, sf).select(RUN, runs.elapsed_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))
    known = walls.withColumn("duration_ms", F.when(F.col("duration_ms") > 0, F.col("duration_ms")))
    rows = runs.error_breakdown(roles.spans(spark, sf), known)
    return rows.select(RUN, "id", *rounded("duration_ms"), "unit_count", "file_count", F.coalesce("sample_error", F.lit("-")).alias("sample_error"), *rounded("share_percent"))


SUMMARY = """
    SELECT r.ingest_run_id, coalesce((finished_us - started_us) / 1000.0::DOUBLE, nullif(unit_ms, 0), span_ms) AS duration_ms, u.n AS work_unit_count, u.failed AS failed_work_unit_count,
           coalesce(l.n, 0) AS model_lease_count, failed_llm AS failed_llm_duration_ms
    FROM run_rows r LEFT JOIN (SELECT ingest_run_id, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS failed, sum(duration_ms) AS unit_ms FROM unit_rows GROUP BY 1) u USING (ingest_run_id)
    LEFT JOIN (SELECT ingest_run_id, sum(duration_ms) AS span_ms, coalesce(sum(duration_ms) FILTER (WHERE status = 'error' AND pipeline_step = 'lmstudio_chat_completion'), 0) AS failed_llm FROM span_rows GROUP BY 1) s USING (ingest_run_id)
    LEFT JOIN (SELECT ingest_run_id, count(*) AS n FROM lease_rows GROUP BY 1) l USING (ingest_run_id)
"""
view("run_summary", SUMMARY)


def run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return runs.analytics_summary(roles.runs(spark, sf), roles.work_units(spark, sf), roles.spans(spark, sf), roles.leases(spark, sf))


@query(
    "analytics_summary",
    "SELECT ingest_run_id, round(duration_ms, 3) AS duration_ms, CAST(work_unit_count AS BIGINT) AS work_unit_count, CAST(failed_work_unit_count AS BIGINT) AS failed_work_unit_count, CAST(model_lease_count AS BIGINT) AS model_lease_count, round(failed_llm_duration_ms, 3) AS failed_llm_duration_ms FROM run_summary",
)
def analytics_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_summaries(spark, sf)
    return rows.select(RUN, *rounded("duration_ms"), "work_unit_count", "failed_work_unit_count", "model_lease_count", *rounded("failed_llm_duration_ms"))


@query(
    "recommendations",
    """
    SELECT ingest_run_id, 'failed-llm-cost' AS id, 'high' AS severity FROM run_summary WHERE failed_llm_duration_ms / nullif(duration_ms, 0) > 0.2
    UNION ALL SELECT ingest_run_id, 'model-switches', 'medium' FROM run_summary WHERE model_lease_count > 1
    UNION ALL SELECT ingest_run_id, 'no-dominant-bottleneck', 'info' FROM run_summary WHERE NOT coalesce(failed_llm_duration_ms / nullif(duration_ms, 0) > 0.2, false) AND model_lease_count <= 1
    """,
)
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return runs.recommendations(run_summaries(spark, sf)).select(RUN, "id", "severity")


@query(
    "slowest_units",
    "SELECT ingest_run_id, work_unit_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ingest_run_id ORDER BY coalesce(duration_ms, 0) DESC, work_unit_id) AS rank FROM unit_rows) WHERE rank <= 10",
)
def slowest_units(spark: SparkSession, sf: str) -> DataFrame:
    return runs.slowest(roles.work_units(spark, sf), "work_unit_id", 10).select(RUN, "work_unit_id", "rank")


@query(
    "slowest_spans",
    "SELECT ingest_run_id, span_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ingest_run_id ORDER BY duration_ms DESC, span_id) AS rank FROM span_rows) WHERE rank <= 10",
)
def slowest_spans(spark: SparkSession, sf: str) -> DataFrame:
    return runs.slowest(roles.spans(spark, sf), "span_id", 10).select(RUN, "span_id", "rank")


@query(
    "model_leases",
    """
    SELECT ingest_run_id, lease_id, CAST(row_number() OVER (PARTITION BY ingest_run_id ORDER BY ts_us, lease_id) AS BIGINT) AS switch_index, CASE k % 3 WHEN 0 THEN '{"top_k":' || k || '}' WHEN 1 THEN '{"ctx":' || k || '}' ELSE '{"repeat_penalty":1.2}' END AS requested_parameters,
           CASE k % 3 WHEN 1 THEN 'loaded' ELSE '-' END AS load_status FROM lease_rows
    """,
)
def model_leases(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.model_leases(roles.leases(spark, sf))
    return rows.select(RUN, "lease_id", "switch_index", "requested_parameters", F.coalesce("load_status", F.lit("-")).alias("load_status"))


# --- span trees and timelines ------------------------------------------------

view(
    "span_depth",
    """
    SELECT s.ingest_run_id, s.span_id, 0 AS depth FROM span_rows s LEFT JOIN span_rows p ON p.ingest_run_id = s.ingest_run_id AND p.span_id = s.parent_span_id WHERE p.span_id IS NULL
    UNION ALL SELECT s.ingest_run_id, s.span_id, d.depth + 1 FROM span_rows s JOIN span_depth d ON d.ingest_run_id = s.ingest_run_id AND d.span_id = s.parent_span_id
    """,
)


@query("span_depths", "SELECT ingest_run_id, span_id, CAST(depth AS BIGINT) AS depth FROM span_depth")
def span_depths(spark: SparkSession, sf: str) -> DataFrame:
    return runs.span_depths(roles.spans(spark, sf))


view(
    "span_files",
    """
    SELECT s.ingest_run_id, s.span_id, s.file_hash FROM span_rows s LEFT JOIN span_rows p ON p.ingest_run_id = s.ingest_run_id AND p.span_id = s.parent_span_id WHERE p.span_id IS NULL
    UNION ALL SELECT s.ingest_run_id, s.span_id, coalesce(s.file_hash, d.file_hash) FROM span_rows s JOIN span_files d ON d.ingest_run_id = s.ingest_run_id AND d.span_id = s.parent_span_id
    """,
)


@query("inherited_files", "SELECT ingest_run_id, span_id, coalesce(file_hash, '-') AS file_hash FROM span_files")
def inherited_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.inherit_from_parents(roles.spans(spark, sf).select(RUN, "span_id", "parent_span_id", "file_hash"), ["file_hash"])
    return rows.select(RUN, "span_id", F.coalesce("file_hash", F.lit("-")).alias("file_hash"))


@query(
    "timeline",
    """
    SELECT s.span_id, d.depth, EXISTS (SELECT 1 FROM span_rows c WHERE c.ingest_run_id = s.ingest_run_id AND c.parent_span_id = s.span_id) AS has_children, round(left_pct, 3) AS left_pct,
           round(least(greatest(0.35, duration_ms / total * 100), greatest(0.35, 100 - left_pct)), 3) AS width_pct
    FROM (SELECT *, greatest(0, least(100, (ts_us - first_us) / 1000.0::DOUBLE / total * 100)) AS left_pct FROM (
      SELECT s.*, first_us, greatest(1, greatest(first_us / 1000.0::DOUBLE + 1, last_us / 1000.0::DOUBLE) - first_us / 1000.0::DOUBLE) AS total FROM span_rows s JOIN run_totals USING (ingest_run_id))) s
    JOIN (SELECT ingest_run_id, span_id, CAST(depth AS BIGINT) AS depth FROM span_depth) d ON d.ingest_run_id = s.ingest_run_id AND d.span_id = s.span_id
    """,
)
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    spans = roles.spans(spark, sf)
    rows = runs.timeline(spans, runs.span_depths(spans))
    return rows.select("span_id", "depth", "has_children", *rounded("left_pct", "width_pct"))


view(
    "span_hidden",
    """
    SELECT s.ingest_run_id, s.span_id, false AS hidden, s.status = 'error' AS closed FROM span_rows s LEFT JOIN span_rows p ON p.ingest_run_id = s.ingest_run_id AND p.span_id = s.parent_span_id WHERE p.span_id IS NULL
    UNION ALL SELECT s.ingest_run_id, s.span_id, d.hidden OR d.closed, s.status = 'error' FROM span_rows s JOIN span_hidden d ON d.ingest_run_id = s.ingest_run_id AND d.span_id = s.parent_span_id
    """,
)


@query("visible_timeline", "SELECT ingest_run_id, span_id FROM span_hidden WHERE NOT hidden")
def visible_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that stay when every failed span is collapsed."""
    spans = roles.spans(spark, sf).select(RUN, "span_id", "parent_span_id", "status")
    return runs.visible_timeline(spans, spans.filter("status = 'error'")).select(RUN, "span_id")


@query("first_errors", "SELECT ingest_run_id, arg_min(span_id, (ts_us, -duration_ms, span_id)) AS span_id FROM span_rows WHERE status = 'error' GROUP BY 1")
def first_errors(spark: SparkSession, sf: str) -> DataFrame:
    return runs.first_errors(roles.spans(spark, sf))


# --- logs --------------------------------------------------------------------


def span_log(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end records of every span."""
    spans = roles.spans(spark, sf)
    records = F.explode(F.array(F.lit("start"), F.lit("end"))).alias("record")
    rows = spans.select("*", records)
    at_start = F.col("record") == "start"
    return rows.select(
        RUN, "span_id", "parent_span_id", "name", "record", F.when(at_start, F.col("started_at")).otherwise(F.col("ended_at")).alias("ts"),
        "file_hash", F.when(at_start, F.col("page_no")).alias("page_no"), "annotation_engine",
        F.when(~at_start, F.col("status")).alias("status"), F.when(~at_start, F.col("error_message")).alias("error_message"),
    )


@query(
    "assembled_spans",
    "SELECT ingest_run_id, span_id, event_type || '_run_' || (k % 3) AS pipeline_step, 'pipeline' AS category, CASE WHEN status IN ('error', 'skipped') THEN status ELSE 'ok' END AS status, page_no, round(CAST(round(value * 10000) AS BIGINT) / 1000.0, 3) AS duration_ms FROM span_rows",
)
def assembled_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.assemble_spans(span_log(spark, sf))
    return rows.select(RUN, "span_id", "pipeline_step", "category", "status", "page_no", *rounded("duration_ms"))


@query(
    "span_names",
    "SELECT name, replace(replace(replace(name, 'ingest.', ''), '.', '_'), '-', '_') AS step, CASE WHEN contains(lower(name), 'markdown') THEN 'markdown' ELSE 'pipeline' END AS category, CAST(count(*) AS BIGINT) AS n FROM span_rows GROUP BY 1",
)
def span_names(spark: SparkSession, sf: str) -> DataFrame:
    named = roles.spans(spark, sf).groupBy("name").agg(F.count("*").alias("n"))
    return named.select("name", kinds.span_step(F.col("name"), "ingest.").alias("step"), kinds.span_category(F.col("name")).alias("category"), "n")


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a status record of the unit (run, file, phase)."""
    spans = roles.spans(spark, sf)
    key = F.concat_ws(":", "phase", F.coalesce("file_hash", F.lit("run")))
    return spans.select(RUN, key.alias("work_key"), F.col("event_id").alias("seq"), F.col("started_at").alias("ts"), "status", F.col("error_message").alias("error"))


CURRENT_UNITS = """
    SELECT ingest_run_id, work_key, arg_max(status, seq) AS status, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS attempt_count,
           coalesce(max(ts_us) FILTER (WHERE status = 'running'), -1) AS started_us, coalesce(CASE WHEN arg_max(status, seq) IN ('ok', 'error', 'skipped') THEN max(ts_us) END, -1) AS finished_us
    FROM (SELECT *, event_id AS seq, concat_ws(':', phase, coalesce(file_hash, 'run')) AS work_key FROM span_rows) GROUP BY 1, 2
"""


@query("current_units", CURRENT_UNITS)
def current_units(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.current_units(status_log(spark, sf))
    return rows.select(RUN, "work_key", "status", "attempt_count", F.coalesce(us("started_at"), F.lit(-1)).alias("started_us"), F.coalesce(us("finished_at"), F.lit(-1)).alias("finished_us"))


@query(
    "current_leases",
    "SELECT ingest_run_id, model AS lease_id, arg_max(status, event_id) AS status, min(ts_us) AS started_us, (max(ts_us) FILTER (WHERE status <> 'running') - min(ts_us)) // 1000 AS duration_ms FROM span_rows GROUP BY 1, 2",
)
def current_leases(spark: SparkSession, sf: str) -> DataFrame:
    log = roles.spans(spark, sf).select(
        RUN, F.col("model").alias("lease_id"), F.col("model").alias("execution_key"), F.col("event_id").alias("seq"),
        F.col("started_at").alias("ts"), "status", F.col("error_message").alias("error"),
    )
    return runs.current_leases(log).select(RUN, "lease_id", "status", us("started_at").alias("started_us"), "duration_ms")


def call_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the log of model calls: views ask, purchases answer, errors fail."""
    rows = roles.spans(spark, sf)
    names = {"view": "llm.request", "purchase": "llm.response", "error": "llm.error"}
    kind = F.coalesce(*[F.when(F.col("event_type") == old, F.lit(new)) for old, new in names.items()])
    attributes = F.to_json(
        F.struct(
            F.col("model").alias("llm.model"), F.col("phase").alias("llm.stage"), F.col("duration_ms").alias("llm.response.elapsed_ms"),
            F.col("duration_ms").alias("llm.error.elapsed_ms"), F.lit(200).alias("llm.response.status_code"), F.repeat(F.lit("x"), F.col("k")).alias("llm.response.content"),
        )
    )
    return rows.select(RUN, F.coalesce("file_hash", F.lit("run")).alias("span_id"), kind.alias("event_type"), attributes.alias("attributes_json"))


@query(
    "model_calls",
    """
    SELECT ingest_run_id, coalesce(file_hash, 'run') AS span_id, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS responses,
           CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, coalesce(max(model) FILTER (WHERE event_type = 'view'), '-') AS model,
           round(coalesce(sum(duration_ms) FILTER (WHERE event_type = 'error'), 0), 3) AS failed_ms, coalesce(max(k) FILTER (WHERE event_type = 'purchase'), -1) AS content_length
    FROM span_rows WHERE event_type IN ('view', 'purchase', 'error') GROUP BY 1, 2
    """,
)
def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.call_log(call_events(spark, sf))
    return rows.select(
        RUN, "span_id", "requests", "responses", "errors", F.coalesce("model", F.lit("-")).alias("model"),
        F.round(F.coalesce("failed_ms", F.lit(0.0)), 3).alias("failed_ms"), F.coalesce("content_length", F.lit(-1)).alias("content_length"),
    )


@query(
    "model_call_statistics",
    """
    SELECT ingest_run_id, model, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, round(sum(errors) / nullif(sum(requests), 0), 4) AS error_rate
    FROM (SELECT ingest_run_id, coalesce(file_hash, 'run'), count(*) FILTER (WHERE event_type = 'view') AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, coalesce(max(model) FILTER (WHERE event_type = 'view'), '-') AS model
          FROM span_rows WHERE event_type IN ('view', 'purchase', 'error') GROUP BY 1, 2) GROUP BY 1, 2
    """,
)
def model_call_statistics(spark: SparkSession, sf: str) -> DataFrame:
    calls = runs.call_log(call_events(spark, sf)).withColumns({"stage": F.lit("all"), "model": F.coalesce("model", F.lit("-"))})
    return runs.call_statistics(calls).select(RUN, "model", "requests", "errors", F.round("error_rate", 4).alias("error_rate"))


@query(
    "redacted_payloads",
    """SELECT doc_id, md5('{"url":"[diagnostic attachment on filesystem]","chars":' || length(text) || '}') AS payload_md5 FROM documents""",
)
def redacted_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads with each whole text as inline image data."""
    documents = roles.table(spark, sf, "documents")
    data = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "UTF-8")))
    payload = F.to_json(F.struct(data.alias("url"), F.length("text").alias("chars")))
    return documents.select("doc_id", F.md5(runs.redact_images(payload)).alias("payload_md5"))


@query(
    "payload_attachments",
    """
    SELECT doc_id, CAST(position AS INTEGER) AS position, CASE position WHEN 0 THEN 'image/png' ELSE 'image/jpeg' END AS media_type,
      CAST((CASE position WHEN 0 THEN 22 ELSE 23 END) + 4 * ((size + 2) // 3) + 2 * ((greatest(4 * ((size + 2) // 3), 1) - 1) // 76) AS BIGINT) AS data_url_chars, CAST(size AS BIGINT) AS bytes, sha256
    FROM (SELECT doc_id, 0 AS position, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 1, octet_length(encode(source || text)), sha256(source || text) FROM documents WHERE text IS NOT NULL)
    """,
)
def payload_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads with two inline images in lines of 76 characters, between them the text as it is; one row for each image."""
    documents = roles.table(spark, sf, "documents").filter("text IS NOT NULL")
    url = lambda kind, body: F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(F.encode(body, "UTF-8")))
    block = lambda value: F.struct(F.lit("image_url").alias("type"), F.struct(value.alias("url")).alias("image_url"))
    first, second = block(url("png", F.col("text"))), block(url("jpeg", F.concat("source", "text")))
    payload = F.to_json(F.struct(first.alias("one"), F.concat(F.lit('say "data:image/png" '), "text").alias("content"), F.array(second).alias("more")))
    return runs.image_attachments(documents.select("doc_id", payload.alias("payload")), "payload", ["doc_id"])


@query(
    "bounded_attributes",
    "SELECT doc_id, CAST(CASE WHEN length(text) > 500 THEN 515 ELSE length(text) END AS BIGINT) AS text_length, CAST(2 AS BIGINT) AS n_keys FROM documents",
)
def bounded_attributes(spark: SparkSession, sf: str) -> DataFrame:
    attributes = F.create_map(F.lit("text"), "text", F.lit("lang"), "lang", F.lit("missing"), F.lit(None).cast("string"))
    kept = work.truncated_map(attributes, 500)
    rows = roles.table(spark, sf, "documents").select("doc_id", kept.alias("m"))
    return rows.select("doc_id", F.length(F.col("m")["text"]).cast("long").alias("text_length"), F.size("m").cast("long").alias("n_keys"))


@query(
    "limited_attributes",
    """
    SELECT doc_id, CAST(CASE WHEN length(text) > 2000 THEN 2015 ELSE length(text) END AS BIGINT) AS text_length, CAST(least(100, len(words)) AS BIGINT) AS n_items,
      words[least(100, len(words))] AS last_item, '{''d'': [1, 2]}' AS deep, false AS has_null
    FROM (SELECT *, string_split(text, ' ') AS words FROM documents WHERE text IS NOT NULL)
    """,
)
def limited_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Nested attributes with a long text, a long list, an object below the depth limit and a NULL member."""
    documents = roles.table(spark, sf, "documents").filter("text IS NOT NULL")
    below = F.struct(F.struct(F.struct(F.struct(F.array(F.lit(1), F.lit(2)).alias("d")).alias("c")).alias("b")).alias("a"))
    nothing = F.lit(None).cast("string")
    payload = F.to_json(F.struct("text", F.split("text", " ").alias("items"), below.alias("deep"), nothing.alias("gone")), {"ignoreNullFields": "false"})
    kept = documents.select("doc_id", F.from_json(work.limited_json(payload), "text string, items array<string>, deep struct<a:struct<b:struct<c:string>>>, gone string").alias("k"), work.limited_json(payload).alias("json"))
    return kept.select(
        "doc_id", F.length("k.text").cast("long").alias("text_length"), F.size("k.items").cast("long").alias("n_items"), F.element_at("k.items", -1).alias("last_item"),
        F.col("k.deep.a.b.c").alias("deep"), F.contains("json", F.lit('"gone"')).alias("has_null"),
    )


@query(
    "analytics_page",
    """
    SELECT ingest_run_id, part, place, id, round(amount, 3) AS amount FROM (
      SELECT ingest_run_id, 'summary' AS part, CAST(1 AS INTEGER) AS place, 'duration' AS id, duration_ms AS amount FROM run_summary
      UNION ALL SELECT ingest_run_id, kind, CAST(rank AS INTEGER), id, d FROM (
        SELECT *, row_number() OVER (PARTITION BY ingest_run_id, kind ORDER BY round(d, 6) DESC, id) AS rank FROM (
          SELECT ingest_run_id, kind, id, sum(coalesce(duration_ms, 0)) AS d
          FROM (SELECT *, unnest(['phase', 'engine', 'model', 'file', 'page']) AS kind, unnest([phase, phase || ':' || engine, provider || ':' || model, file_hash, file_hash || ':' || page_no]) AS id FROM unit_rows)
          WHERE id IS NOT NULL GROUP BY 1, 2, 3)) WHERE rank <= 5
      UNION ALL SELECT ingest_run_id, 'slow unit', CAST(rank AS INTEGER), CAST(work_unit_id AS VARCHAR), duration_ms FROM (
        SELECT *, row_number() OVER (PARTITION BY ingest_run_id ORDER BY coalesce(duration_ms, 0) DESC, work_unit_id) AS rank FROM unit_rows) WHERE rank <= 5
      UNION ALL SELECT ingest_run_id, 'slow span', CAST(rank AS INTEGER), span_id, duration_ms FROM (
        SELECT *, row_number() OVER (PARTITION BY ingest_run_id ORDER BY coalesce(duration_ms, 0) DESC, span_id) AS rank FROM span_rows) WHERE rank <= 5
      UNION ALL SELECT ingest_run_id, 'advice', 1, 'failed-llm-cost', NULL FROM run_summary WHERE failed_llm_duration_ms / nullif(duration_ms, 0) > 0.2
      UNION ALL SELECT ingest_run_id, 'advice', 1, 'model-switches', NULL FROM run_summary WHERE model_lease_count > 1
      UNION ALL SELECT ingest_run_id, 'advice', 1, 'no-dominant-bottleneck', NULL FROM run_summary WHERE NOT coalesce(failed_llm_duration_ms / nullif(duration_ms, 0) > 0.2, false) AND model_lease_count <= 1)
    """,
)
def analytics_page(spark: SparkSession, sf: str) -> DataFrame:
    """All tables of the analytics page, five rows of each list, with the place of each row."""
    found = runs.analytics_bundle(roles.runs(spark, sf), named_units(spark, sf), roles.spans(spark, sf), roles.leases(spark, sf), 5)

    def rows(name: str, part: Column, place: Column, key: Column, amount: Column) -> DataFrame:
        shown = amount.cast("double").alias("amount")
        return found[name].select(RUN, part.alias("part"), place.cast("int").alias("place"), key.cast("string").alias("id"), F.round(shown, 3).alias("amount"))

    one, ranked = F.lit(1), F.col("rank")
    # the list is numbered again by the order it is shown in
    place = F.row_number().over(Window.partitionBy(RUN, "kind").orderBy(F.round("duration_ms", 6).desc(), "id"))
    parts = [
        rows("summary", F.lit("summary"), one, F.lit("duration"), F.col("duration_ms")),
        rows("breakdowns", F.col("kind"), place, F.col("id"), F.col("duration_ms")),
        rows("slow_work_units", F.lit("slow unit"), ranked, F.col("work_unit_id"), F.col("duration_ms")),
        rows("slow_spans", F.lit("slow span"), ranked, F.col("span_id"), F.col("duration_ms")),
        rows("recommendations", F.lit("advice"), one, F.col("id"), F.lit(None)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "span_list",
    "SELECT ingest_run_id, CAST(place AS INTEGER) AS place, span_id FROM (SELECT *, row_number() OVER (PARTITION BY ingest_run_id ORDER BY ts_us, duration_ms DESC, span_id) AS place FROM span_rows) WHERE place <= 25",
)
def span_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first spans of each run, with their place in the trace list."""
    return top_per_group(roles.spans(spark, sf), [RUN], runs.span_order(), 25, "place").select(RUN, "place", "span_id")


# --- work plan ---------------------------------------------------------------


def plan_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"files": roles.files(spark, sf), "raw": corpus.raw_rows(spark, sf), "chunks": roles.chunks(spark, sf)}


view("engine_pairs", "SELECT file_hash, unnest(['docling', 'mineru', 'infinity']) AS engine FROM files WHERE extension <> '.txt'")
view(
    "pending_pairs",
    "SELECT file_hash, engine FROM engine_pairs EXCEPT SELECT file_hash, annotation_engine FROM raw_rows WHERE status = 'ok' AND (annotation_engine <> 'docling' OR file_hash IN (SELECT file_hash FROM chunks))",
)


@query("pending_engines", "SELECT file_hash, engine FROM pending_pairs")
def pending_engines(spark: SparkSession, sf: str) -> DataFrame:
    given = plan_inputs(spark, sf)
    return work.pending_engines(given["files"], ["docling", "mineru", "infinity"], given["raw"], given["chunks"])


@query(
    "work_plan",
    """
    SELECT phase || ':' || engine || ':' || file_hash AS work_key, phase, engine, CASE engine WHEN 'docling' THEN 'local:docling' WHEN 'mineru' THEN 'local:mineru:pipeline' WHEN 'infinity' THEN 'local:infinity:pipeline:parser' WHEN 'preview_cache' THEN 'local:preview_cache' ELSE 'local:markitdown' END AS execution_key
    FROM (SELECT file_hash, 'annotation' AS phase, engine FROM pending_pairs WHERE engine IN ('docling', 'mineru')
      UNION ALL SELECT file_hash, 'artifact', 'preview_cache' FROM files WHERE extension <> '.txt' AND file_hash NOT IN (SELECT file_hash FROM raw_rows WHERE status = 'ok')
      UNION ALL SELECT file_hash, 'markdown', 'markitdown' FROM files WHERE extension <> '.txt'
        AND (file_hash IN (SELECT file_hash FROM pending_pairs WHERE engine IN ('docling', 'mineru')) OR file_hash IN (SELECT file_hash FROM reader_pages WHERE page_no % 3 = 0)))
    """,
)
def work_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A plan with two readers and one generator over the pages of ten lines; every third page lacks Markdown."""
    given = plan_inputs(spark, sf)
    count = F.floor((F.size(F.split("text", "\n")) - 1) / 10).cast("int") + 1
    pages = roles.texts(spark, sf).select("file_hash", F.explode(F.sequence(F.lit(1), count)).alias("page_no"))
    made = F.concat(F.lit("# Page "), F.col("page_no").cast("string"), F.lit(" of "), "file_hash")
    written = pages.filter("page_no % 3 <> 0").select("file_hash", "page_no", F.lit("markitdown").alias("markdown_engine"), made.alias("markdown_text"))
    cached = given["raw"].filter("status = 'ok'").select("file_hash")
    plan = work.work_plan(1, given["files"], ["docling", "mineru"], ["markitdown"], given["raw"], given["chunks"], pages, written, cached)
    return plan.select("work_key", "phase", "engine", "execution_key")


@query(
    "ingest_summary",
    """
    SELECT CAST((SELECT count(*) FROM files) AS BIGINT) AS files_seen, CAST((SELECT count(DISTINCT file_hash) FROM pending_pairs) AS BIGINT) AS files_processed,
           CAST((SELECT count(*) FROM chunks WHERE file_hash IN (SELECT file_hash FROM pending_pairs)) AS BIGINT) AS chunks, CAST((SELECT count(*) FROM raw_rows WHERE status = 'error') AS BIGINT) AS errors, 'completed_with_errors' AS status
    """,
)
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    given = plan_inputs(spark, sf)
    pending = work.pending_engines(given["files"], ["docling", "mineru", "infinity"], given["raw"], given["chunks"])
    return work.ingest_summary(given["files"], pending, given["chunks"], given["raw"].filter("status = 'error'")).drop("files_skipped")


def _measure(rows: list[dict]) -> list[str]:
    """A reader that refuses texts with a currency sign, to show the page-by-page retry."""
    if any("$$$" in row["text"] for row in rows):
        raise ValueError("unreadable")
    return [str(len(row["text"])) for row in rows]


@query(
    "annotate_pages",
    "SELECT doc_id, CASE WHEN contains(text, '$$$') THEN 'error' ELSE 'ok' END AS status, CASE WHEN contains(text, '$$$') THEN 'ValueError' ELSE CAST(length(text) AS VARCHAR) END AS outcome FROM documents",
)
def annotate_pages(spark: SparkSession, sf: str) -> DataFrame:
    documents = roles.table(spark, sf, "documents").select("doc_id", "text")
    rows = work.annotate(documents, _measure, batch_size=16)
    return rows.select("doc_id", "status", F.coalesce("result", "error_type").alias("outcome"))


@query(
    "grouped_by_model",
    """
    SELECT slot AS partition, execution_key, CAST(count(*) AS BIGINT) AS n, CAST(dense_rank() OVER (PARTITION BY slot ORDER BY execution_key) AS INTEGER) AS run
    FROM (SELECT execution_key, CAST(floor((row_number() OVER (ORDER BY execution_key) - 1) * 7 / count(*) OVER ()) AS INTEGER) AS slot FROM (SELECT 'local:' || engine AS execution_key FROM unit_rows))
    GROUP BY 1, 2
    """,
)
def grouped_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal models in each of seven partitions, in the order in which their tasks meet them."""
    laid = work.grouped_by_model(roles.work_units(spark, sf), 7)
    met = laid.select("execution_key", F.spark_partition_id().alias("partition"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at"))
    runs_ = met.groupBy("partition", "execution_key").agg(F.count("*").alias("n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    together = runs_.filter(F.col("_last") - F.col("_first") + 1 == F.col("n"))
    order = Window.partitionBy("partition").orderBy("_first")
    return together.select("partition", "execution_key", "n", F.row_number().over(order).alias("run"))


@query("selected_pages", "SELECT t.file_hash, t.page_no FROM turns t JOIN labels l ON t.file_hash = 'conv-' || l.doc_id AND t.page_no = l.quality + 1")
def selected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages asked for by label rows: page 1 or 2 of the conversation of the same number."""
    labels = roles.table(spark, sf, "labels")
    wanted = labels.select(F.concat(F.lit("conv-"), F.col("doc_id").cast("string")).alias("file_hash"), (F.col("quality") + 1).alias("page_no"))
    pages = roles.turns(spark, sf).select("file_hash", "page_no")
    return work.selected_pages(pages, wanted).withColumn("page_no", F.col("page_no").cast("long"))


@query(
    "work_unit_upsert",
    "SELECT event_id, phase || ':' || engine || ':' || span_id AS work_key, CASE WHEN status IN ('ok', 'error', 'skipped') THEN status ELSE 'planned' END AS status FROM span_rows",
)
def work_unit_upsert(spark: SparkSession, sf: str) -> DataFrame:
    units = roles.work_units(spark, sf).select(RUN, "event_id", "work_key", "status")
    planned = units.withColumn("status", F.lit("planned"))
    merged = keyed.upsert_keep_terminal(units, planned, [RUN, "work_key"])
    return merged.select("event_id", "work_key", "status")


@query(
    "engine_identities",
    "SELECT engine, CASE engine WHEN 'docling' THEN 'local-docling' WHEN 'mineru' THEN 'local-mineru' WHEN 'infinity' THEN 'local-infinity-parser2' ELSE 'local' END AS provider, CAST(count(*) AS BIGINT) AS n FROM span_rows GROUP BY 1",
)
def engine_identities(spark: SparkSession, sf: str) -> DataFrame:
    counted = roles.spans(spark, sf).groupBy("engine").agg(F.count("*").alias("n"))
    return ids.engine_identity(counted).select("engine", "provider", "n")


# --- streaming ---------------------------------------------------------------


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = roles.table(spark, sf, "events").schema
    return _as_log(jobs.parquet_stream(spark, f"{sf}/events.parquet", schema))


def _as_log(events: DataFrame) -> DataFrame:
    return events.withColumn("started_at", F.col("ts").cast("timestamp")).select(
        F.dayofmonth("ts").cast("long").alias(RUN), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("span_id"), "started_at",
        F.col("started_at").alias("ts"), F.col("event_type").alias("category"), F.col("value").alias("duration_ms"),
        F.concat(F.lit("file-"), F.col("user_id").cast("string")).alias("file_hash"),
        F.when(F.col("event_type") == "error", "error").when(F.col("value") < 10, "running").otherwise("ok").alias("status"),
    )


@query(
    "stream_error_rates",
    """
    SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS window_start, event_type AS category, CAST(count(*) AS BIGINT) AS span_count, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS error_count
    FROM events GROUP BY 1, 2
    """,
)
def stream_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    table = jobs.run_to_table(jobs.error_rates(event_stream(spark, sf), "1 hour"), "error-rates", "update")
    rows = jobs.latest_updates(table, ["window_start", "category"])
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "category", "span_count", "error_count")


@query(
    "stream_sliding_error_rates",
    """
    SELECT (epoch_us(ts) // 1800000000 - slot) * 1800 AS window_start, CAST(count(*) AS BIGINT) AS span_count, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS error_count
    FROM (SELECT *, unnest([0, 1]) AS slot FROM events) GROUP BY 1
    """,
)
def stream_sliding_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    stream = event_stream(spark, sf).withColumn("category", F.lit("all"))
    table = jobs.run_to_table(jobs.error_rates(stream, "1 hour", "30 minutes"), "sliding-rates", "update")
    rows = jobs.latest_updates(table, ["window_start"])
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "span_count", "error_count")


@query(
    "stream_live_units",
    """
    SELECT ingest_run_id, work_key, arg_max(status, event_id) AS status, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS attempt_count
    FROM (SELECT CAST(day(ts) AS BIGINT) AS ingest_run_id, event_id, event_type || ':file-' || user_id AS work_key, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 10 THEN 'running' ELSE 'ok' END AS status FROM events) GROUP BY 1, 2
    """,
)
def stream_live_units(spark: SparkSession, sf: str) -> DataFrame:
    log = event_stream(spark, sf).withColumn("work_key", F.concat_ws(":", "category", "file_hash"))
    table = jobs.run_to_table(jobs.live_units(log), "live-units", "update")
    return jobs.latest_updates(table, [RUN, "work_key"]).select(RUN, "work_key", "status", "attempt_count")


@query(
    "stream_sessions",
    """
    SELECT file_hash, session_start, session_end, span_count, total_ms FROM (
      SELECT 'file-' || user_id AS file_hash, min(us) AS session_start, max(us) + 3600000000 AS session_end, CAST(count(*) AS BIGINT) AS span_count, round(sum(value), 3) AS total_ms
      FROM (SELECT *, sum(CASE WHEN prev IS NULL OR us >= prev + 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
        SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS prev FROM events)) GROUP BY user_id, s)
    """,
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that the watermark has closed, and those open at the end of the input."""
    closed = jobs.run_to_table(jobs.activity_sessions(event_stream(spark, sf), "1 hour"), "sessions", "append").drop("batch_id")
    rows = closed.unionByName(jobs.still_open(_as_log(roles.table(spark, sf, "events")), "1 hour"))
    return rows.select(
        "file_hash", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"),
        "span_count", F.round("duration_ms", 3).alias("total_ms"),
    )


@query(
    "stream_completed_spans",
    "SELECT CAST(event_id AS VARCHAR) AS span_id, CAST(day(ts) AS BIGINT) AS ingest_run_id, round(CAST(round(value * 10000) AS BIGINT) / 1000.0, 3) AS duration_ms FROM events",
)
def stream_completed_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Start records joined with end records, each a stream of its own."""
    starts = event_stream(spark, sf).select(RUN, "span_id", "category", "started_at")
    took = F.round(F.col("duration_ms") * 10000).cast("long")
    ends = event_stream(spark, sf).select(RUN, "span_id", F.timestamp_micros(F.unix_micros("started_at") + took).alias("ended_at"), "status")
    rows = jobs.complete_spans_by_batch(starts, ends, scratch_path(spark, "spans-state"), scratch_path(spark, "spans-out"))
    return rows.select("span_id", RUN, F.round("duration_ms", 3).alias("duration_ms"))


@query("stream_new_files", "SELECT file_hash, CAST(count(*) AS BIGINT) AS path_count FROM locations GROUP BY 1")
def stream_new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arriving as files: each path once within the watermark, then counted per content."""
    schema = roles.table(spark, sf, "documents").schema
    arriving = jobs.parquet_stream(spark, f"{sf}/documents.parquet", schema).select(
        ids.content_hash(F.col("text")).alias("file_hash"), roles.doc_path().alias("path"),
        F.timestamp_seconds(F.lit(roles.EPOCH) + F.col("doc_id")).alias("modified_at"),
    )
    fresh = arriving.withWatermark("modified_at", "1 hour").dropDuplicatesWithinWatermark(["file_hash", "path"])
    return jobs.run_to_table(fresh, "new-files").groupBy("file_hash").agg(F.count("*").alias("path_count"))


# --- streams of many batches -------------------------------------------------

#: Arrivals of four days each; for the late form one event in seventeen is held up by up to 99 hours.
ARRIVAL_HOURS = 96
view("arrived", "SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 // 96 AS arrival FROM events")
view("arrived_late", "SELECT *, epoch_us(ts) AS us, (epoch_us(ts) // 3600000000 + CASE WHEN event_id % 17 = 0 THEN event_id % 100 ELSE 0 END) // 96 AS arrival FROM events")


def arrivals(spark: SparkSession, sf: str, held_up: Column | None = None) -> DataFrame:
    """The log with the number of the batch each row arrives in."""
    hour = F.expr("unix_micros(started_at) div 3600000000")
    late = F.lit(0) if held_up is None else held_up
    return _as_log(roles.table(spark, sf, "events")).withColumn("arrival", F.floor((hour + late) / ARRIVAL_HOURS))


@query(
    "stream_late_rows",
    """
    SELECT start_s AS window_start, category, CAST(count(*) FILTER (WHERE NOT late) AS BIGINT) AS span_count,
      CAST(count(*) FILTER (WHERE NOT late AND category = 'error') AS BIGINT) AS error_count, CAST(count(*) FILTER (WHERE late) AS BIGINT) AS late_count
    FROM (SELECT us // 3600000000 * 3600 AS start_s, event_type AS category, coalesce((us // 3600000000 + 1) * 3600000000 <= newest - 7200000000, false) AS late
      FROM arrived_late JOIN (SELECT arrival, max(max(us)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM arrived_late GROUP BY arrival) USING (arrival))
    GROUP BY 1, 2
    """,
)
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly error rates over several batches, with the rows that came more than two hours after their window."""
    held_up = F.when(F.col("seq") % 17 == 0, F.col("seq") % 100).otherwise(0)
    state, target = scratch_path(spark, "late-state"), scratch_path(spark, "late-out")
    jobs.replay(arrivals(spark, sf, held_up), "arrival", "late", lambda log: jobs.error_rates_with_late(log, "1 hour", dt.timedelta(hours=2), state, target))
    rows = jobs.rates_with_late(spark, target)
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "category", "span_count", "error_count", "late_count")


@query(
    "stream_units_with_end",
    """
    SELECT work_key, min(us) AS opened_us, arg_max(status, (us, event_id)) AS status, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS attempt_count,
      max(us) FILTER (WHERE status = 'running') AS started_us, CASE WHEN arg_max(status, (us, event_id)) = 'running' THEN NULL ELSE max(us) END AS finished_us
    FROM (SELECT *, sum(CASE WHEN before IS NULL OR us > before + CASE was WHEN 'running' THEN 12 ELSE 1 END * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY work_key ORDER BY us, event_id) AS life
      FROM (SELECT *, lag(us) OVER w AS before, lag(status) OVER w AS was
        FROM (SELECT event_id, us, 'file-' || user_id AS work_key, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 10 THEN 'running' ELSE 'ok' END AS status FROM arrived)
        WINDOW w AS (PARTITION BY work_key ORDER BY us, event_id)))
    GROUP BY work_key, life
    """,
)
def stream_units_with_end(spark: SparkSession, sf: str) -> DataFrame:
    """Units that are forgotten an hour after they ended, or after twelve hours without news; every life of each."""
    state, target = scratch_path(spark, "units-state"), scratch_path(spark, "units-out")
    tables: list[DataFrame] = []

    def run(log: DataFrame) -> None:
        units = log.select(F.lit(1).cast("long").alias(RUN), F.col("file_hash").alias("work_key"), "ts", "seq", "status")
        live = jobs.live_units_with_end(units, dt.timedelta(hours=12), dt.timedelta(hours=1))
        tables.append(jobs.run_to_table(live, "units", "update", state, target))

    jobs.replay(arrivals(spark, sf), "arrival", "units", run)
    rows = jobs.latest_updates(tables[-1], ["work_key", "opened_at"])
    return rows.select("work_key", us("opened_at").alias("opened_us"), "status", "attempt_count", us("started_at").alias("started_us"), us("finished_at").alias("finished_us"))


@query(
    "stream_unfinished_spans",
    """
    SELECT CAST(event_id AS VARCHAR) AS span_id, CASE WHEN event_id % 11 < 2 THEN 'unfinished' WHEN event_type = 'error' THEN 'error' WHEN value < 10 THEN 'running' ELSE 'ok' END AS status,
      CASE WHEN event_id % 11 < 2 THEN NULL ELSE round(CAST(round(value * 10000) AS BIGINT) / 1000.0, 3) END AS duration_ms
    FROM events
    """,
)
def stream_unfinished_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Starts and ends over several batches: one span in eleven has no end, one ends after more than the longest time."""
    took = F.when(F.col("seq") % 11 == 1, F.lit(7_200_000_000)).otherwise(F.round(F.col("duration_ms") * 10000).cast("long"))
    log = arrivals(spark, sf).withColumn("ended_at", F.when(F.col("seq") % 11 > 0, F.timestamp_micros(F.unix_micros("started_at") + took)))
    kinds_ = F.explode(F.array(F.lit("start"), F.lit("end"))).alias("kind")
    records = log.select(RUN, "span_id", "category", "started_at", "ended_at", "status", kinds_).filter("kind = 'start' OR ended_at IS NOT NULL")
    at = F.when(F.col("kind") == "start", F.col("started_at")).otherwise(F.col("ended_at"))
    records = records.withColumn("arrival", F.floor(F.unix_micros(at) / 3_600_000_000 / ARRIVAL_HOURS))
    state, target = scratch_path(spark, "unfinished-state"), scratch_path(spark, "unfinished-out")
    tables: list[DataFrame] = []

    def run(stream: DataFrame) -> None:
        starts = stream.filter("kind = 'start'").select(RUN, "span_id", "category", "started_at")
        ends = stream.filter("kind = 'end'").select(RUN, "span_id", "ended_at", "status")
        tables.append(jobs.complete_spans_by_batch(starts, ends, state, target, unfinished=True))

    jobs.replay(records, "arrival", "unfinished", run)
    came_out = tables[-1]
    rows = came_out.unionByName(jobs.still_waiting(log.select(RUN, "span_id", "category", "started_at"), came_out))
    return rows.select("span_id", F.coalesce("status", F.lit("unfinished")).alias("status"), F.round("duration_ms", 3).alias("duration_ms"))


view("inbox_names", "SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 7 WHEN 0 THEN '.' || doc_id || '.txt' WHEN 1 THEN '_' || doc_id || '.pdf' ELSE doc_id || '.txt' END AS name FROM documents WHERE doc_id IS NOT NULL")
view(
    "inbox_scans",
    """
    SELECT 1 AS scan, name, sha256(text) AS file_hash, 'new' AS status, true AS read FROM inbox_names
    UNION ALL SELECT 2, CASE doc_id % 5 WHEN 1 THEN 'moved-' || doc_id || '.txt' ELSE name END, CASE doc_id % 5 WHEN 0 THEN sha256(text || '!') ELSE sha256(text) END,
      CASE doc_id % 5 WHEN 0 THEN 'changed' WHEN 1 THEN 'moved' ELSE 'unchanged' END, doc_id % 5 < 2 FROM inbox_names
    """,
)


@query(
    "stream_ingest",
    """
    SELECT scan, name, file_hash, status, read, first_scan, last_scan, path_count FROM inbox_scans
    JOIN (SELECT file_hash, min(scan) AS first_scan, max(scan) AS last_scan, CAST(count(DISTINCT name) AS BIGINT) AS path_count FROM inbox_scans GROUP BY 1) USING (file_hash)
    """,
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a file, scanned twice; in between one file in five changes and one gets another name.

    One row for each file of each scan, with what the store knows of its content.
    """
    root = scratch_path(spark, "ingest")
    inbox, store, state = f"{root}/inbox", f"{root}/store", f"{root}/state"
    key = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("."), key, F.lit(".txt"))).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("_"), key, F.lit(".pdf"))).otherwise(F.concat(key, F.lit(".txt")))
    at = lambda shown: F.concat(F.lit(f"{root}/files/"), shown)
    texts = roles.table(spark, sf, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), name.alias("name"))
    listing.put_files(texts.select(at(F.col("name")).alias("path"), "body"))
    ingest.announce(spark, f"{root}/files", inbox, dt.datetime(2024, 1, 1))
    ingest.ingest(spark, inbox, store, state)

    changed = texts.filter("doc_id % 5 = 0").select(at(F.col("name")).alias("path"), F.concat("body", F.lit("!")).alias("body"))
    moved = texts.filter("doc_id % 5 = 1")
    listing.put_files(changed.unionByName(moved.select(at(F.concat(F.lit("moved-"), key, F.lit(".txt"))).alias("path"), "body")))
    listing.put_files(moved.select(at(F.col("name")).alias("path"), F.lit(None).cast("binary").alias("body")))
    ingest.announce(spark, f"{root}/files", inbox, dt.datetime(2024, 1, 2))
    ingest.ingest(spark, inbox, store, state)

    paths = ingest.stored_locations(spark, store).groupBy("file_hash").agg(F.count_distinct("path").alias("path_count"))
    day = lambda seen: F.dayofmonth(seen).cast("int")
    known = ingest.stored_files(spark, store).select("file_hash", day("first_seen_at").alias("first_scan"), day("last_seen_at").alias("last_scan"))
    log = ingest.ingest_log(spark, store).select(day("scanned_at").alias("scan"), files.base_name(F.col("path")).alias("name"), "file_hash", "status", "read")
    return log.join(known, "file_hash").join(paths, "file_hash")
