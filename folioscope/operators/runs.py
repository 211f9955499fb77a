"""Run analytics over spans, events, work units and model leases.

Every operator works for all runs at once, keyed by run; filtering by run is
the caller's ``filter`` and reaches the scan.  Nothing is cut before it is
summed: limits apply to the lists that are returned only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import kinds
from folioscope.functions import text as txt
from folioscope.functions.casts import variant_text
from folioscope.functions.grouping import blocked_row_number, broadcast_if_small, null_safe_on, top_per_group
from folioscope.session import cut_lineage
from folioscope.sources.files import base_name

# Statuses, phase order and thresholds.
TERMINAL = ("ok", "error", "skipped")
PHASE_ORDER = ("orientation", "artifact", "annotation", "markdown")
FAILED_SHARE_LIMIT = 0.2
FAILED_CALL_STEP = "lmstudio_chat_completion"
MIN_BAR_PERCENT = 0.35
DEFAULT_PARAMETERS = '{"repeat_penalty":1.2}'

RUN = "ingest_run_id"


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Never negative; NULL when either end is missing (``greatest`` skips NULLs)."""
    took = (micros(end) - micros(start)) / 1000.0
    return F.when(took.isNotNull(), F.greatest(F.lit(0.0), took))


def page_pair(df_file: str = "file_hash", page: str = "page_no") -> Column:
    both = F.col(df_file).isNotNull() & F.col(page).isNotNull()
    return F.when(both, F.struct(df_file, page))


# --- filters -----------------------------------------------------------------


def filter_rows(
    df: DataFrame,
    *,
    run_id: int | None = None,
    file_hash: str | None = None,
    page_no: int | None = None,
    status: str | None = None,
    text: str | None = None,
    text_columns: Sequence[str] = (),
) -> DataFrame:
    """AND of the filters that are set; status 'all' and blank text ask for nothing."""
    if run_id is not None:
        df = df.filter(F.col(RUN) == run_id)
    if file_hash:
        df = df.filter(F.col("file_hash") == file_hash)
    if page_no is not None:
        df = df.filter(F.col("page_no") == page_no)
    if status and status != "all":
        df = df.filter(F.col("status") == status)
    if text and text.strip():
        df = df.filter(txt.ilike_any(text, *[F.col(name) for name in text_columns]))
    return df


SPAN_TEXT = ("name", "pipeline_step", "category", "annotation_engine", "error_message")
EVENT_TEXT = ("name", "message")


def trace_spans(spans: DataFrame, **filters: object) -> DataFrame:
    return filter_rows(spans, text_columns=SPAN_TEXT, **filters)


def trace_events(events: DataFrame, **filters: object) -> DataFrame:
    """Events have no status, so that filter does not apply to them."""
    kept = {name: value for name, value in filters.items() if name != "status"}
    return filter_rows(events, text_columns=EVENT_TEXT, **kept)


def span_order() -> list[Column]:
    return [F.col("started_at"), F.col("duration_ms").desc(), F.col("span_id")]


# --- runs and traces ---------------------------------------------------------


def _span_totals(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(
        F.count("span_id").alias("span_count"),
        F.count(F.when(F.col("status") == "error", 1)).alias("error_count"),
        F.countDistinct("file_hash").alias("file_count"),
        F.countDistinct(page_pair()).alias("page_count"),
        F.min("started_at").alias("trace_started_at"),
        F.max("ended_at").alias("trace_ended_at"),
    )


def run_list(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """All runs with span counts; trace times go before run times."""
    joined = runs.join(_span_totals(spans, [RUN]), RUN, "left")
    start = F.coalesce("trace_started_at", "started_at")
    end = F.coalesce("trace_ended_at", "finished_at")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return joined.select(
        RUN, "source_directory", "status", "started_at", "finished_at",
        F.coalesce(elapsed_ms(start, end), F.lit(0.0)).alias("duration_ms"),
        zero("span_count"), zero("error_count"), zero("file_count"), zero("page_count"),
    )


def newest_runs(run_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """All runs, newest first, or as many as are asked for."""
    ordered = run_rows.orderBy(F.col("started_at").desc(), F.col(RUN).desc())
    return ordered if limit is None else ordered.limit(max(1, limit))


def latest_run(runs: DataFrame) -> DataFrame:
    newest = F.max(F.struct("started_at", RUN)).alias("_newest")
    return runs.agg(newest).select(F.col(f"_newest.{RUN}").alias(RUN))


def trace_summary(spans: DataFrame, keys: Sequence[str] = (RUN,)) -> DataFrame:
    """Totals over all filtered spans, before any limit of the list."""
    totals = _span_totals(spans, keys)
    return totals.withColumn("duration_ms", elapsed_ms(F.col("trace_started_at"), F.col("trace_ended_at")))


# --- progress ----------------------------------------------------------------


def work_unit_rows(units: DataFrame, files: DataFrame, locations: DataFrame) -> DataFrame:
    """Units with file name and path; the path falls back to that of the metadata."""
    paths = locations.groupBy("file_hash").agg(F.min("path").alias("_path"))
    noted = variant_text(F.try_parse_json("metadata_json"), "$.source_path")
    joined = units.join(files.select("file_hash", "filename"), "file_hash", "left").join(paths, "file_hash", "left")
    return joined.withColumn("source_path", F.coalesce("_path", noted)).drop("_path")


def phase_rank(phase: Column) -> Column:
    return F.coalesce(*[F.when(phase == name, F.lit(i + 1)) for i, name in enumerate(PHASE_ORDER)], F.lit(9))


def work_unit_order() -> list[Column]:
    return [
        phase_rank(F.col("phase")),
        F.col("execution_key"),
        F.col("file_hash"),
        F.col("page_no").asc_nulls_first(),
        F.col("work_unit_id"),
    ]


def _units_in(status: str) -> Column:
    return F.count(F.when(F.col("status") == status, 1))


def progress_summary(units: DataFrame) -> DataFrame:
    ended = F.col("status").isin(*TERMINAL)
    counted = units.groupBy(RUN).agg(
        F.count("*").alias("total_units"),
        _units_in("planned").alias("planned_units"),
        _units_in("running").alias("running_units"),
        _units_in("ok").alias("completed_units"),
        _units_in("error").alias("failed_units"),
        _units_in("skipped").alias("skipped_units"),
        F.avg(F.when(ended, F.col("duration_ms"))).alias("_mean"),
    )
    done = F.col("completed_units") + F.col("failed_units") + F.col("skipped_units")
    return counted.withColumns(
        {
            "percent_complete": done / F.col("total_units") * 100.0,
            "estimated_remaining_ms": F.col("_mean") * (F.col("total_units") - done),
        }
    ).drop("_mean")


def status_rollup() -> Column:
    """Aggregate: any error, any running, all ok, all skipped, else planned."""
    status = F.coalesce("status", F.lit(""))
    return (
        F.when(F.bool_or(status == "error"), "error")
        .when(F.bool_or(status == "running"), "running")
        .when(F.bool_and(status == "ok"), "ok")
        .when(F.bool_and(status == "skipped"), "skipped")
        .otherwise("planned")
    )


def progress_tree(units: DataFrame) -> DataFrame:
    """File, page, phase and unit nodes with summed durations and rolled-up status.

    ``node_level`` is 0 for a run, 1 file, 2 page, 3 phase, 4 unit.  Missing
    files and pages get keys of their own so that rollup NULLs stay apart.
    """
    keyed = units.select(
        RUN,
        F.coalesce("file_hash", F.lit("run")).alias("file_key"),
        F.coalesce(F.col("page_no").cast("string"), F.lit("document")).alias("page_key"),
        F.col("phase").alias("phase_key"),
        F.col("work_unit_id").alias("unit_key"),
        "status",
        "duration_ms",
    )
    rolled = keyed.rollup(RUN, "file_key", "page_key", "phase_key", "unit_key").agg(
        F.grouping_id().alias("_gid"),
        F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("duration_ms"),
        F.count("*").alias("unit_count"),
        status_rollup().alias("status"),
    )
    level = F.lit(4) - F.bit_count("_gid")
    return rolled.filter(F.col(RUN).isNotNull()).withColumn("node_level", level.cast("int")).drop("_gid")


# --- breakdowns --------------------------------------------------------------


def unit_source_path() -> Column:
    noted = variant_text(F.try_parse_json("metadata_json"), "$.source_path")
    return F.coalesce(F.when(F.col("source_path") != "", F.col("source_path")), noted)


def unit_file_label() -> Column:
    noted = variant_text(F.try_parse_json("metadata_json"), "$.source_path")
    filled = lambda value: F.when(value != "", value)
    name = lambda path: F.coalesce(filled(base_name(path)), filled(path))
    return F.coalesce(filled(F.col("filename")), name(F.col("source_path")), name(noted), F.lit("run"))


def unit_page_label() -> Column:
    return F.concat(unit_file_label(), F.lit(" · page "), F.col("page_no").cast("string"))


def breakdown(units: DataFrame, key: Column, label: Column | None = None, limit: int | None = None) -> DataFrame:
    """Totals per run and key with the share of the run's summed duration."""
    took = F.coalesce("duration_ms", F.lit(0.0))
    keyed = units.withColumns({"_key": key, "_label": key if label is None else label, "_took": took})
    grouped = keyed.groupBy(RUN, "_key").agg(
        F.min("_label").alias("label"),
        F.sum("_took").alias("duration_ms"),
        F.count("*").alias("unit_count"),
        F.count(F.when(F.col("status") == "error", 1)).alias("error_count"),
        F.countDistinct("file_hash").alias("file_count"),
        F.countDistinct(page_pair()).alias("page_count"),
        F.max("_took").alias("max_duration_ms"),
    )
    totals = keyed.groupBy(RUN).agg(F.sum("_took").alias("_total"))
    share = F.when(F.col("_total") != 0, F.col("duration_ms") / F.col("_total") * 100.0).otherwise(0.0)
    rows = grouped.join(totals, RUN).withColumn("share_percent", share).drop("_total").withColumnRenamed("_key", "id")
    if limit is None:
        return rows
    return top_per_group(rows, [RUN], [F.col("duration_ms").desc(), F.col("id")], limit)


#: So many rows of a unit and kind are added up in one task.
ENTRIES_OF_A_TASK = 512 << 10


def _entries(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with kind, id and label of each of the five breakdowns a unit is in."""
    in_file = F.coalesce("file_hash", F.lit("")) != ""
    on_page = in_file & (F.coalesce("page_no", F.lit(0)) != 0)
    entry = lambda kind, key, label: F.struct(F.lit(kind).alias("kind"), key.alias("id"), label.alias("label"))
    pair = lambda mark, *names: F.concat_ws(mark, *names)
    page_key = F.concat_ws(":", "file_hash", F.col("page_no").cast("string"))
    entries = F.array(
        entry("phase", F.col("phase"), F.col("phase")),
        entry("engine", pair(":", "phase", "engine"), pair(" / ", "phase", "engine")),
        entry("model", pair(":", "provider", "model"), pair(" / ", "provider", "model")),
        F.when(in_file, entry("file", F.col("file_hash"), F.col("_file_label"))),
        F.when(on_page, entry("page", page_key, F.concat("_file_label", F.lit(" · page "), F.col("page_no").cast("string")))),
    )
    return rows.select(*columns, F.inline(F.filter(entries, lambda e: e.isNotNull())))


def _summed_entries(units: DataFrame) -> DataFrame:
    """Sums of each run, kind and id.

    Distinct files and pages are counted level by level, each on the sums of
    the one below, so a unit is not copied for every kind of count.  The first
    two levels are made where the rows of a file and entry are dealt to.
    """
    took = F.coalesce("duration_ms", F.lit(0.0))
    sums = [F.sum("_took").alias("_took"), F.sum("_units").alias("_units"), F.sum("_errors").alias("_errors"), F.max("_longest").alias("_longest")]
    same = cut_lineage(
        units.groupBy(RUN, "phase", "engine", "provider", "model", "file_hash", "page_no").agg(
            F.sum(took).alias("_took"), F.count("*").alias("_units"), F.count(F.when(F.col("status") == "error", 1)).alias("_errors"), F.max(took).alias("_longest")
        )
    )
    width = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 5 * same.count() // ENTRIES_OF_A_TASK)
    narrow = _entries(same.withColumn("_file_label", F.lit("")), RUN, "file_hash", "page_no", "_took", "_units", "_errors", "_longest").drop("label")
    on_pages = narrow.repartition(width, RUN, "kind", "id", "file_hash").groupBy(RUN, "kind", "id", "file_hash", "page_no").agg(*sums)
    in_files = on_pages.groupBy(RUN, "kind", "id", "file_hash").agg(*sums, F.count(page_pair()).alias("_pages"))
    return in_files.groupBy(RUN, "kind", "id").agg(
        F.sum("_took").alias("duration_ms"),
        F.sum("_units").alias("unit_count"),
        F.sum("_errors").alias("error_count"),
        F.count("file_hash").alias("file_count"),
        F.sum("_pages").alias("page_count"),
        F.max("_longest").alias("max_duration_ms"),
    )


def five_breakdowns(units: DataFrame, limit: int | None = None) -> DataFrame:
    """Phase, engine, model, file and page breakdowns in one table.

    ``metadata`` names file and page of those two kinds; a file's has the
    number of its phases.  Names and phases are looked up for the rows that are
    shown, so what all units are added up by are numbers and keys.  Durations
    are ranked as rounded to six digits, as the order of a sum decides the rest.
    """
    named = units.withColumns({"source_path": unit_source_path(), "_file_label": unit_file_label()})
    grouped = cut_lineage(_summed_entries(units))
    totals = grouped.groupBy(RUN, "kind").agg(F.sum("duration_ms").alias("_total"))
    share = F.when(F.col("_total") != 0, F.col("duration_ms") / F.col("_total") * 100.0).otherwise(0.0)
    rows = grouped.join(totals, [RUN, "kind"]).withColumn("share_percent", share).drop("_total")
    keys = [RUN, "kind", "id"]
    told = _entries(named, RUN, "phase", "file_hash", "page_no", "filename", "source_path")
    if limit is not None:
        rows = cut_lineage(top_per_group(rows, [RUN, "kind"], [F.round("duration_ms", 6).desc(), F.col("id")], limit))
        told = told.alias("t").join(broadcast_if_small(rows.select(*keys)).alias("r"), null_safe_on("t", "r", keys), "left_semi")
    # few different names stand for many units; Spark would leave the distinct out and sort all units for their names
    own = F.col("kind").isin("file", "page")
    only = lambda when, name: F.when(when, F.col(name)).alias(name)
    distinct = cut_lineage(told.select(*keys, "label", *[only(own, c) for c in ("file_hash", "page_no", "filename", "source_path")], only(F.col("kind") == "file", "phase")).distinct())
    lowest = [F.min(name).alias(f"_{name}") for name in ("label", "file_hash", "page_no", "filename", "source_path")]
    facts_of = distinct.groupBy(*keys).agg(*lowest, F.size(F.collect_set("phase")).alias("_phases"))
    facts = F.map_filter(
        F.create_map(
            F.lit("file_hash"), F.col("_file_hash"),
            F.lit("filename"), F.col("_filename"),
            F.lit("source_path"), F.col("_source_path"),
            F.lit("phase_count"), F.when(F.col("kind") == "file", F.col("_phases").cast("string")),
            F.lit("page_no"), F.when(F.col("kind") == "page", F.col("_page_no").cast("string")),
        ),
        lambda _key, value: value.isNotNull(),
    )
    metadata = F.when(own, facts).otherwise(F.create_map().cast("map<string,string>"))
    shown = rows.alias("r").join(facts_of.alias("f"), null_safe_on("r", "f", keys)).select("r.*", *[f"f.{c}" for c in facts_of.columns if c not in keys])
    lacking = ("_label", "_file_hash", "_page_no", "_filename", "_source_path", "_phases")
    return shown.withColumns({"label": F.col("_label"), "metadata": metadata}).drop(*lacking)


def error_breakdown(spans: DataFrame, run_durations: DataFrame, limit: int | None = None) -> DataFrame:
    """Failed spans by engine, category or step; the share is that of the run's wall time."""
    filled = lambda name: F.when(F.col(name) != "", F.col(name))
    key = F.coalesce(filled("annotation_engine"), filled("category"), F.col("pipeline_step"))
    failed = spans.filter(F.col("status") == "error").withColumn("id", key)
    longest = F.when(filled("error_message").isNotNull(), F.struct("duration_ms", "span_id"))
    grouped = failed.groupBy(RUN, "id").agg(
        F.sum("duration_ms").alias("duration_ms"),
        F.count("*").alias("unit_count"),
        F.countDistinct("file_hash").alias("file_count"),
        F.countDistinct(page_pair()).alias("page_count"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.max_by("error_message", longest).alias("sample_error"),
    )
    walls = run_durations.select(RUN, F.col("duration_ms").alias("_wall"))
    share = F.when(F.col("_wall") != 0, F.col("duration_ms") / F.col("_wall") * 100.0).otherwise(0.0)
    rows = grouped.join(walls, RUN, "left").withColumn("share_percent", F.coalesce(share, F.lit(0.0))).drop("_wall")
    if limit is None:
        return rows
    return top_per_group(rows, [RUN], [F.col("duration_ms").desc(), F.col("id")], limit)


def analytics_summary(
    runs: DataFrame, units: DataFrame, spans: DataFrame, leases: DataFrame, failed_step: str = FAILED_CALL_STEP
) -> DataFrame:
    """One row per run; its duration is the wall time, else unit time, else span time."""
    took = F.coalesce("duration_ms", F.lit(0.0))
    by_unit = units.groupBy(RUN).agg(
        F.count("*").alias("work_unit_count"),
        _units_in("error").alias("failed_work_unit_count"),
        F.sum(took).alias("_unit_ms"),
    )
    failed_call = (F.col("pipeline_step") == failed_step) & (F.col("status") == "error")
    by_span = spans.groupBy(RUN).agg(
        F.count("*").alias("span_count"),
        _units_in("error").alias("failed_span_count"),
        F.sum(took).alias("_span_ms"),
        F.sum(F.when(failed_call, took).otherwise(0.0)).alias("failed_llm_duration_ms"),
    )
    by_lease = leases.groupBy(RUN).agg(F.count("*").alias("model_lease_count"))
    joined = runs.join(by_unit, RUN, "left").join(by_span, RUN, "left").join(by_lease, RUN, "left")
    wall = elapsed_ms(F.col("started_at"), F.col("finished_at"))
    duration = F.coalesce(wall, F.nullif("_unit_ms", F.lit(0.0)), F.col("_span_ms"), F.lit(0.0))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return joined.select(
        RUN,
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("source_directory", F.lit("")).alias("source_directory"),
        "started_at",
        "finished_at",
        duration.alias("duration_ms"),
        zero("work_unit_count"),
        zero("failed_work_unit_count"),
        zero("span_count"),
        zero("failed_span_count"),
        zero("model_lease_count"),
        F.coalesce("failed_llm_duration_ms", F.lit(0.0)).alias("failed_llm_duration_ms"),
    )


def slowest(rows: DataFrame, tie: str, limit: int) -> DataFrame:
    """The ``limit`` longest rows of each run."""
    order = [F.coalesce("duration_ms", F.lit(0.0)).desc(), F.col(tie)]
    return top_per_group(rows, [RUN], order, max(1, limit))


def recommendations(summary: DataFrame) -> DataFrame:
    """One leg per rule; runs that no rule names get the default row."""
    share = F.col("failed_llm_duration_ms") / F.nullif("duration_ms", F.lit(0.0))
    costly = summary.filter(share > FAILED_SHARE_LIMIT).select(
        RUN, F.lit("failed-llm-cost").alias("id"), F.lit("high").alias("severity"),
        F.col("failed_llm_duration_ms").alias("evidence"),
    )
    switching = summary.filter(F.col("model_lease_count") > 1).select(
        RUN, F.lit("model-switches").alias("id"), F.lit("medium").alias("severity"),
        F.col("model_lease_count").cast("double").alias("evidence"),
    )
    named = costly.unionByName(switching)
    quiet = summary.join(named.select(RUN).distinct(), RUN, "left_anti").select(
        RUN, F.lit("no-dominant-bottleneck").alias("id"), F.lit("info").alias("severity"),
        F.lit(None).cast("double").alias("evidence"),
    )
    return named.unionByName(quiet)


def model_leases(leases: DataFrame) -> DataFrame:
    """Leases with their switch number in the run and the parameters asked for."""
    meta = F.try_parse_json("metadata_json")
    member = lambda name: F.try_variant_get(meta, f"$.{name}", "variant")
    as_object = lambda value: F.when(
        F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.to_json(value)
    )
    asked = F.coalesce(
        as_object(member("generation_parameters")), as_object(member("load_parameters")), F.lit(DEFAULT_PARAMETERS)
    )
    shaped = leases.withColumns(
        {"load_status": variant_text(meta, "$.load_status"), "requested_parameters": asked}
    )
    hour = F.floor(micros(F.col("started_at")) / 3_600_000_000)
    return blocked_row_number(shaped, [RUN], hour, [F.col("started_at"), F.col("lease_id")], "switch_index")


def analytics_bundle(
    runs: DataFrame, units: DataFrame, spans: DataFrame, leases: DataFrame, limit: int
) -> dict[str, DataFrame]:
    """All tables of the analytics page; ``limit`` rows of each list."""
    size = max(1, limit)
    summary = analytics_summary(runs, units, spans, leases)
    return {
        "summary": summary,
        "breakdowns": five_breakdowns(units, size),
        "error_breakdown": error_breakdown(spans, summary, size),
        "slow_work_units": slowest(units, "work_unit_id", size),
        "slow_spans": slowest(spans, "span_id", size),
        "recommendations": recommendations(summary),
        "leases": model_leases(leases),
    }


# --- span trees and timelines ------------------------------------------------


def _climb(state: DataFrame, values: Sequence[str], lacking: Column, merge: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """Pointer jumping: rows that lack something look at their ancestor ``_up``, which then becomes its own ancestor.

    Each round doubles the distance, so the rounds are the logarithm of the
    depth.  Rows that lack nothing, or have no ancestor left, stay out of the
    join.  Returns the settled state, and the rows that a cycle keeps from
    ending: after so many rounds their values are final too.
    """
    state = cut_lineage(state)
    open_ = F.col("_up").isNotNull() & lacking
    rounds = math.ceil(math.log2(state.count() + 1)) + 1
    while True:
        waiting = state.filter(open_)
        if rounds == 0 or waiting.isEmpty():
            return state, waiting
        above = state.select(RUN, F.col("span_id").alias("_up"), F.col("_up").alias("_next"), *[F.col(v).alias(f"_{v}") for v in values])
        moved = waiting.join(above, [RUN, "_up"], "left").select(RUN, "span_id", F.col("_next").alias("_up"), *[merge(v).alias(v) for v in values])
        state = cut_lineage(moved.unionByName(state.filter(~open_)))
        rounds -= 1


def span_depths(spans: DataFrame) -> DataFrame:
    """Number of known ancestors of each span; one whose parent is missing has depth 0, one on or below a cycle NULL."""
    known = spans.select(RUN, "span_id", "parent_span_id")
    parents = known.filter(F.col("parent_span_id").isNotNull()).join(
        known.select(RUN, F.col("span_id").alias("parent_span_id")), [RUN, "parent_span_id"], "left_semi"
    )
    first = parents.select(RUN, "span_id", F.col("parent_span_id").alias("_up"), F.lit(1).cast("long").alias("depth"))
    others = known.join(first.select(RUN, "span_id"), [RUN, "span_id"], "left_anti")
    roots = others.select(RUN, "span_id", F.lit(None).cast("string").alias("_up"), F.lit(0).cast("long").alias("depth"))
    state, cyclic = _climb(
        first.unionByName(roots), ["depth"], F.lit(True), lambda _: F.col("depth") + F.coalesce("_depth", F.lit(0))
    )
    endless = cyclic.select(RUN, "span_id", F.lit(True).alias("_endless"))
    joined = state.join(endless, [RUN, "span_id"], "left")
    return joined.select(RUN, "span_id", F.when(F.col("_endless").isNull(), F.col("depth")).alias("depth"))


def inherit_from_parents(spans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing values from the nearest ancestor that has them."""
    first = spans.select(RUN, "span_id", F.col("parent_span_id").alias("_up"), *columns)
    lacking = F.lit(False)
    for name in columns:
        lacking = lacking | F.col(name).isNull()
    state, _ = _climb(first, columns, lacking, lambda name: F.coalesce(name, f"_{name}"))
    return spans.drop(*columns).join(state.drop("_up"), [RUN, "span_id"])


def timeline(spans: DataFrame, depths: DataFrame) -> DataFrame:
    """Bar position and width of each span against its run, with depth and children flag."""
    start_ms = micros(F.col("started_at")) / 1000.0
    end_ms = micros(F.col("ended_at")) / 1000.0
    ranges = spans.groupBy(RUN).agg(F.min(start_ms).alias("_start"), F.max(end_ms).alias("_end"))
    total = F.greatest(F.lit(1.0), F.greatest(F.col("_start") + 1.0, F.col("_end")) - F.col("_start"))
    parents = spans.filter(F.col("parent_span_id").isNotNull()).select(RUN, F.col("parent_span_id").alias("span_id"))
    flagged = parents.distinct().withColumn("_parent", F.lit(True))
    joined = spans.join(ranges.withColumn("_total", total), RUN).join(flagged, [RUN, "span_id"], "left")
    left = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (start_ms - F.col("_start")) / F.col("_total") * 100.0))
    raw = F.greatest(F.lit(MIN_BAR_PERCENT), F.col("duration_ms") / F.col("_total") * 100.0)
    width = F.least(raw, F.greatest(F.lit(MIN_BAR_PERCENT), 100.0 - left))
    rows = joined.withColumns(
        {"left_pct": left, "width_pct": width, "has_children": F.coalesce("_parent", F.lit(False))}
    ).drop("_start", "_end", "_total", "_parent")
    return rows.join(depths, [RUN, "span_id"])


def visible_timeline(rows: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Rows below no collapsed span."""
    closed = collapsed.select(RUN, "span_id").withColumn("_closed", F.lit(True))
    marked = rows.join(closed, [RUN, "span_id"], "left")
    first = marked.select(
        RUN, "span_id", F.col("parent_span_id").alias("_up"), F.coalesce("_closed", F.lit(False)).alias("hides"), F.lit(False).alias("hidden")
    )

    def merge(name: str) -> Column:
        above = F.coalesce(F.col("_hides") | F.col("_hidden"), F.lit(False))
        return F.col("hides") if name == "hides" else F.col("hidden") | above

    state, _ = _climb(first, ["hides", "hidden"], ~F.col("hidden"), merge)
    return rows.join(state.filter(~F.col("hidden")).select(RUN, "span_id"), [RUN, "span_id"])


def first_errors(spans: DataFrame) -> DataFrame:
    """First failed span of each run in timeline order."""
    failed = spans.filter(F.col("status") == "error")
    order = F.struct("started_at", (-F.col("duration_ms")).alias("_longest"), "span_id")
    return failed.groupBy(RUN).agg(F.min_by("span_id", order).alias("span_id"))


# --- logs to rows ------------------------------------------------------------


def assemble_spans(log: DataFrame, name_prefix: str = "ingest.") -> DataFrame:
    """Spans from start and end records: one row per span, step and category from its name.

    Attributes override: a later value wins, an end status of error or
    skipped decides the status.
    """
    is_start = F.col("record") == "start"
    latest = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ts"))).alias(name)
    grouped = log.groupBy(RUN, "span_id").agg(
        F.max(F.when(is_start, F.col("parent_span_id"))).alias("parent_span_id"),
        F.max(F.when(is_start, F.col("name"))).alias("name"),
        F.min(F.when(is_start, F.col("ts"))).alias("started_at"),
        F.max(F.when(~is_start, F.col("ts"))).alias("ended_at"),
        latest("file_hash"),
        latest("page_no"),
        latest("annotation_engine"),
        F.max(F.when(F.col("status").isin("error", "skipped"), F.col("status"))).alias("_status"),
        latest("error_message"),
    )
    return grouped.select(
        RUN, "span_id", "parent_span_id", "name",
        kinds.span_step(F.col("name"), name_prefix).alias("pipeline_step"),
        kinds.span_category(F.col("name")).alias("category"),
        "annotation_engine", "file_hash", "page_no",
        F.coalesce("_status", F.lit("ok")).alias("status"),
        "started_at", "ended_at",
        elapsed_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"),
        txt.truncate(F.col("error_message"), 4000).alias("error_message"),
    )


def scope_events(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events take file and page of their span, else their own attributes."""
    owners = spans.select(RUN, "span_id", F.col("file_hash").alias("_file"), F.col("page_no").alias("_page"))
    joined = events.join(owners, [RUN, "span_id"], "left")
    return joined.withColumns(
        {"file_hash": F.coalesce("_file", "file_hash"), "page_no": F.coalesce("_page", "page_no")}
    ).drop("_file", "_page")


def current_units(log: DataFrame) -> DataFrame:
    """Current state of each unit from its status log.

    Attempts are the starts; a start clears end, duration and error.
    """
    newest = F.struct("ts", "seq")
    ended = F.col("status").isin(*TERMINAL)
    started = F.when(F.col("status") == "running", F.col("ts"))
    grouped = log.groupBy(RUN, "work_key").agg(
        F.max_by("status", newest).alias("status"),
        F.count(started).alias("attempt_count"),
        F.max(started).alias("started_at"),
        F.max_by(F.when(ended, F.col("ts")), newest).alias("finished_at"),
        F.max_by(F.when(ended, F.col("error")), newest).alias("error"),
    )
    took = F.when(F.col("finished_at").isNotNull(), F.timestamp_diff("MILLISECOND", "started_at", "finished_at"))
    return grouped.withColumn("duration_ms", took)


def current_leases(log: DataFrame) -> DataFrame:
    """Lease state from its log: started once, finished with status and duration."""
    newest = F.struct("ts", "seq")
    grouped = log.groupBy(RUN, "lease_id").agg(
        F.max_by("execution_key", newest).alias("execution_key"),
        F.max_by("status", newest).alias("status"),
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("status") != "running", F.col("ts"))).alias("finished_at"),
        F.max_by("error", newest).alias("error"),
    )
    return grouped.withColumn("duration_ms", F.timestamp_diff("MILLISECOND", "started_at", "finished_at"))


#: A JSON string's inside; possessive, so that a match takes one step for each escape and none back.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
#: Everything up to the next inline image: text between strings, names, and other strings.
_BEFORE = rf'(?:[^"]++|"(?!data:image){_INSIDE}"|"{_INSIDE}"(?=\s*+:))*+'
IMAGE_URL = rf'\G({_BEFORE})"(data:image{_INSIDE})"'
IMAGE_MARK = '"[diagnostic attachment on filesystem]"'


def redact_images(payload: Column) -> Column:
    """Payload JSON without inline image data.

    Strings are read from the beginning, so a text that quotes an image, or a
    name that looks like one, stays.
    """
    return F.regexp_replace(payload, IMAGE_URL, f"$1{IMAGE_MARK}")


def image_attachments(rows: DataFrame, payload: str, keep: Sequence[str]) -> DataFrame:
    """Facts of each inline image that ``redact_images`` takes out: position from 0, media type, sizes and hash.

    ``data_url_chars`` counts the data URL without JSON escapes, ``bytes`` and
    ``sha256`` are of the decoded image, NULL where its data is not base64; line
    breaks in it do not count.
    """
    urls = F.regexp_extract_all(F.col(payload), F.lit(IMAGE_URL), F.lit(2))
    url = F.from_json(F.concat(F.lit('["'), "_url", F.lit('"]')), "array<string>")[0]
    listed = rows.select(*keep, F.posexplode(urls).alias("position", "_url")).withColumn("_url", url)
    coded = F.when(F.col("_url").contains(","), F.regexp_replace(F.substring_index("_url", ",", -1), r"\s+", ""))
    image = listed.withColumn("_image", F.try_to_binary(coded, F.lit("base64")))
    return image.select(
        *keep,
        "position",
        F.lower(F.regexp_extract("_url", "^data:([^;,]*+)", 1)).alias("media_type"),
        F.length("_url").cast("long").alias("data_url_chars"),
        F.octet_length("_image").cast("long").alias("bytes"),
        F.when(F.col("_image").isNotNull(), F.sha2("_image", 256)).alias("sha256"),
    )


def call_log(events: DataFrame) -> DataFrame:
    """Request, response and error of each model call side by side, per span."""
    attributes = F.try_parse_json("attributes_json")
    get = lambda name, kind: F.try_variant_get(attributes, f'$["{name}"]', kind)
    kind = F.col("event_type")
    only = lambda which, value: F.when(kind == which, value)
    return events.filter(kind.isin("llm.request", "llm.response", "llm.error")).groupBy(RUN, "span_id").agg(
        F.count(only("llm.request", F.lit(1))).alias("requests"),
        F.count(only("llm.response", F.lit(1))).alias("responses"),
        F.count(only("llm.error", F.lit(1))).alias("errors"),
        F.max(only("llm.request", get("llm.model", "string"))).alias("model"),
        F.max(only("llm.request", get("llm.stage", "string"))).alias("stage"),
        F.sum(only("llm.response", get("llm.response.elapsed_ms", "double"))).alias("response_ms"),
        F.sum(only("llm.error", get("llm.error.elapsed_ms", "double"))).alias("failed_ms"),
        F.max(only("llm.response", get("llm.response.status_code", "int"))).alias("status_code"),
        F.max(only("llm.response", F.length(get("llm.response.content", "string")))).alias("content_length"),
    )


def call_statistics(calls: DataFrame) -> DataFrame:
    """Latency and error rate per run, model and stage."""
    grouped = calls.groupBy(RUN, "model", "stage").agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        F.avg("response_ms").alias("mean_response_ms"),
        F.sum(F.coalesce("failed_ms", F.lit(0.0))).alias("failed_ms"),
    )
    return grouped.withColumn("error_rate", F.col("errors") / F.nullif("requests", F.lit(0)))
