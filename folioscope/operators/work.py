"""Pending work as tables, and the plug point for page readers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import ids
from folioscope.functions.casts import to_float
from folioscope.functions.grouping import blocked_row_number, lookup_join
from folioscope.operators.markdown import markdown_complete
from folioscope.session import cut_lineage
from folioscope.sources.files import is_supported

Reader = Callable[[list[dict[str, Any]]], Sequence[str]]


# --- what is still to do -----------------------------------------------------


def files_by_engine(files: DataFrame, engines: Sequence[str]) -> DataFrame:
    """Every supported file with every requested engine."""
    supported = files.filter(is_supported(F.col("extension")))
    names = F.array(*[F.lit(name) for name in engines])
    return supported.select("file_hash", F.explode(names).alias("engine"))


def completed_engines(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, engine) pairs with a good read; the first engine also needs a chunk."""
    good = raw.filter(F.col("status") == "ok").select("file_hash", F.col("annotation_engine").alias("engine")).distinct()
    chunked = chunks.select("file_hash").distinct()
    first = good.filter(F.col("engine") == "docling").join(chunked, "file_hash", "left_semi")
    return first.unionByName(good.filter(F.col("engine") != "docling"))


def pending_engines(files: DataFrame, engines: Sequence[str], raw: DataFrame, chunks: DataFrame, reprocess: bool = False) -> DataFrame:
    wanted = files_by_engine(files, engines)
    if reprocess:
        return wanted
    return wanted.join(completed_engines(raw, chunks), ["file_hash", "engine"], "left_anti")


def pending_markdown(
    files: DataFrame,
    generators: Sequence[str],
    pending: DataFrame,
    pages: DataFrame,
    page_markdown: DataFrame,
    reprocess: bool = False,
) -> DataFrame:
    """Files whose Markdown must be made: any reader pending or any generator incomplete.

    Without known pages a generator is complete once it has one usable page.
    """
    wanted = files_by_engine(files, generators).withColumnRenamed("engine", "markdown_engine")
    expected = wanted.join(pages.select("file_hash", "page_no"), "file_hash")
    known = markdown_complete(expected, page_markdown).filter("complete").select("file_hash", "markdown_engine")
    paged = pages.select("file_hash").distinct()
    any_page = page_markdown.join(paged, "file_hash", "left_anti").select("file_hash", "page_no", "markdown_engine").distinct()
    loose = markdown_complete(any_page, page_markdown).filter("usable_pages > 0").select("file_hash", "markdown_engine")
    incomplete = wanted.join(known.unionByName(loose), ["file_hash", "markdown_engine"], "left_anti")
    if reprocess:
        return wanted.select("file_hash").distinct()
    return incomplete.select("file_hash").union(pending.select("file_hash")).distinct()


def work_plan(
    run_id: int,
    files: DataFrame,
    engines: Sequence[str],
    generators: Sequence[str],
    raw: DataFrame,
    chunks: DataFrame,
    pages: DataFrame,
    page_markdown: DataFrame,
    cached_files: DataFrame,
    reprocess: bool = False,
) -> DataFrame:
    """One planned unit per pending file, phase and engine."""
    supported = files.filter(is_supported(F.col("extension"))).select("file_hash")
    uncached = supported if reprocess else supported.join(cached_files.select("file_hash").distinct(), "file_hash", "left_anti")
    pending = pending_engines(files, engines, raw, chunks, reprocess)
    todo = pending_markdown(files, generators, pending, pages, page_markdown, reprocess)
    artifact = uncached.select(
        "file_hash",
        F.lit("artifact").alias("phase"),
        F.lit("preview_cache").alias("engine"),
        F.lit("local-renderer").alias("provider"),
        F.lit("preview-cache").alias("model"),
        F.lit("local:preview_cache").alias("execution_key"),
    )
    named = lambda df, phase: ids.engine_identity(df.withColumn("phase", F.lit(phase)))
    annotation = named(pending, "annotation")
    names = F.array(*[F.lit(name) for name in generators])
    markdown = named(todo.withColumn("engine", F.explode(names)), "markdown")
    columns = ["file_hash", "phase", "engine", "provider", "model", "execution_key"]
    units = artifact.select(*columns).unionByName(annotation.select(*columns)).unionByName(markdown.select(*columns))
    return units.select(
        F.lit(run_id).cast("long").alias("ingest_run_id"),
        ids.work_key(F.col("phase"), F.col("engine"), F.col("file_hash")).alias("work_key"),
        *columns,
        F.lit("planned").alias("status"),
        F.lit(0).alias("attempt_count"),
    )


def ingest_summary(files: DataFrame, plan: DataFrame, chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """Seen, processed and skipped files, chunks and errors; one row."""
    planned = plan.select("file_hash").distinct()
    flags = files.select("file_hash").join(planned.withColumn("_planned", F.lit(True)), "file_hash", "left")
    seen = flags.agg(F.count("*").alias("files_seen"), F.count("_planned").alias("files_processed"))
    n_chunks = chunks.join(planned, "file_hash", "left_semi").agg(F.count("*").alias("n")).scalar()
    n_errors = failures.agg(F.count("*").alias("n")).scalar()
    counted = seen.select(
        "files_seen",
        "files_processed",
        (F.col("files_seen") - F.col("files_processed")).alias("files_skipped"),
        n_chunks.alias("chunks"),
        n_errors.alias("errors"),
    )
    return counted.withColumn("status", F.when(F.col("errors") > 0, "completed_with_errors").otherwise("ok"))


# --- page readers ------------------------------------------------------------

ANNOTATION_FIELDS = "status string, result string, error_type string, error string, elapsed_seconds double"


def _run_batch(reader: Reader, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """One call per batch; when it fails, one call per row, so good rows survive."""
    started = time.perf_counter()
    try:
        results = list(reader(rows))
        if len(results) != len(rows):
            raise ValueError(f"reader gave {len(results)} results for {len(rows)} rows")
        took = time.perf_counter() - started
        return [{"status": "ok", "result": r, "error_type": None, "error": None, "elapsed_seconds": took} for r in results]
    except Exception as failure:  # noqa: BLE001 - a reader may raise anything
        if len(rows) > 1:
            return [outcome for row in rows for outcome in _run_batch(reader, [row])]
        return [
            {
                "status": "error",
                "result": None,
                "error_type": type(failure).__name__,
                "error": str(failure),
                "elapsed_seconds": time.perf_counter() - started,
            }
        ]


def annotate(pages: DataFrame, reader: Reader, batch_size: int = 1) -> DataFrame:
    """Run a user-supplied reader over page rows, batch by batch, on the executors."""
    size = max(1, batch_size)
    names = pages.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                outcome = pd.DataFrame(_run_batch(reader, part.to_dict("records")), index=part.index)
                yield pd.concat([part[names], outcome], axis=1)

    return pages.mapInPandas(run, f"{fields}, {ANNOTATION_FIELDS}")


def placed_by_model(units: DataFrame, partitions: int) -> DataFrame:
    """Adds ``partition``: units in order of their model, cut into so many pieces of equal size.

    A model's units stand together; one with more units than a piece goes on in
    the next, so a model costs one load and one more for each cut it crosses.
    Numbers within a model are counted by ranges of a hash of the unit, so a
    busy model is not numbered in one task.
    """
    key = F.coalesce("execution_key", F.lit(""))
    hashed = units.withColumn("_model", key).withColumn("_hash", F.xxhash64("work_key"))
    sizes = hashed.groupBy("_model").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_model").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    starts = sizes.select("_model", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(whole).alias("_total"))
    numbered = blocked_row_number(hashed, ["_model"], F.shiftright("_hash", 52), [F.col("_hash"), F.col("work_key")], "_no")
    placed = lookup_join(numbered, cut_lineage(starts), ["_model"], ["_hash"])
    slot = F.floor((F.col("_start") + F.col("_no") - 1) * partitions / F.col("_total")).cast("int")
    return placed.withColumn("partition", slot).drop("_model", "_hash", "_no", "_start", "_total")


def grouped_by_model(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of the same model together, so that a task loads few models, and no task gets more rows than another."""
    count = partitions or int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = placed_by_model(units, count).repartitionById(count, "partition")
    return laid.sortWithinPartitions("execution_key", "work_key").drop("partition")


def selected_pages(pages: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Pages of a file that were asked for; numbers below 1 are ignored, none asked means all."""
    if wanted is None:
        return pages
    valid = wanted.filter(F.col("page_no") > 0).select("file_hash", "page_no").distinct()
    return pages.join(valid, ["file_hash", "page_no"], "left_semi")


def truncated_map(attributes: Column, limit: int = 2000) -> Column:
    """Attribute map without NULLs, long values cut."""
    from folioscope.functions.text import truncate

    kept = F.map_filter(attributes, lambda _key, value: value.isNotNull())
    return F.transform_values(kept, lambda _key, value: truncate(value, limit))


def _limited(value: Any, depth: int, chars: int, max_depth: int, items: int) -> Any:
    cut = lambda s: s if len(s) <= chars else s[:chars] + "... [truncated]"
    if isinstance(value, str):
        return cut(value)
    if value is None or isinstance(value, (bool, int, float)):
        return value
    if depth >= max_depth:
        return cut(str(value))
    if isinstance(value, dict):
        return {k: _limited(v, depth + 1, chars, max_depth, items) for k, v in value.items() if v is not None}
    return [_limited(v, depth + 1, chars, max_depth, items) for v in value[:items]]


def limited_json(payload: Column, chars: int = 2000, depth: int = 4, items: int = 100) -> Column:
    """Nested attributes as JSON: bounded depth, list length and text length; bad JSON becomes NULL."""
    import json

    def made(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_limited(json.loads(text), 0, chars, depth, items), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def limit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([made(t) for t in texts])

    return limit(payload)


def page_sizes_from_metadata(metadata: Column) -> Column:
    return F.struct(
        to_float(F.try_variant_get(metadata, "$.width", "string")).alias("width"),
        to_float(F.try_variant_get(metadata, "$.height", "string")).alias("height"),
    )
