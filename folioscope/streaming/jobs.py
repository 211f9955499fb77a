"""Structured Streaming jobs: ingest, progress, error rates, sessions, spans.

Each builder takes a streaming frame and returns one; ``run_to_table`` drives
it to the end of the available input and returns the written table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.functions.grouping import first_per_group
from folioscope.session import scratch_path
from folioscope.sources.files import describe_files

TERMINAL = ("ok", "error", "skipped")


def parquet_stream(spark: SparkSession, path: str, schema: object, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a table that is one file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern that only the name itself fits: a stream takes no single file by its path.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None, target: str | None = None, kept_rows: list[int] | None = None) -> DataFrame:
    """Process all available input into a parquet table with the batch number of each row.

    Files of a batch go to their own folder and are overwritten when a batch
    is repeated, so a restart leaves no doubled rows.  ``kept_rows`` is given the
    number of rows that the state holds at the end.
    """
    spark = stream.sparkSession
    out = target or scratch_path(spark, f"{label}-out")
    state = checkpoint or scratch_path(spark, f"{label}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_written", F.lit(True))
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = _drive(stream.writeStream.outputMode(mode).foreachBatch(store), state)
    if kept_rows is not None and query.lastProgress is not None:
        kept_rows.append(sum(operator.numRowsTotal for operator in query.lastProgress.stateOperators))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields]
    schema = ", ".join([*fields, "_written boolean", "batch_id bigint"])
    try:
        table = spark.read.schema(schema).option("basePath", out).parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], schema)  # there was no input, so no batch
    return table.filter("_written").drop("_written")


def latest_updates(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final rows of an update-mode table: the last batch that touched a key wins."""
    return first_per_group(table, keys, [F.col("batch_id").desc()]).drop("batch_id")


def replay(rows: DataFrame, arrival: str, label: str, run: Callable[[DataFrame], object]) -> None:
    """Let rows arrive in the order of an integer column: the files of each arrival, then ``run`` on the stream of them.

    ``run`` is called once for each arrival with the stream of the same folder,
    so a query with a checkpoint meets one micro-batch each time, and restarts
    in between.
    """
    spark = rows.sparkSession
    staged, inbox = scratch_path(spark, f"{label}-staged"), scratch_path(spark, f"{label}-inbox")
    rows.write.partitionBy(arrival).parquet(staged)
    staged_rows = spark.read.schema(rows.schema).parquet(staged)
    for found in staged_rows.select(arrival).distinct().orderBy(arrival).toLocalIterator():
        staged_rows.filter(F.col(arrival) == found[0]).write.mode("append").parquet(inbox)
        run(spark.readStream.schema(staged_rows.schema).parquet(inbox))


def _drive(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure
    return query


# S1 -------------------------------------------------------------------------


def incremental_files(binary_stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """New files as they arrive, one row per content within the delay."""
    described = describe_files(binary_stream).withWatermark("modified_at", delay)
    return described.dropDuplicatesWithinWatermark(["file_hash", "path"])


def incremental_upsert(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to a keyed merge until the input is used up."""
    _drive(stream.writeStream.foreachBatch(merge), checkpoint)


# S2 -------------------------------------------------------------------------


def live_units(log: DataFrame) -> DataFrame:
    """Current state of each unit; run in update mode."""
    newest = F.struct("ts", "seq")
    started = F.when(F.col("status") == "running", F.col("ts"))
    ended = F.col("status").isin(*TERMINAL)
    return log.groupBy("ingest_run_id", "work_key").agg(
        F.max_by("status", newest).alias("status"),
        F.count(started).alias("attempt_count"),
        F.max(started).alias("started_at"),
        F.max_by(F.when(ended, F.col("ts")), newest).alias("finished_at"),
    )


_UNIT_STATE = "opened_at timestamp, started_at timestamp, finished_at timestamp, status string, attempts long, newest timestamp, seq long"
_UNIT_ROW = "ingest_run_id long, work_key string, opened_at timestamp, status string, attempt_count long, started_at timestamp, finished_at timestamp, seen_at timestamp"
_UNIT_COLUMNS = [field.split()[0] for field in _UNIT_ROW.split(", ")]

#: Units share so many groups of a stream; a checkpoint depends on it.
UNIT_GROUPS = 512


def _lives(idle: object, linger: object) -> tuple[Callable, Callable]:
    """Until when a unit is known, and the lives that its rows belong to; times are numbers or datetimes, like ``idle`` and ``linger``."""

    def lives_on(unit: tuple):  # noqa: ANN202
        return unit[5] + (linger if unit[3] in TERMINAL else idle)

    def told(known: tuple | None, news: list[tuple]) -> list[tuple]:
        """The last life goes on."""
        shown = []
        for at, seq, status in sorted(news, key=lambda row: row[:2]):
            if known is not None and at > lives_on(known):
                shown.append(known)
                known = None
            opened, started, finished, last, attempts, newest, number = known or (at, None, None, None, 0, None, None)
            if status == "running":
                started, attempts = max(started or at, at), attempts + 1
            if newest is None or (at, int(seq)) >= (newest, number):
                last, newest, number = status, at, int(seq)
                finished = at if status in TERMINAL else None
            known = (min(opened, at), started, finished, last, attempts, newest, number)
        return [*shown, known]

    return lives_on, told


def _unit_updater(idle: timedelta, linger: timedelta) -> Callable:
    """One call for each unit with news, or whose time is up; the state is one small tuple a unit."""
    lives_on, told = _lives(idle, linger)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # a unit has few rows in a batch, for which a sort of tuples takes a small part of the time of one in pandas
        news = [(ts.to_pydatetime(), seq, status) for batch in batches for ts, seq, status in zip(batch["ts"], batch["seq"], batch["status"], strict=True)]
        shown = told(tuple(state.get) if state.exists else None, news)
        state.update(shown[-1])
        state.setTimeoutTimestamp(int(lives_on(shown[-1]).replace(tzinfo=timezone.utc).timestamp() * 1000) + 1)
        rows = [(*key, opened, status, attempts, started, finished, newest) for opened, started, finished, status, attempts, newest, _ in shown]
        yield pd.DataFrame(rows, columns=_UNIT_COLUMNS)

    return update


def _group_updater(idle: timedelta, linger: timedelta) -> Callable:
    """As ``_unit_updater``, with one call for each group of units.

    The state of a group is one JSON list: a few numbers for each unit at work.
    Times are microseconds.
    """
    lives_on, told = _lives(idle // timedelta(microseconds=1), linger // timedelta(microseconds=1))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        units = {(run, name): tuple(rest) for run, name, *rest in json.loads(state.get[0])} if state.exists else {}
        news: dict[tuple, list[tuple]] = {}
        if not state.hasTimedOut:
            for batch in batches:
                times = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
                for run, name, at, seq, status in zip(batch["ingest_run_id"], batch["work_key"], times, batch["seq"], batch["status"], strict=True):
                    news.setdefault((run, name), []).append((at, int(seq), status))
        rows = []
        for unit, found in news.items():
            shown = told(units.get(unit), found)
            units[unit] = shown[-1]
            rows += [(*unit, opened, status, attempts, started, finished, newest) for opened, started, finished, status, attempts, newest, _ in shown]
        passed = state.getCurrentWatermarkMs()
        ends = {unit: lives_on(known) // 1000 + 1 for unit, known in units.items()}
        kept = [(*unit, *known) for unit, known in units.items() if ends[unit] >= passed]
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(min(end for end in ends.values() if end >= passed), passed + 1))
        elif state.exists:
            state.remove()
        if rows:
            table = pd.DataFrame(rows, columns=_UNIT_COLUMNS)
            table["ingest_run_id"] = pd.array([None if run is None else int(run) for run in table["ingest_run_id"]], dtype="Int64")
            for name in ("opened_at", "started_at", "finished_at", "seen_at"):
                table[name] = pd.array(table[name], dtype="Int64").to_numpy("datetime64[us]", na_value=np.datetime64("NaT"))
            yield table

    return update


def live_units_with_end(log: DataFrame, idle: timedelta, linger: timedelta, delay: str = "10 minutes", groups: int | None = UNIT_GROUPS) -> DataFrame:
    """Current state of each unit, forgotten some time after it ended; run in update mode.

    A unit is forgotten ``linger`` after a terminal status and ``idle`` after
    any other; rows that come later open it anew, with attempts counted from
    nothing, whether the state was dropped by then or not.  So the number of
    units kept follows what is at work, not what was ever seen.  Rows older than
    the watermark (the newest time less ``delay``) are left out.  Rows without a
    time have no place in the log and are left out too.

    Units are dealt into ``groups`` by their key: a call of Python for each unit
    and batch takes hundreds of times as long as its few rows do.  Without it each
    unit has a state of its own.
    """
    timed = log.select("ingest_run_id", "work_key", "ts", "seq", "status").filter(F.col("ts").isNotNull()).withWatermark("ts", delay)
    if groups is None:
        return timed.groupBy("ingest_run_id", "work_key").applyInPandasWithState(
            _unit_updater(idle, linger), _UNIT_ROW, _UNIT_STATE, "update", GroupStateTimeout.EventTimeTimeout
        )
    # runs as text, since pandas holds whole numbers beside NULL as floats
    group = F.pmod(F.xxhash64("ingest_run_id", "work_key"), F.lit(groups)).alias("unit_group")
    dealt = timed.select(group, F.col("ingest_run_id").cast("string").alias("ingest_run_id"), "work_key", "ts", "seq", "status")
    return dealt.groupBy("unit_group").applyInPandasWithState(_group_updater(idle, linger), _UNIT_ROW, "units string", "update", GroupStateTimeout.EventTimeTimeout)


# S3 -------------------------------------------------------------------------


def error_rates(spans: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Spans and failures per category and window; rows later than the delay are dropped."""
    window = F.window("started_at", width, slide) if slide else F.window("started_at", width)
    counted = spans.withWatermark("started_at", delay).groupBy(window.alias("w"), "category").agg(
        F.count("*").alias("span_count"), F.count(F.when(F.col("status") == "error", 1)).alias("error_count")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "span_count", "error_count"
    )


def error_rates_with_late(spans: DataFrame, width: str, delay: timedelta, checkpoint: str, target: str) -> None:
    """Count a stream into windows and, beside them, what came too late for them.

    A window is closed once the newest time of earlier batches lies ``delay`` or
    more past its end; rows of a closed window count as late.  A batch adds one
    row for each window and category it touches to ``target/parts`` and the
    newest time so far to ``target/marks``, under its number; a repeated batch
    overwrites both.  ``rates_with_late`` reads the sums.
    """
    spark = spans.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        marks = f"{target}/marks"
        known = spark.read.schema("newest timestamp").parquet(f"{marks}/batch_id={batch_id - 1}").first() if batch_id else None
        newest = known["newest"] if known else None
        closed = F.lit(False) if newest is None else F.col("w.end") <= F.lit(newest - delay)
        counted = batch.groupBy(F.window("started_at", width).alias("w"), "category").agg(
            F.count("*").alias("rows"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"), F.max("started_at").alias("newest")
        )
        parts = f"{target}/parts/batch_id={batch_id}"
        counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "rows", "errors", "newest", closed.alias("late")).write.mode("overwrite").parquet(parts)
        reached = spark.read.parquet(parts).agg(F.greatest(F.max("newest"), F.lit(newest).cast("timestamp")).alias("newest"))
        reached.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    _drive(spans.writeStream.foreachBatch(store), checkpoint)


def rates_with_late(spark: SparkSession, target: str) -> DataFrame:
    """Spans and failures of each window and category in time, and the number of late spans."""
    parts = spark.read.option("basePath", f"{target}/parts").parquet(f"{target}/parts")
    in_time = lambda value: F.sum(F.when(F.col("late"), 0).otherwise(F.col(value)))
    return parts.groupBy("window_start", "window_end", "category").agg(
        in_time("rows").alias("span_count"), in_time("errors").alias("error_count"), F.sum(F.when(F.col("late"), F.col("rows")).otherwise(0)).alias("late_count")
    )


# S4 -------------------------------------------------------------------------


def activity_sessions(spans: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Stretches of activity per file; a pause longer than the gap ends one."""
    return _sessions(spans, gap, delay).drop("_newest")


def _sessions(spans: DataFrame, gap: str, delay: str) -> DataFrame:
    session = F.session_window("started_at", gap)
    counted = spans.withWatermark("started_at", delay).groupBy(session.alias("s"), "file_hash").agg(
        F.count("*").alias("span_count"), F.sum("duration_ms").alias("duration_ms"), F.max("started_at").alias("_newest")
    )
    return counted.select(
        F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "file_hash", "span_count", "duration_ms", "_newest"
    )


def still_open(spans: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """The sessions that a stream over these rows has not closed at the end of its input.

    ``spans`` is the same input as a batch; a flush after the last batch.
    """
    mark = spans.agg(F.max("started_at").alias("newest")).select(F.expr(f"newest - INTERVAL {delay}")).scalar()
    # A filter on the window itself would be pushed below the merging of sessions and break them up.
    return _sessions(spans, gap, delay).filter(F.col("_newest") + F.expr(f"INTERVAL {gap}") > mark).drop("_newest")


# S5 -------------------------------------------------------------------------


def complete_spans(starts: DataFrame, ends: DataFrame, delay: str = "10 minutes", longest: str = "1 hour", unfinished: bool = False) -> DataFrame:
    """Start and end records joined; both sides forget what is older than delay and longest span.

    With ``unfinished``, a start that met no end within ``longest`` comes out
    without end, status and duration when the watermark has passed it; what is
    still waiting at the end of the input is told by ``still_waiting``.
    """
    left = starts.withWatermark("started_at", delay).alias("s")
    right = ends.withWatermark("ended_at", delay).alias("e")
    within = F.expr(f"e.ended_at >= s.started_at AND e.ended_at <= s.started_at + INTERVAL {longest}")
    same = (F.col("s.span_id") == F.col("e.span_id")) & (F.col("s.ingest_run_id") == F.col("e.ingest_run_id"))
    joined = left.join(right, same & within, "leftOuter" if unfinished else "inner")
    took = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000.0
    return joined.select(
        "s.ingest_run_id", "s.span_id", "s.category", "started_at", "ended_at", "e.status", took.alias("duration_ms")
    )


_SPAN_RECORD = "kind string, ingest_run_id long, span_id string, category string, started_at timestamp, ended_at timestamp, status string"
_SPAN_ROW = "ingest_run_id long, span_id string, category string, started_at timestamp, ended_at timestamp, status string, duration_ms double"
_SPAN_MARK = "started_us long, ended_us long"


def complete_spans_by_batch(
    starts: DataFrame, ends: DataFrame, checkpoint: str, target: str, delay: timedelta = timedelta(minutes=10), longest: timedelta = timedelta(hours=1), unfinished: bool = False
) -> DataFrame:
    """The rows of ``complete_spans`` as a table, each batch by a join of its own.

    Most spans start and end in one batch.  They are joined there and never
    become state; only records that can still meet a later one are carried to
    the next batch: starts not ``longest`` and ends not at all behind the
    watermark, which is the older of the newest start and the newest end less
    ``delay``.  A batch leaves out records behind the watermark of those before
    it, and records without a time.  It writes ``target/out``, ``target/waiting``
    and ``target/marks`` under its number; a repeated batch overwrites them.
    """
    null = lambda kind: F.lit(None).cast(kind)
    opened = starts.select(F.lit("start").alias("kind"), "ingest_run_id", "span_id", "category", "started_at", null("timestamp").alias("ended_at"), null("string").alias("status"))
    closed = ends.select(F.lit("end").alias("kind"), "ingest_run_id", "span_id", null("string").alias("category"), null("timestamp").alias("started_at"), "ended_at", "status")
    span, lag = longest // timedelta(microseconds=1), delay // timedelta(microseconds=1)
    at = F.unix_micros(F.coalesce("started_at", "ended_at"))
    same = (F.col("s.span_id") == F.col("e.span_id")) & (F.col("s.ingest_run_id") == F.col("e.ingest_run_id"))
    took = F.unix_micros("e.ended_at") - F.unix_micros("s.started_at")
    meets = same & took.between(0, span)

    def watermark(mark: tuple) -> int | None:
        return None if None in mark else min(mark) - lag

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = lambda name, number: f"{target}/{name}/batch_id={number}"
        if batch_id:
            past = tuple(spark.read.schema(_SPAN_MARK).parquet(place("marks", batch_id - 1)).first())
            carried = spark.read.schema(f"{_SPAN_RECORD}, met boolean").parquet(place("waiting", batch_id - 1))
        else:
            past, carried = (None, None), spark.createDataFrame([], f"{_SPAN_RECORD}, met boolean")
        behind = watermark(past)
        news = batch.filter(at.isNotNull() if behind is None else at > behind).persist()
        try:
            newest = news.agg(F.max(F.unix_micros("started_at")), F.max(F.unix_micros("ended_at"))).first()
            mark = tuple(max((x for x in pair if x is not None), default=None) for pair in zip(past, newest, strict=True))
            now = watermark(mark)
            rows = news.withColumns({"met": F.lit(False), "new": F.lit(True)}).unionByName(carried.withColumn("new", F.lit(False)))
            left, right = rows.filter("kind = 'start'").alias("s"), rows.filter("kind = 'end'").alias("e")
            over = F.lit(False) if now is None else F.unix_micros("s.started_at") + span < now
            first_told = F.col("s.new") | F.col("e.new")
            if unfinished:
                first_told = F.when(F.col("e.span_id").isNull(), ~F.col("s.met") & over).otherwise(first_told)
            told = left.join(right, meets, "leftOuter" if unfinished else "inner").filter(first_told)
            told.select("s.ingest_run_id", "s.span_id", "s.category", "s.started_at", "e.ended_at", "e.status", (took / 1000.0).alias("duration_ms")).write.mode("overwrite").parquet(place("out", batch_id))
            waiting, near, later = left.filter(~over), right, right
            if now is not None:
                near, later = right.filter(F.unix_micros("e.ended_at") >= now - span), right.filter(F.unix_micros("e.ended_at") >= now)
            if unfinished:
                waiting = waiting.join(near, meets, "left_semi").withColumn("met", F.lit(True)).unionByName(waiting.join(near, meets, "left_anti"))
            waiting.unionByName(later).drop("new").write.mode("overwrite").parquet(place("waiting", batch_id))
            spark.createDataFrame([mark], _SPAN_MARK).coalesce(1).write.mode("overwrite").parquet(place("marks", batch_id))
        finally:
            news.unpersist()

    _drive(opened.unionByName(closed).writeStream.foreachBatch(store), checkpoint)
    spark = starts.sparkSession
    try:
        return spark.read.schema(f"{_SPAN_ROW}, batch_id bigint").option("basePath", f"{target}/out").parquet(f"{target}/out").drop("batch_id")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SPAN_ROW)  # there was no input, so no batch


def still_waiting(starts: DataFrame, came_out: DataFrame) -> DataFrame:
    """Starts (as a batch) that a stream with ``unfinished`` has neither joined nor given up."""
    waiting = starts.join(came_out, ["ingest_run_id", "span_id"], "left_anti")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return waiting.select("ingest_run_id", "span_id", "category", "started_at", none("timestamp", "ended_at"), none("string", "status"), none("double", "duration_ms"))
