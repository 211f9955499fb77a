"""Work that grows no faster than the input."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F
from test_structure import best_by_hand

import __spark_entry__ as contract
from folioscope.functions import boxes
from folioscope.functions import text as txt
from folioscope.operators import alignment, documents
from folioscope.plans import roles
from folioscope.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_compares_no_file_with_every_other(spark, sf):
    """Each side holds one reader only, so the reader is a constant on both sides of the full join."""
    plan = plan_of(contract.queries()["comparison_report"](spark, sf))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_report_keeps_rows_of_either_side(spark):
    columns = "file_hash string, annotation_engine string, status string, error string, reader_provider string, reader_model string, text string, output_json string"
    raw = spark.createDataFrame([(f, e, "ok", None, "p", "m", "abc", "{}") for f, e in (("a", "mineru"), ("b", "infinity"), (None, "mineru"), ("a", "mineru"))], columns)
    regions = spark.createDataFrame([("a", "mineru", 1), ("a", "mineru", 2), ("c", None, 1), (None, "mineru", 1)], "file_hash string, annotation_engine string, page_no int")
    got = sorted((r["file_hash"] or "", r["annotation_engine"], r["status"] or "", r["region_count"], r["text_chars"]) for r in documents.comparison_report(raw, regions).collect())
    assert got == [("", "mineru", "", 1, 0), ("", "mineru", "ok", 0, 3), ("a", "mineru", "ok", 2, 3), ("a", "mineru", "ok", 2, 3), ("b", "infinity", "ok", 0, 3), ("c", "docling", "", 1, 0)]


def test_alignment_shuffles_rows_by_page_only(spark, sf):
    """What is made of words is joined and grouped where the page is."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = roles.dealt_turns(spark, sf)
        words = pages.select("file_hash", "page_no", F.posexplode(F.split("text", " ")).alias("place", "text"))
        words = alignment.page_words(words.withColumn("box", boxes.make_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))))
        texts = roles.regions(spark, sf, pages).select("file_hash", "page_no", "source_ref", txt.evidence_tokens(F.col("text")).alias("tokens"), F.lit("").alias("scope"), F.lit(None).cast(boxes.BOX_TYPE).alias("estimate"))
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(alignment.align(texts, words)))
        assert dealt and all(re.fullmatch(r"file_hash#\d+, page_no#\d+, \d+", keys) for keys in dealt), dealt
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_alignment_over_many_blocks_of_words(spark):
    """Long pages and texts, equal texts and texts as long as the page, against every window."""
    rng = random.Random(5)
    words = [(rng.choice([f"w{i}" for i in range(40)]), (float(i % 10 * 20), float(i // 10 * 12), float(i % 10 * 20 + 15), float(i // 10 * 12 + 9))) for i in range(230)]
    elements, want = [], {}
    for e, (at, n) in enumerate([(0, 230), (0, 70), (60, 100), (63, 1), (64, 9), (127, 66), (200, 30), (226, 4), (64, 9), (40, 25)]):
        target = [w for w, _b in words[at : at + n]]
        for _ in range(n // 9):
            target[rng.randrange(len(target))] = "other"
        for estimate in (None, (100.0, 130.0)):
            for copy in range(2):
                ref = f"e{e}{estimate is None}{copy}"
                elements.append(("f", 1, ref, None, "text", " ".join(target), (95.0, 125.0, 105.0, 135.0, "TOPLEFT") if estimate else None))
                want[ref] = best_by_hand(words, target, estimate)
    token_df = spark.createDataFrame([("f", 1, i, w, (*b, "TOPLEFT")) for i, (w, b) in enumerate(words)], f"file_hash string, page_no int, place int, text string, box {boxes.BOX_TYPE}")
    element_df = spark.createDataFrame(elements, f"file_hash string, page_no int, source_ref string, parent_ref string, label string, text string, estimate {boxes.BOX_TYPE}")
    got = {r["source_ref"]: (round(r["score"], 9), tuple(r["raw_bbox"])[:4]) for r in alignment.align_elements(element_df, token_df).collect()}
    assert got == {ref: (round(best[0], 9), best[1]) for ref, best in want.items() if best} and len(got) >= 36


T0 = dt.datetime(2024, 5, 1)


def test_spans_of_one_batch_never_become_state(spark, tmp_path):
    """Only records that can meet a later one are carried on; pairs, unfinished starts and late rows come out as in a stream join."""
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    rows = []
    for day in range(3):  # 50 spans within a batch
        for k in range(50):
            name, t = f"s{day}-{k}", day * 1440 + 20 * k
            rows += [(day, "start", name, at(t), None), (day, "end", name, None, at(t + 2))]
    rows += [(0, "start", "over", at(1430), None), (1, "end", "over", None, at(1450))]  # starts in one batch, ends in the next
    rows += [(1, "end", "over", None, at(1460)), (2, "end", "over", None, at(2890))]  # ends twice, and once after more than the longest time
    rows += [(0, "end", "turned", None, at(1435)), (1, "start", "turned", at(1434), None)]  # the end arrives first
    rows += [(0, "start", "open", at(5), None), (2, "start", "waits", at(3855), None), (0, "start", "wrong run", at(6), None)]
    rows += [(2, "start", "late", at(60), None), (2, "end", "open", None, at(30)), (1, "start", "no time", None, None)]
    rows += [(day, kind, "twice", *times) for day, kind, times in ((0, "start", (at(7), None)), (0, "start", (at(7), None)), (0, "end", (None, at(9))))]
    given = spark.createDataFrame(rows, "arrival int, kind string, span_id string, started_at timestamp, ended_at timestamp")
    state, target, tables = str(tmp_path / "state"), str(tmp_path / "out"), []

    def run(stream):
        run_id = F.when(F.col("span_id") == "wrong run", F.when(F.col("kind") == "start", 2).otherwise(3)).otherwise(1).cast("long").alias("ingest_run_id")
        starts = stream.filter("kind = 'start'").select(run_id, "span_id", F.lit("c").alias("category"), "started_at")
        ends = stream.filter("kind = 'end'").select(run_id, "span_id", "ended_at", F.lit("ok").alias("status"))
        tables.append(jobs.complete_spans_by_batch(starts, ends, state, target, unfinished=True))

    jobs.replay(given, "arrival", "spans", run)
    got = sorted((r["span_id"], r["status"] or "", r["duration_ms"] or 0) for r in tables[-1].collect())
    minute = 60_000.0
    want = [(f"s{day}-{k}", "ok", 2 * minute) for day in range(3) for k in range(50)]
    want += [("over", "ok", 20 * minute), ("over", "ok", 30 * minute), ("turned", "ok", minute), ("open", "", 0), ("wrong run", "", 0), ("twice", "ok", 2 * minute), ("twice", "ok", 2 * minute)]
    assert got == sorted(want)
    waiting = {n: sorted((r["kind"], r["span_id"]) for r in spark.read.parquet(f"{target}/waiting/batch_id={n}").collect()) for n in range(3)}
    assert waiting[0] == [("end", "turned"), ("start", "over")]
    assert ("start", "waits") in waiting[2] and max(map(len, waiting.values())) <= 6


def test_span_queries_put_no_record_into_a_state_store(spark, sf, monkeypatch):
    def refuse(*args, **options):
        raise AssertionError("a join of two streams stores every record")

    monkeypatch.setattr(jobs, "complete_spans", refuse)
    for name in ("stream_unfinished_spans", "stream_completed_spans"):
        assert contract.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
