"""Page Markdown, run analytics, keyed writes, work plan and readers."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import ids
from folioscope.operators import documents, markdown, runs, work
from folioscope.sources import files as corpus
from folioscope.sources import keyed, raw_layer

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# --- sources -----------------------------------------------------------------


def test_scan_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PDF").write_bytes(b"same")
    (tmp_path / "sub" / "b.txt").write_bytes(b"same")
    (tmp_path / "sub" / "noext").write_bytes(b"other")
    rows = {r["filename"]: r for r in corpus.scan_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.PDF", "b.txt", "noext"}
    assert rows["a.PDF"]["file_hash"] == hashlib.sha256(b"same").hexdigest() == rows["b.txt"]["file_hash"]
    assert (rows["a.PDF"]["extension"], rows["noext"]["extension"], rows["a.PDF"]["size_bytes"]) == (".pdf", None, 4)
    assert [r["filename"] for r in corpus.scan_directory(spark, str(tmp_path), supported_only=True).collect()] == ["a.PDF"]


def test_scan_takes_every_name_and_no_link(spark, tmp_path):
    (tmp_path / "_h" / ".deep").mkdir(parents=True)
    for name in ("_x.pdf", ".x.pdf", "X.Pdf", "y.jpeg", "_h/z.PNG", "_h/.deep/q.txt", "a b%20c.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "link.pdf").symlink_to(tmp_path / "X.Pdf")
    (tmp_path / "folder-link").symlink_to(tmp_path / "_h")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        rows = {r["filename"]: r["file_hash"] for r in corpus.scan_directory(spark, root).collect()}
        assert set(rows) == {"_x.pdf", ".x.pdf", "X.Pdf", "y.jpeg", "z.PNG", "q.txt", "a b%20c.pdf"}
        assert rows["z.PNG"] == hashlib.sha256(b"_h/z.PNG").hexdigest()
        shown = {r["filename"] for r in corpus.scan_directory(spark, root, supported_only=True).collect()}
        assert shown == set(rows) - {"q.txt"}
    (tmp_path / "empty").mkdir()
    assert corpus.scan_directory(spark, str(tmp_path / "empty")).count() == 0


def test_upsert_is_idempotent_and_last_write_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], ["k", "v"])
    delta = spark.createDataFrame([(2, "x"), (3, "c"), (2, "y")], ["k", "v"])
    once = keyed.upsert(base, delta, ["k"], [F.col("v")])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "y"), (3, "c")]
    again = keyed.upsert(once, delta, ["k"], [F.col("v")])
    assert sorted(tuple(r) for r in again.collect()) == [(1, "a"), (2, "y"), (3, "c")]


def test_sticky_status_and_slices(spark, tmp_path):
    base = spark.createDataFrame([(1, "ok"), (2, "running")], ["k", "status"])
    delta = spark.createDataFrame([(1, "planned"), (2, "planned"), (3, "planned")], ["k", "status"])
    got = sorted(tuple(r) for r in keyed.upsert_keep_terminal(base, delta, ["k"]).select("k", "status").collect())
    assert got == [(1, "ok"), (2, "planned"), (3, "planned")]
    old = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("g", "a", 3)], ["file_hash", "engine", "v"])
    fresh = spark.createDataFrame([("f", "a", 9)], ["file_hash", "engine", "v"])
    slices = spark.createDataFrame([("f", "a"), ("g", "a")], ["file_hash", "engine"])
    assert sorted(r["v"] for r in keyed.replace_slice(old, fresh, slices, ["file_hash", "engine"]).collect()) == [2, 9]
    path = str(tmp_path / "t")
    keyed.write_slices(old, path, ["engine"])
    keyed.write_slices(fresh, path, ["engine"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 9]


def test_failed_reads_keep_no_text(spark):
    rows = [("f", "docling", 1, "t", "{}", "ok", None, "p", "m"), ("g", "docling", 1, "t", "{}", "error", "boom", "p", "m")]
    schema = "file_hash string, annotation_engine string, ingest_run_id long, text string, output_json string, status string, error string, reader_provider string, reader_model string"
    got = {r["file_hash"]: r for r in raw_layer.reader_rows(spark.createDataFrame(rows, schema)).collect()}
    assert (got["f"]["text"], got["f"]["error"]) == ("t", None)
    assert (got["g"]["text"], got["g"]["output_json"], got["g"]["error"]) == (None, None, "boom")


# --- Markdown ----------------------------------------------------------------


def test_section_markers(spark):
    text = "lead\n# Page 2\nsecond\n<!-- page 1 -->\nfirst\n##  page 2\n\nmore\nsee <!-- page 9 --> inline"
    docs = spark.createDataFrame([("f", text), ("g", "no marker")], ["file_hash", "text"])
    got = {(r["file_hash"], r["page_no"]): r["markdown_text"] for r in markdown.split_page_sections(docs).collect()}
    assert got == {("f", 2): "second\n\nmore\nsee <!-- page 9 --> inline", ("f", 1): "first"}
    found = {(r["file_hash"], r["page_no"]): r["page_text"] for r in markdown.comment_pages(docs).collect()}
    assert found["f", 9] == "inline" and found["f", 1].startswith("first")
    assert not any(f == "g" for f, _p in found)


def test_single_page_document_needs_no_marker(spark):
    docs = spark.createDataFrame([("f", " whole document "), ("g", "two pages here")], ["file_hash", "text"])
    pages = spark.createDataFrame([("f", 4, 1.0, 2.0), ("g", 1, 1.0, 2.0), ("g", 2, 1.0, 2.0)], ["file_hash", "page_no", "width", "height"])
    rows = markdown.page_markdown(docs, pages, "markitdown", "p", "m").collect()
    assert [(r["file_hash"], r["page_no"], r["markdown_text"]) for r in rows] == [("f", 4, "whole document")]


def markdown_rows(spark, rows):
    full = [(*r, "p", "m", 1.0, 2.0) for r in rows]
    return spark.createDataFrame(full, ["file_hash", "page_no", "markdown_engine", "markdown_text", "markdown_provider", "markdown_model", "page_width", "page_height"])


def fallback_inputs(spark):
    schema = "file_hash string, annotation_engine string, text string, output_json string, status string, reader_provider string, reader_model string"
    layout = json.dumps({"texts": [{"text": "A", "prov": [{"page_no": 2}]}, {"orig": "B", "prov": [{"page_no": 2}]}]})
    raw = spark.createDataFrame([("h", "docling", "plain", layout, "ok", "", ""), ("h", "mineru", "x", None, "ok", "", ""), ("k", "mineru", "all text", None, "ok", "q", "r")], schema)
    stored = spark.createDataFrame([(f, p, v, 1.0, 2.0) for f in "hk" for p in (1, 2) for v in ("raw", "normalized")], ["file_hash", "page_no", "variant", "page_width", "page_height"])
    return raw, stored


def test_read_markdown_cases(spark):
    rows = markdown_rows(spark, [("f", 1, "markitdown", "good enough"), ("f", 1, "infinity_markdown", "n/a"), ("f", 1, "markitdown_cu", "also good text")])
    raw, stored = fallback_inputs(spark)
    read = lambda engine: {(r["file_hash"], r["page_no"]): (r["markdown_text"], r["source_engine"]) for r in markdown.read_markdown(rows, raw, stored, engine).collect()}
    best = read(markdown.BEST_GENERATOR)
    assert best["f", 1] == ("good enough", "markitdown")
    assert best["h", 2] == ("A\n\nB", "docling") and best["h", 1] == ("", "docling")
    assert best["k", 1] == ("all text", "mineru") and best["k", 2] == ("", "mineru")
    assert read("infinity_markdown")["f", 1] == ("n/a", "infinity_markdown")
    assert read("unknown") == {}


def test_outcomes_and_summaries(spark):
    rows = [("f", "a", 1, True, None), ("f", "a", 2, False, None), ("f", "b", 1, True, None), ("g", "a", None, False, "crash")]
    df = spark.createDataFrame(rows, "file_hash string, markdown_engine string, page_no int, usable boolean, error string")
    made = markdown.generator_outcomes(df)
    got = {(r["file_hash"], r["markdown_engine"]): (r["status"], r["error"]) for r in made.collect()}
    assert got == {("f", "a"): ("partial", "1 page(s) failed"), ("f", "b"): ("ok", None), ("g", "a"): ("error", "crash")}
    merged = {r["file_hash"]: (r["page_count"], r["error_count"]) for r in markdown.merge_summaries(made).collect()}
    assert merged == {"f": (2, 0), "g": (0, 1)}


def test_result_markdown_forms(spark):
    results = ['"plain"', '{"markdown": " ", "text": " t "}', '{"content": "c"}', " raw text "]
    df = spark.createDataFrame([(r,) for r in results], ["r"]).select(markdown.result_markdown(F.col("r")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["plain", "t", "c", "raw text"]


# --- runs --------------------------------------------------------------------

SPAN = "ingest_run_id long, span_id string, parent_span_id string, file_hash string, page_no int, name string, pipeline_step string, category string, annotation_engine string, status string, started_at timestamp, ended_at timestamp, duration_ms double, error_message string"


def spans(spark):
    rows = [
        (1, "a", None, "f", None, "root", "s", "pipeline", None, "ok", at(0), at(10), 10000.0, None),
        (1, "b", "a", "f", 2, "page two", "s", "pipeline", "docling", "error", at(1), at(3), 2000.0, "unreadable page"),
        (1, "c", "b", None, None, "inner", "lmstudio_chat_completion", "lmstudio", None, "error", at(1), at(2), 4000.0, ""),
        (1, "d", "gone", None, None, "orphan", "s", "pipeline", None, "ok", at(9), at(10), 1.0, None),
    ]
    return spark.createDataFrame(rows, SPAN)


def test_trace_filters(spark):
    found = runs.trace_spans(spans(spark), run_id=1, file_hash="f", page_no=2, status="error").collect()
    assert [(r["span_id"], r["error_message"]) for r in found] == [("b", "unreadable page")]
    assert runs.trace_spans(spans(spark), status="all", text="UNREADABLE").count() == 1
    assert runs.trace_spans(spans(spark), text="  ").count() == 4
    events = spark.createDataFrame([(1, "f", 2, "n", None)], "ingest_run_id long, file_hash string, page_no int, name string, message string")
    assert runs.trace_events(events, run_id=1, status="error").count() == 1


def test_depths_inheritance_and_collapse(spark):
    depths = {r["span_id"]: r["depth"] for r in runs.span_depths(spans(spark)).collect()}
    assert depths == {"a": 0, "b": 1, "c": 2, "d": 0}
    filled = {r["span_id"]: (r["file_hash"], r["page_no"]) for r in runs.inherit_from_parents(spans(spark), ["file_hash", "page_no"]).collect()}
    assert filled == {"a": ("f", None), "b": ("f", 2), "c": ("f", 2), "d": (None, None)}
    shown = runs.visible_timeline(spans(spark), spans(spark).filter("span_id = 'a'"))
    assert {r["span_id"] for r in shown.collect()} == {"a", "d"}


def test_deep_chain_needs_few_rounds(spark):
    chain = spark.range(300).select(F.lit(1).alias("ingest_run_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_span_id"))
    rows = {int(r["span_id"]): r["depth"] for r in runs.span_depths(chain).collect()}
    assert rows == {i: i for i in range(300)}


def test_cycles_end(spark):
    rows = [(1, "a", "b"), (1, "b", "a"), (1, "c", "a"), (1, "d", "d"), (1, "e", None), (1, "f", "e")]
    df = spark.createDataFrame(rows, "ingest_run_id long, span_id string, parent_span_id string")
    assert {r["span_id"]: r["depth"] for r in runs.span_depths(df).collect()} == {"a": None, "b": None, "c": None, "d": None, "e": 0, "f": 1}
    valued = df.withColumn("file_hash", F.when(F.col("span_id").isin("b", "e"), F.col("span_id")))
    assert {r["span_id"]: r["file_hash"] for r in runs.inherit_from_parents(valued, ["file_hash"]).collect()} == {"a": "b", "b": "b", "c": "b", "d": None, "e": "e", "f": "e"}
    assert {r["span_id"] for r in runs.visible_timeline(df, df.filter("span_id = 'b'")).collect()} == {"d", "e", "f"}


def units(spark):
    schema = "ingest_run_id long, work_unit_id long, file_hash string, page_no int, phase string, engine string, provider string, model string, status string, duration_ms double, metadata_json string"
    rows = [
        (1, 1, "f", 2, "annotation", "docling", "p", "m", "ok", 100.0, '{"source_path": "C:\\\\in\\\\x.pdf"}'),
        (1, 2, "f", None, "artifact", "preview", "p", "m", "planned", None, "bad json"),
        (1, 3, None, None, "markdown", "markitdown", "p", "m", "error", 50.0, None),
    ]
    return spark.createDataFrame(rows, schema)


def test_progress(spark):
    none = spark.createDataFrame([], "file_hash string, filename string")
    paths = spark.createDataFrame([], "file_hash string, path string")
    named = runs.work_unit_rows(units(spark), none, paths)
    assert {r["work_unit_id"]: r["source_path"] for r in named.collect()} == {1: "C:\\in\\x.pdf", 2: None, 3: None}
    s = runs.progress_summary(units(spark)).first()
    assert (s["total_units"], s["completed_units"], s["planned_units"], s["failed_units"]) == (3, 1, 1, 1)
    assert round(s["percent_complete"], 3) == 66.667 and s["estimated_remaining_ms"] == 75.0
    by_kind = {(r["kind"], r["id"]): r for r in runs.five_breakdowns(named).collect()}
    assert by_kind["file", "f"]["label"] in ("run", "x.pdf")
    assert by_kind["page", "f:2"]["label"] == "x.pdf · page 2"
    assert round(by_kind["phase", "annotation"]["share_percent"], 3) == 66.667
    tree = {(r["node_level"], r["file_key"], r["page_key"]): r["status"] for r in runs.progress_tree(units(spark)).collect() if r["node_level"] in (1, 2)}
    assert tree == {(1, "f", None): "planned", (2, "f", "2"): "ok", (2, "f", "document"): "planned", (1, "run", None): "error", (2, "run", "document"): "error"}


def test_summary_duration_falls_back(spark):
    run_rows = spark.createDataFrame([(1, "/d", "ok", at(0), None), (2, "/d", "ok", at(0), at(4))], "ingest_run_id long, source_directory string, status string, started_at timestamp, finished_at timestamp")
    leases = spark.createDataFrame([(1, 1), (1, 2)], "ingest_run_id long, lease_id long")
    got = {r["ingest_run_id"]: r for r in runs.analytics_summary(run_rows, units(spark), spans(spark), leases).collect()}
    assert got[1]["duration_ms"] == 150.0 and got[2]["duration_ms"] == 4000.0
    assert got[1]["failed_llm_duration_ms"] == 4000.0 and got[1]["model_lease_count"] == 2
    advice = {(r["ingest_run_id"], r["id"]) for r in runs.recommendations(runs.analytics_summary(run_rows, units(spark), spans(spark), leases)).collect()}
    assert advice == {(1, "failed-llm-cost"), (1, "model-switches"), (2, "no-dominant-bottleneck")}
    errors = {r["id"]: r["sample_error"] for r in runs.error_breakdown(spans(spark), runs.run_list(run_rows, spans(spark))).collect()}
    assert errors == {"docling": "unreadable page", "lmstudio": None}


def test_unit_life_cycle(spark):
    rows = [(1, "k", 1, at(0), "planned", None), (1, "k", 2, at(1), "running", None), (1, "k", 3, at(2), "error", "boom"), (1, "k", 4, at(5), "running", None), (1, "k", 5, at(8), "ok", None), (1, "r", 6, at(0), "error", "x"), (1, "r", 7, at(1), "running", None)]
    df = spark.createDataFrame(rows, "ingest_run_id long, work_key string, seq long, ts timestamp, status string, error string")
    got = {r["work_key"]: r for r in runs.current_units(df).collect()}
    assert (got["k"]["status"], got["k"]["attempt_count"], got["k"]["duration_ms"], got["k"]["error"]) == ("ok", 2, 3000, None)
    assert (got["r"]["status"], got["r"]["finished_at"], got["r"]["error"]) == ("running", None, None)


def test_images_are_redacted(spark):
    payload = '{"url":"data:image/png;base64,AAAA","text":"keep data:image here"}'
    got = spark.range(1).select(runs.redact_images(F.lit(payload)).alias("x")).first()["x"]
    assert json.loads(got) == {"url": "[diagnostic attachment on filesystem]", "text": "keep data:image here"}


# --- work --------------------------------------------------------------------


def test_reader_failure_keeps_good_pages(spark):
    def picky_reader(rows):
        if any(row["page_no"] == 3 for row in rows):
            raise RuntimeError("page three")
        return [f"text {row['page_no']}" for row in rows]

    pages = spark.createDataFrame([("f", p) for p in range(1, 8)], ["file_hash", "page_no"]).coalesce(1)
    got = {r["page_no"]: r for r in work.annotate(pages, picky_reader, 4).collect()}
    assert [p for p, r in got.items() if r["status"] == "error"] == [3]
    assert got[3]["error_type"] == "RuntimeError" and got[3]["error"] == "page three"
    assert got[1]["result"] == "text 1" and got[7]["elapsed_seconds"] >= 0


def test_pending_work(spark):
    files = spark.createDataFrame([("f", ".pdf"), ("g", ".txt"), ("h", ".png")], ["file_hash", "extension"])
    raw = spark.createDataFrame([("f", "docling", "ok"), ("h", "docling", "ok"), ("h", "mineru", "error")], ["file_hash", "annotation_engine", "status"])
    chunks = spark.createDataFrame([("f",)], ["file_hash"])
    got = {tuple(r) for r in work.pending_engines(files, ["docling", "mineru"], raw, chunks).collect()}
    assert got == {("f", "mineru"), ("h", "docling"), ("h", "mineru")}
    assert work.pending_engines(files, ["docling"], raw, chunks, reprocess=True).count() == 2
    pages = spark.createDataFrame([("f", 1)], ["file_hash", "page_no"])
    made = spark.createDataFrame([("f", 1, "markitdown", "good page text")], ["file_hash", "page_no", "markdown_engine", "markdown_text"])
    none = work.files_by_engine(files, ["docling"]).limit(0)
    todo = {r["file_hash"] for r in work.pending_markdown(files, ["markitdown"], none, pages, made).collect()}
    assert todo == {"h"}


def test_limited_json(spark):
    value = {"a": None, "b": "x" * 12, "c": list(range(5)), "d": {"e": {"f": 1}}}
    df = spark.createDataFrame([(json.dumps(value),)], ["j"]).select(work.limited_json(F.col("j"), 5, 2, 3).alias("x"))
    assert json.loads(df.first()["x"]) == {"b": "xxxxx... [truncated]", "c": [0, 1, 2], "d": {"e": "{'f':... [truncated]"}}


def test_common_root_ignores_case(spark):
    paths = spark.createDataFrame([("/Data/In/a/x.pdf",), ("\\data\\in\\b\\y.pdf",), ("/DATA/in/z.pdf",)], ["path"])
    assert [p.lower() for p in documents.common_root(paths).first()["root_parts"]] == ["data", "in"]
    got = sorted("/".join(r["folder_parts"]) for r in documents.relative_folders(paths).collect())
    assert got == ["(root)", "a", "b"]


def test_work_keys(spark):
    made = spark.range(1).select(ids.work_key(F.lit("p"), F.lit("e"), F.lit("f"), F.lit("")).alias("a"), ids.work_key(F.lit("p"), F.lit("e"), F.lit("f"), F.lit("x")).alias("b"), ids.server_execution_key(F.lit("http://h/"), F.lit("m")).alias("c")).first()
    assert tuple(made) == ("p:e:f", "p:e:x:f", "lmstudio:http://h:m")
    assert ids.next_id(spark.createDataFrame([(4,), (9,)], ["i"]), "i") == 10


def test_bad_rotation_is_rejected(spark):
    from folioscope.functions.boxes import valid_rotation

    df = spark.createDataFrame([(450,), (-90,), (45,), (None,)], "d int").select(valid_rotation(F.col("d")).alias("x"))
    assert [r["x"] for r in df.collect()] == [90, 270, None, 0]


@pytest.mark.parametrize("limit,cap,want", [(0, 100, 1), (500, 100, 100), (7, None, 7)])
def test_limit_clamp(limit, cap, want):
    from folioscope.functions.casts import clamp_limit

    assert clamp_limit(limit, cap) == want


def test_units_are_added_up_without_their_names(spark):
    """Units meet in sums of numbers, which need no sort; names are told for the rows that are shown, also where ids are missing."""
    rows = [(1, n, "annotation" if n % 3 else None, "e", "p", "m", f"f{n % 7}" if n % 5 else None, n % 4, "ok", float(n), None, f"/in/{n % 2}/f{n % 7}.pdf", f"name {n % 7}") for n in range(140)]
    schema = "ingest_run_id long, work_unit_id long, phase string, engine string, provider string, model string, file_hash string, page_no int, status string, duration_ms double, metadata_json string, source_path string, filename string"
    named = spark.createDataFrame(rows, schema)
    whole = {(r["kind"], r["id"]): r for r in runs.five_breakdowns(named).collect()}
    assert whole["phase", None]["unit_count"] == 47 and whole["phase", None]["duration_ms"] == sum(range(0, 140, 3))
    assert whole["file", "f1"]["label"] == "name 1" and whole["file", "f1"]["metadata"] == {"file_hash": "f1", "filename": "name 1", "source_path": "/in/0/f1.pdf", "phase_count": "1"}
    assert whole["page", "f1:2"]["metadata"]["page_no"] == "2" and whole["model", "p:m"]["page_count"] == 28
    few = runs.five_breakdowns(named, 2)
    assert all(r["label"] == whole[r["kind"], r["id"]]["label"] and r["metadata"] == whole[r["kind"], r["id"]]["metadata"] for r in few.collect())
    assert "SortAggregate" not in runs._summed_entries(named)._jdf.queryExecution().executedPlan().toString()
