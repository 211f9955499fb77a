"""Matching, ranking, highlights and merged search against brute force."""

import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from folioscope.functions import similarity, spans
from folioscope.operators import search, terms

STAMP = dt.datetime(2024, 1, 1)


def test_fuzzy_ratios():
    assert similarity.ratio("abc", "abc") == 100.0
    assert similarity.ratio("", "") == 100.0
    assert round(similarity.ratio("kitten", "sitting"), 3) == round(200 * 4 / 13, 3)
    assert similarity.partial_ratio("foo", "a foo b") == 100.0
    assert similarity.weighted_ratio("total amount", "amount total") == 95.0
    rng = random.Random(2)
    for _ in range(60):
        needle = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
        short, long = sorted((needle, text), key=len)
        windows = {long[i : i + len(short)] for i in range(len(long) - len(short) + 1)}
        windows |= {long[:c] for c in range(1, len(short))} | {long[-c:] for c in range(1, len(short))}
        want = max(similarity.ratio(short, w) for w in windows) if short not in long else 100.0
        assert abs(similarity.partial_ratio(needle, text) - want) < 1e-9


def test_match_queries_equals_like(spark):
    rng = random.Random(4)
    words = ["ab", "abc", "b", "c.d", "the", "x\\y", "a%b", "é"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))).title()) for i in range(120)]
    asked = ["ab", "abc b", "the ab the", "b c", "_b the", "a%b", "x\\y", "%", "zz", "c.d ab", "e_b"]
    df = spark.createDataFrame(texts, ["k", "t"])
    queries = search.prepare_queries(spark.createDataFrame(list(enumerate(asked)), ["query_id", "text"]))
    got = {(r["query_id"], r["k"]) for r in search.match_queries(df, queries, "k", "t").collect()}
    want = set()
    for q, query in enumerate(asked):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in query)
        want |= {(q, k) for k, t in texts if re.search(pattern, t.lower(), re.S)}
    assert got == want


def test_bm25_equals_formula_with_and_without_index(spark, tmp_path):
    docs = [("d1", "Alpha beta beta gamma"), ("d2", "beta"), ("d3", "delta alpha alpha"), ("d4", "")]
    df = spark.createDataFrame(docs, ["chunk_id", "text"])
    queries = search.prepare_queries(spark.createDataFrame([(1, "alpha BETA"), (2, "none")], ["query_id", "text"]))
    lengths = {d: len(t.split()) for d, t in docs}
    mean = sum(lengths.values()) / 4
    want = {}
    for word in ("alpha", "beta"):
        holders = {d: t.lower().split().count(word) for d, t in docs if word in t.lower().split()}
        idf = math.log(1 + (4 - len(holders) + 0.5) / (len(holders) + 0.5))
        for d, tf in holders.items():
            want[d] = want.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / mean))
    path = str(tmp_path / "index")
    search.write_index(df, path, buckets=4)
    for index in (None, path):
        got = {r["chunk_id"]: r["bm25"] for r in search.bm25_scores(df, queries, index_path=index).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_highlights():
    kinds = lambda q, t: [(h["match_kind"], h["start"], h["end"]) for h in spans.find_highlights(q, t, "snippet")]
    assert kinds("Foo bar", "a FOO BAR foo bar") == [("exact_phrase", 2, 9), ("exact_phrase", 10, 17)]
    assert kinds("bar foo", "Foo and bar.") == [("exact_token", 0, 3)]
    assert kinds("fo", "f-o") == [("fuzzy_character", 0, 1), ("fuzzy_character", 2, 3)]
    assert kinds("qq", "x" * 200) == [("chunk_context", 0, 160)]
    assert kinds("", "x") == []


def test_phrase_spans_native_equals_python(spark):
    rows = [("foo", "a FOO b foofoo"), ("a.b", "a.b axb A.B"), ("zz", "none"), ("a\\e", "b A\\E a\\e")]
    df = spark.createDataFrame(rows, ["q", "t"]).select("q", "t", spans.phrase_spans(F.col("q"), F.col("t")).alias("s"))
    for r in df.collect():
        want = [m.span() for m in re.finditer(re.escape(r["q"]), r["t"].lower())]
        assert [(s["start"], s["end"]) for s in r["s"]] == want


def test_snippets(spark):
    long = "start " + "x" * 300 + " needle " + "y" * 300
    rows = [("needle", long), ("needle", "short text"), ("absent", long), ("tail", "z" * 400 + " tail")]
    df = spark.createDataFrame(rows, ["q", "t"]).select(spans.snippet(F.col("q"), F.col("t")).alias("s"))
    got = [r["s"] for r in df.collect()]
    hit = long.index("needle")
    assert got[0] == long[hit - 40 : hit + 180].strip()
    assert got[1] == "short text"
    assert got[2] == long[:220].strip()
    assert got[3].endswith("tail") and len(got[3]) == 220


def small_tables(spark):
    box = (10.0, 20.0, 200.0, 40.0, "TOPLEFT")
    box_type = "struct<left:double,top:double,right:double,bottom:double,coord_origin:string>"
    regions = spark.createDataFrame(
        [
            ("r1", "f1", None, "c1", 0, 2, "ref-1", "text", "Total Amount Due: USD 12.50", None, box, "text", STAMP, STAMP),
            ("r2", "f1", "mineru", None, None, 3, "ref-2", "title", "Amount page", None, box, "title", STAMP, STAMP),
            ("r3", "f1", "other", None, None, 3, "ref-3", "title", "Amount hidden", None, box, "title", STAMP, STAMP),
        ],
        f"region_id string, file_hash string, annotation_engine string, chunk_id string, chunk_index int, page_no int, source_ref string, label string, text string, context_text string, raw_bbox {box_type}, region_kind string, created_at timestamp, updated_at timestamp",
    )
    return {
        "files": spark.createDataFrame([("f1", "amounts.pdf", ".pdf", STAMP)], ["file_hash", "filename", "extension", "last_seen_at"]),
        "file_locations": spark.createDataFrame([("f1", "/in/amounts.pdf")], ["file_hash", "path"]),
        "document_chunks": spark.createDataFrame(
            [("c1", "f1", 0, "Total Amount Due: USD 12.50", STAMP), ("c2", "f2", 0, "Nothing of interest", STAMP)],
            ["chunk_id", "file_hash", "chunk_index", "text", "created_at"],
        ),
        "document_regions": regions,
        "document_page_markdown": spark.createDataFrame(
            [("f1", 2, "markitdown", "p", "m", "# The amount", STAMP), ("f1", 2, "unknown", "p", "m", "amount", STAMP)],
            ["file_hash", "page_no", "markdown_engine", "markdown_provider", "markdown_model", "markdown_text", "updated_at"],
        ),
        "document_terms": terms.build_terms(regions),
    }


def test_terms_of_a_region(spark):
    rows = terms.build_terms(small_tables(spark)["document_regions"]).filter("region_id = 'r1'").orderBy("char_start").collect()
    assert [r["text"] for r in rows] == ["Total", "Amount", "Due", "USD", "12.50"]
    assert [r["normalized_text"] for r in rows] == ["total", "amount", "due", "usd", "12.50"]
    assert (rows[0]["char_start"], rows[0]["char_end"], rows[0]["page_no"], rows[0]["chunk_id"]) == (0, 5, 2, "c1")


def test_global_search_ranks_and_navigates(spark):
    queries = spark.createDataFrame([(1, " AMOUNT "), (2, ""), (3, "interest")], ["query_id", "text"])
    rows = search.search_global(queries, small_tables(spark), 10).orderBy("query_id", "position").collect()
    first = [r for r in rows if r["query_id"] == 1]
    assert {r["query_id"] for r in rows} == {1, 3}
    assert {r["result_id"] for r in first} == {"file:f1", "chunk:c1", "region:r1", "region:r2", "markdown:f1:2:markitdown"}
    chunk = next(r for r in first if r["result_id"] == "chunk:c1")
    assert chunk["navigation_granularity"] == "word" and chunk["region_id"] == "r1" and chunk["page_no"] == 2
    assert (chunk["char_start"], chunk["char_end"]) == (6, 12)
    assert chunk["route"]["overlay"] == "region:r1" and chunk["route"]["highlight"] == "amount"
    assert [h["source"] for h in chunk["highlights"]] == ["fts_term"]
    file_hit = next(r for r in first if r["result_id"] == "file:f1")
    assert file_hit["score"] == 102.0 and file_hit["snippet"] == "/in/amounts.pdf"
    other = next(r for r in rows if r["query_id"] == 3 and r["source_type"] == "document_chunk")
    assert other["navigation_granularity"] == "chunk" and other["label"] == "f2"
    assert [r["score"] for r in first] == sorted((r["score"] for r in first), reverse=True)


def test_merge_drops_repeats_and_keeps_collector_order(spark):
    rows = [
        (1, "document_chunk", "c1", "full_text", 1, 101.0, "a"),
        (1, "document_chunk", "c1", "document_chunks_scan", 1, 82.0, "a"),
        (1, "file", "f", "files_scan", 1, 102.0, "b"),
        (1, "document_region", "r", "document_regions_scan", 1, 98.0, "c"),
    ]
    df = spark.createDataFrame(rows, ["query_id", "source_type", "source_id", "rank_source", "leg_rank", "score", "label"])
    got = search.merge_hits(df, 2).orderBy("position").collect()
    assert [(r["source_id"], r["score"]) for r in got] == [("f", 102.0), ("c1", 101.0)]
    assert [r["source_id"] for r in search.merge_hits(df, 1).collect()] == ["f"]


def test_scores_are_added_up_where_the_text_is(spark):
    """No row of a query and document is shuffled; only texts are dealt out."""
    docs = spark.createDataFrame([("a", "one two two"), ("b", "two three"), ("c", None), ("d", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "one two"), ("r", "three")], "query_id string, query string")
    scores = search.bm25_scores(docs, asked)
    assert "hashpartitioning(query_id" not in scores._jdf.queryExecution().executedPlan().toString()
    assert sorted((row["query_id"], row["chunk_id"]) for row in scores.collect()) == [("q", "a"), ("q", "b"), ("r", "b")]


def test_candidates_are_checked_where_the_text_is(spark):
    """Rows of a query and a text are not shuffled, whatever their number."""
    texts = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha gamma"), (3, None)], "key long, text string")
    asked = spark.createDataFrame([("q", "alpha"), ("r", "b_ta g"), ("s", "a")], "query_id string, query string")
    found = search.match_queries(texts, asked, "key", "text")
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("q", 1), ("q", 2), ("r", 1), ("s", 1), ("s", 2)]
