"""Text expressions, chunk windows, budget splits and packing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import casts, kinds
from folioscope.functions import text as txt
from folioscope.operators import chunks as ck


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def windows_by_hand(text, size, overlap):
    body = "\n".join(line.rstrip() for line in text.splitlines()).strip()
    found, at = [], 0
    while at < len(body):
        piece = body[at : at + size]
        found.append(piece.strip())
        if at + size >= len(body):
            break
        at += size - overlap
    return [p for p in found if p]


def tokens_by_hand(text):
    return max(1, math.ceil(len(text) / 4), math.ceil(len(text.split()) * 1.35)) if text else 0


def test_chunk_windows_known_values(spark):
    rows = spark.createDataFrame([("abcdefghij",)], ["t"]).select(txt.chunk_windows(F.col("t"), 6, 2).alias("x"))
    assert rows.first()["x"] == ["abcdef", "efghij"]
    with pytest.raises(ValueError):
        txt.chunk_windows(F.col("t"), 3, 3)


def test_chunk_windows_equal_plain_loop(spark):
    rng = random.Random(5)
    alphabet = "ab c\n\t   é\x1c\r"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "   ", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), ["i", "t"])
    for size, overlap in ((7, 3), (10, 0), (5, 4)):
        got = {r["i"]: r["x"] for r in df.select("i", txt.chunk_windows(F.col("t"), size, overlap).alias("x")).collect()}
        assert all(got[i] == windows_by_hand(t, size, overlap) for i, t in enumerate(texts))


def test_token_estimate(spark):
    texts = ["", "a", "abcd efgh", "w " * 180, "x" * 41, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), ["i", "t"]).select("i", txt.estimate_tokens(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in df.collect()} == {i: tokens_by_hand(t) for i, t in enumerate(texts)}


def test_clean_query_and_tokens(spark):
    assert one(spark, txt.clean_query(F.col("q")), q="  Total Amount \n DUE ") == "total amount due"
    assert one(spark, txt.query_tokens(F.col("q")), q="Größe 12.50 a-b!") == ["größe", "12.50", "a-b"]
    assert one(spark, txt.evidence_tokens(F.col("q")), q="$12.50 _A/B_ é") == ["$", "12.50", "a/b"]


def test_usable_and_truncated(spark):
    for text, good in (("Not  Available", False), ("short", False), ("long enough", True), (None, False)):
        df = spark.createDataFrame([(text,)], "t string").select(txt.is_usable_text(F.col("t")).alias("x"))
        assert df.first()["x"] is good
    assert one(spark, txt.truncate(F.col("t"), 3), t="abcdef") == "abc... [truncated]"


def test_backslash_is_no_escape(spark):
    df = spark.createDataFrame([("a\\b", "%\\b%"), ("a%b", "%\\%b%")], ["t", "p"])
    assert [r["x"] for r in df.select(txt.like_literal(F.col("t"), F.col("p")).alias("x")).collect()] == [True, False]


def test_casts(spark):
    values = ["7", " -1 ", "3.9", "x", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [(r["i"], r["f"]) for r in df.select(casts.to_int(F.col("v")).alias("i"), casts.to_float(F.col("v")).alias("f")).collect()]
    assert got == [(7, 7.0), (-1, -1.0), (3, 3.9), (None, None), (None, None), (None, None)]


def test_region_kinds_follow_rule_order(spark):
    label = F.lit("table_footnote")
    got = spark.range(1).select(kinds.content_kind(label).alias("c"), kinds.category_kind(label).alias("p"), kinds.layout_kind(F.lit("Equation")).alias("l"), kinds.category_kind(F.lit("sidebar")).alias("o")).first()
    assert tuple(got) == ("table", "footnote", "formula", "other")
    assert one(spark, kinds.span_step(F.lit("ingest.read-page.one"), "ingest.")) == "read_page_one"


def split_by_hand(text, budget):
    """Grows every part as a string, to check the counting version."""
    if tokens_by_hand(text) <= budget:
        return [text]
    parts, current = [], ""
    for line in text.splitlines():
        grown = (current + "\n" + line).strip() if current else line.strip()
        if not grown:
            continue
        if tokens_by_hand(grown) <= budget:
            current = grown
            continue
        parts += [current] if current else []
        current = ""
        if tokens_by_hand(line) <= budget:
            current = line.strip()
            continue
        held = []
        for word in line.split():
            if held and tokens_by_hand(" ".join([*held, word])) > budget:
                parts.append(" ".join(held))
                held = []
            held.append(word)
        parts += [" ".join(held)] if held else []
    parts += [current] if current else []
    return [p for p in parts if p.strip()]


def test_budget_split_equals_plain_growth(spark):
    rng = random.Random(7)
    def line():
        return " " * rng.randint(0, 2) + " ".join("x" * rng.randint(1, 30) for _ in range(rng.randint(0, 12))) + " " * rng.randint(0, 2)
    texts = ["\n".join(line() for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), ["i", "t"]).select("i", ck.budget_parts(F.col("t"), 20).alias("p"))
    got = {r["i"]: r["p"] for r in df.collect()}
    assert all(got[i] == split_by_hand(t, 20) for i, t in enumerate(texts))


def test_packing_keeps_all_text_within_budget(spark):
    rng = random.Random(3)
    rows = [(f"f{f}", i, f"#/texts/{i}", " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 30)))) for f in range(3) for i in range(700)]
    elements = spark.createDataFrame(rows, ["file_hash", "ordinal", "source_ref", "text"])
    packed = ck.pack_elements(elements, 60, block=16)
    running = {}
    for r in sorted(packed.collect(), key=lambda r: (r["file_hash"], r["ordinal"])):
        before = running.get(r["file_hash"], 0)
        assert r["pack_no"] == before // 60
        running[r["file_hash"]] = before + r["tokens"]
    made = ck.packed_chunks(elements, 60).collect()
    assert all(r["tokens"] <= 60 for r in made)
    for f in range(3):
        mine = sorted((r for r in made if r["file_hash"] == f"f{f}"), key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in mine] == list(range(len(mine)))
        assert " ".join(r["text"] for r in mine).split() == " ".join(t for h, _i, _s, t in rows if h == f"f{f}").split()


def test_unknown_chunker_is_refused(spark):
    with pytest.raises(ValueError):
        ck.build_chunks("none", spark.range(1))
