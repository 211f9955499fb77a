"""Plans that keep rows where their file is, and helpers that do less for each row."""

import datetime as dt
import io
import json
from contextlib import redirect_stdout

import pandas as pd
from pyspark.sql import functions as F

from __spark_entry__ import queries
from folioscope.functions import ids
from folioscope.functions import text as txt
from folioscope.operators import gram_index, search
from folioscope.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with redirect_stdout(io.StringIO()) as shown:
            queries()[name](spark, SF).explain()
        return shown.getvalue()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_regions_sort_no_element_for_a_lookup_and_carry_no_text(spark):
    """Items and pages are hashed; what the query does not show is not carried through the full join."""
    shown = plan(spark, "layout_regions")
    assert shown.count("ShuffledHashJoin") >= 3
    assert "first(context_text" not in shown and "context_text, context_text" not in shown


def test_thousandths_round_as_before(spark):
    numbers = [0.0, 0.0005, -0.0005, 0.0015, 2.0005, 1.0049999, 0.49999999999999994, -1.2345, 12.5, 1e9 + 0.0005, -7e11, None]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    found = rows.select(ids.thousandths(F.col("x")).alias("new"), F.round(F.col("x") * 1000).cast("long").alias("old")).collect()
    assert all(r["new"] == r["old"] for r in found)


ODD = ["Alpha beta", "  alpha\tbeta gamma ", "alphabet a_b 100%", "", "x", "beta\x1falpha beta", "été à la carte", "a\nb", "100 percent", "gamma alpha", "\U0001F600 smile alpha", None]
ASKED = ["alpha beta", "alpha", "beta gamma", "a_b", "1%t", "alph_ b", "et", "%", "___", "a b", "beta alpha", "à la", "percent 100", "\U0001F600"]


def test_few_and_many_anchors_find_the_same(spark, monkeypatch):
    """Texts gone through for few anchors and words looked up for many give what a check of every pair gives."""
    texts = spark.createDataFrame(list(enumerate(ODD)), "k int, body string")
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(ASKED)], "query_id string, query string")
    pattern = F.concat(F.lit("%"), F.col("query"), F.lit("%"))
    pairs = texts.crossJoin(asked).filter(txt.like_literal(F.lower("body"), pattern))
    want = {(r["query_id"], r["k"]) for r in pairs.collect()}
    found = {}
    for few in (512, 0):
        monkeypatch.setattr(search, "FEW_ANCHORS", few)
        rows = [tuple(r) for r in search.match_queries(texts, asked, "k", "body").collect()]
        assert len(rows) == len(set(rows))
        found[few] = set(rows)
    assert found[512] == found[0] and found[0] <= want
    blanks = lambda pair: " " in ASKED[int(pair[0][1:])]
    assert {p for p in want if not blanks(p)} == {p for p in found[0] if not blanks(p)}


def test_groups_keep_characters_whole(spark):
    row = spark.createDataFrame([("a\U0001F600\nb", "")], "t string, e string").select(gram_index.groups_of(F.col("t")).alias("t"), gram_index.groups_of(F.col("e")).alias("e")).first()
    assert row["t"] == ["a\U0001F600\n", "\U0001F600\nb", "\nb", "b"] and row["e"] == []


def test_units_of_a_group_are_told_by_one_call():
    """A group's state holds its units at work; those whose time is up are dropped, also where a batch brings news of others."""

    class State:
        def __init__(self, kept=None, mark=0, over=False):
            self.get, self.exists, self.mark, self.hasTimedOut = kept, kept is not None, mark, over

        def update(self, value):
            self.get = value

        def setTimeoutTimestamp(self, at):
            self.at = at

        def remove(self):
            self.get = None

        def getCurrentWatermarkMs(self):
            return self.mark

    at = lambda hour: pd.Timestamp(2024, 1, 1, hour)
    frame = lambda rows: pd.DataFrame(rows, columns=["ingest_run_id", "work_key", "ts", "seq", "status"])
    update = jobs._group_updater(dt.timedelta(hours=12), dt.timedelta(hours=1))
    state = State()
    rows = [("1", "b", at(3), 5, "ok"), (None, "a", at(2), 3, "running"), ("1", "b", at(1), 1, "running"), ("9007199254740993", None, at(1), 2, "error")]
    shown = pd.concat(update((0,), iter([frame(rows[:2]), frame(rows[2:])]), state))
    told = {(None if pd.isna(r[0]) else int(r[0]), r[1]): (r[3], r[4]) for r in shown.itertuples(index=False)}
    assert told == {(None, "a"): ("running", 1), (1, "b"): ("ok", 1), (9007199254740993, None): ("error", 0)} and len(shown) == 3
    later = State(state.get, mark=int(at(5).timestamp() * 1000))
    again = pd.concat(update((0,), iter([frame([("1", "b", at(6), 6, "running")])]), later))
    assert again["opened_at"].tolist() == [at(3) - dt.timedelta(hours=2), at(6)] and again["attempt_count"].tolist() == [1, 1]
    assert sorted(x[1] for x in json.loads(later.get[0])) == ["a", "b"]
    over = State(later.get, mark=int(at(23).timestamp() * 1000), over=True)
    assert list(update((0,), iter([]), over)) == [] and over.get is None


def test_preview_stops_early_and_gives_the_same(spark):
    texts = ["a " * 4000, " \n" * 3000 + "late word", "x" * 259, "x" * 261 + " y", "w  \t" * 900, "", "é\x1f" * 700, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.substring(txt.collapse_spaces(F.col("t")), 1, txt.PREVIEW_CHARS)
    assert all(r["new"] == r["old"] for r in rows.select(txt.preview(F.col("t")).alias("new"), whole.alias("old")).collect())


def test_fallback_joins_no_preview_by_chunk(spark):
    """What is left is the step of the older provider."""
    assert plan(spark, "chunk_evidence_fallback").count("hashpartitioning(chunk_id") <= 2
