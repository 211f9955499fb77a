"""Queries do the whole job: nothing is left out before it could count."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from folioscope.operators import search
from folioscope.plans import corpus, roles


def write(folder, name, rows):
    pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{name}.parquet")


def test_global_search_ranks_old_hits(spark, tmp_path):
    """150 newer hits of each collector score less than the oldest one, which alone has the query as typed."""
    write(tmp_path, "benchmark", [{"item_id": 1, "text": "lpha bet"}])
    texts = ["alpha beta", *["ALPHA BETA"] * 150]
    write(tmp_path, "conversations", [{"conv_id": 1, "turn": i, "role": "user", "text": t} for i, t in enumerate(texts)])
    rows = contract.queries()["global_search"](spark, str(tmp_path)).orderBy("position").collect()
    assert len(rows) == 30
    assert rows[0]["source_type"] == "document_region" and rows[0]["page_no"] == 1 and rows[0]["score"] == 98.0


def test_reduced_global_search_equals_the_full_rank(spark, sf):
    """Lists made from the hits that can be in them are those made from all hits."""
    tables, asked = corpus.search_tables(spark, sf), roles.queries(spark, sf)
    shown = ["query_id", "position", "result_id", "score", "rank_source"]
    short = search.search_global(asked, tables, 5).select(shown)
    whole = search.search_global(asked, tables, 5, leg_limit=1_000_000).select(shown)
    assert sorted(short.collect()) == sorted(whole.collect())


def test_whole_texts_are_asked(spark, tmp_path):
    write(tmp_path, "benchmark", [{"item_id": 1, "text": "One two  three"}, {"item_id": 1_000_001, "text": "four five"}, {"item_id": 2, "text": None}])
    rows = search.prepare_queries(roles.queries(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, rows)) == [("1000001:whole", "four five"), ("1:short", "one two"), ("1:whole", "one two three")]


def test_texts_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """Whatever Spark takes for small, no text is shuffled to find first sightings or failed reads."""
    texts = ["a", "b", "a", None, "c", "b", "a", "", None]
    rows = [{"doc_id": n, "text": t, "lang": "en", "source": "web", "n_chars": 1} for n, t in enumerate(texts)]
    write(tmp_path, "documents", rows)
    write(tmp_path, "labels", [{"doc_id": n, "quality": n % 2, "toxic": 0} for n in range(4)])
    monkeypatch.setattr(roles, "stored", lambda spark, sf, name, make: make())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = roles.texts(spark, str(tmp_path))
        failed = corpus.reader_results(spark, str(tmp_path)).filter("status = 'error'")
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (made, failed)]
        assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
        assert {(r["text"], r["created_at"].timestamp() - roles.EPOCH) for r in made.filter("text IS NOT NULL").collect()} == {("a", 0), ("b", 1), ("c", 4), ("", 7)}
        assert made.count() == 5 and failed.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


WHOLE = ("full_text_scores", "block_top_ten", "wildcard_matches", "scan_collectors", "chunk_best_term", "phrase_highlights", "word_lookup", "table_elements", "table_row_text", "chunk_evidence", "document_summaries")


@pytest.mark.parametrize("name", WHOLE)
def test_query_over_whole_texts_equals_its_sql(spark, sf, name):
    from tools.check_queries import TABLES, compare

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    message, good = compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], sf)
    assert good, message


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without them still has the contract, and its tests can be collected."""
    root = Path(contract.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "*.json", "__pycache__"))
    check = "import __spark_entry__ as c; assert c.queries() and set(c.oracle_sql()) <= set(c.queries()); assert not [n for n in c.queries() if n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", check], cwd=copy, check=True, timeout=120)
    (copy / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", check], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, check=True, timeout=120, capture_output=True)
