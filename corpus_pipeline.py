"""Corpus pipeline: language, near copies, repeated passages, benchmark passages, mix.

Each stage takes the documents its predecessor kept and gives a table with the
columns of ``documents`` (the last one adds how often each is taken).  Stages
are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import cube, lsh_forest, ppm, suffix_dedup, winnowing
from folioscope.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its language is not sure to this degree.
SURE = 0.5


def _marked(docs: DataFrame) -> DataFrame:
    """Two hashes of id and text name a row, so that narrow results find their way back to it."""
    return docs.withColumn("_a", F.xxhash64("doc_id", "text")).withColumn("_b", F.xxhash64("text", "doc_id", F.lit(23)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; it replaces ``lang`` where that is NULL.

    Texts that are NULL, hold no letter, or fit no language better than all
    others together are rejected.
    """
    found = ppm.identify(docs, ppm.train(docs), carry=COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    row = F.col("row")
    return found.select(
        row["doc_id"].alias("doc_id"), row["text"].alias("text"), F.coalesce(row["lang"], F.col("lang_pred")).alias("lang"), row["source"].alias("source"), row["n_chars"].alias("n_chars")
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, and documents without words.

    Sets of five-word shingles with a similarity of 0.8 or more are linked.
    """
    found = lsh_forest.near_duplicates(docs, shingle=5, part=80, of=100, depth=4)
    gone = found.filter("not kept and component_id is not null").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeats = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that an earlier document has; emptied documents go."""
    cleaned = suffix_dedup.remove_repeats(docs, carry=[c for c in COLUMNS if c != "text"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    kept = cleaned.select(F.col("row.doc_id").alias("doc_id"), text.alias("text"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).filter(F.trim("text") != "")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    marked = _marked(docs.select(*COLUMNS))
    found = winnowing.contamination(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["_a", "_b"])
    leaks = found.filter(F.size("hits") > 0).select("row._a", "row._b").distinct()
    return marked.join(leaks, ["_a", "_b"], "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often it takes them; equal rows are taken equally often."""
    marked = _marked(docs.select(*COLUMNS))
    mixed = cube.mix(marked, carry=["_a", "_b"]).groupBy("row._a", "row._b").agg(F.max("times").alias("times"))
    return marked.join(mixed.filter("times > 0"), ["_a", "_b"]).select(*COLUMNS, "times")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
]

#: Code lengths, a forest of signatures and balanced draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
