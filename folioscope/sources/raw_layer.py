"""Raw reader output: the audit layer from which all else can be rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as txt
from folioscope.sources.keyed import upsert, write_slices

MAX_ERROR_CHARS = 4000
RAW_KEYS = ("file_hash", "annotation_engine")


def reader_rows(results: DataFrame) -> DataFrame:
    """Results and failures side by side; a failure has no text and no output."""
    failed = F.col("status") == "error"
    return results.select(
        "file_hash",
        "annotation_engine",
        "ingest_run_id",
        F.when(~failed, F.col("text")).alias("text"),
        F.when(~failed, F.col("output_json")).alias("output_json"),
        "status",
        F.when(failed, txt.truncate(F.col("error"), MAX_ERROR_CHARS)).alias("error"),
        "reader_provider",
        "reader_model",
    )


def store_reader_rows(base: DataFrame, results: DataFrame) -> DataFrame:
    return upsert(base, reader_rows(results), RAW_KEYS, [F.col("ingest_run_id")])


def write_raw_layer(rows: DataFrame, path: str) -> None:
    write_slices(rows, path, ["annotation_engine"])


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the corpus tables and of failed reads, one row each."""
    raw = tables["ocr_documents"].filter(F.col("status") == "error")
    named = [
        ("files", tables["files"]),
        ("chunks", tables["document_chunks"]),
        ("regions", tables["document_regions"]),
        ("terms", tables["document_terms"]),
        ("failed_docs", raw),
    ]
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in named]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
