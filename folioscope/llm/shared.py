"""Batches of documents that tasks can come back to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def batch_count(df: DataFrame, text: Column, batch_bytes: int = BATCH_BYTES) -> int:
    """So many batches that each holds about ``batch_bytes`` of text, and no fewer than shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_width(df), -(-int(total) // batch_bytes))


def in_batches(df: DataFrame, key: Column, text: Column, batches: int) -> DataFrame:
    """Adds ``batch``, a function of the key, so that a repeated task meets the same rows.

    Rows without key are dealt out by their text, as all of them in one batch
    would be a group without bound.
    """
    return df.withColumn("batch", F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text)), F.lit(batches)).cast("int"))


def learns_from(doc_id: Column) -> Column:
    """True for the rows that may be learned from; rows without id are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
