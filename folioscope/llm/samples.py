"""Bounded samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import learns_from


def labelled_sample(labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most ``rows`` rows that may be learned from, as a hash of the id orders them.

    Rows without id or label are left out; of rows that label one id, the
    smallest label counts.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learns_from(F.col(id_col)))
    once = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    return once.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)


def sampled_texts(docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, body) of the sampled documents; the sample is bounded, so it may be broadcast."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    return own.join(F.broadcast(sample), "doc_id")


def few_per_key(docs: DataFrame, key: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, body) of at most ``rows`` documents of each value of ``key`` that may be learned from."""
    usable = docs.filter(F.col(key).isNotNull() & F.col(text_col).isNotNull() & learns_from(F.col(id_col)))
    order = Window.partitionBy(key).orderBy(F.xxhash64(id_col, F.lit(7)), id_col)
    ids = usable.select(key, id_col).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows)
    chosen = ids.select(F.col(key).alias("label"), F.col(id_col).alias("doc_id")).distinct()
    own = usable.select(F.col(id_col).alias("doc_id"), F.col(key).alias("label"), F.col(text_col).cast("binary").alias("body"))
    return own.join(F.broadcast(chosen), ["doc_id", "label"])
