"""Word terms of regions and the lookup by word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import ids, kinds
from folioscope.functions.rows import explode_rows
from folioscope.functions.spans import term_spans


def build_terms(regions: DataFrame) -> DataFrame:
    """One row per word of every shown region; the box is that of the region."""
    shown = regions.filter(kinds.is_active_engine(F.col("annotation_engine")) & F.col("raw_bbox").isNotNull())
    spans = explode_rows(shown, ["*"], term_spans(F.col("text")), "_term")
    return spans.select(
        ids.term_id(F.col("region_id"), F.col("_term.char_start")).alias("document_term_id"),
        "file_hash",
        "page_no",
        "region_id",
        "chunk_id",
        kinds.engine_or_default(F.col("annotation_engine")).alias("annotation_engine"),
        F.col("_term.token").alias("text"),
        F.lower("_term.token").alias("normalized_text"),
        "raw_bbox",
        F.col("_term.char_start").alias("char_start"),
        F.col("_term.char_end").alias("char_end"),
        F.lit("region").alias("bbox_granularity"),
        "region_kind",
    )


def regions_with_word(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Regions in which a word occurs, with the number of occurrences."""
    wanted = words.select(F.lower("word").alias("normalized_text")).distinct()
    return (
        terms.join(wanted, "normalized_text")
        .groupBy("normalized_text", "file_hash", "page_no", "region_id")
        .agg(F.count("*").alias("hits"), F.min("char_start").alias("first_start"))
    )
