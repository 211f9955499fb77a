"""Corpus scan: files, their fingerprints and their paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import ids
from folioscope.sources import listing

# File types that readers and previews accept.
PREVIEW_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tif", ".tiff", ".gif")


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)/*$", 1)


def extension(filename: Column) -> Column:
    """Lower-cased suffix with its dot; NULL for none, and for dot files."""
    suffix = F.lower(F.regexp_extract(filename, r"[^.](\.[^./]+)$", 1))
    return F.when(suffix != "", suffix)


def is_supported(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin(*PREVIEW_EXTENSIONS), F.lit(False))


def scan_directory(spark: SparkSession, directory: str, *, supported_only: bool = False) -> DataFrame:
    """One row per file below a directory, whatever its name; links are left out.

    Folders are listed and files hashed by tasks: a job for each level of
    folders, then one that reads every file in blocks.
    """
    found = listing.list_files(spark, directory)
    name = base_name(F.col("path"))
    described = found.select(
        "path", name.alias("filename"), extension(name).alias("extension"), F.col("length").alias("size_bytes"), F.timestamp_micros("modified_us").alias("modified_at")
    )
    kept = described.filter(is_supported(F.col("extension"))) if supported_only else described
    return listing.with_hash(kept, "path", "file_hash")


def describe_files(binary: DataFrame) -> DataFrame:
    """Works on a batch or a streaming ``binaryFile`` frame."""
    name = base_name(F.col("path"))
    return binary.select(
        ids.content_hash(F.col("content")).alias("file_hash"),
        F.col("path"),
        name.alias("filename"),
        extension(name).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def from_text_table(documents: DataFrame, text: str, path: Column, modified_at: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Files whose text is already in a table; the text is the content.  ``keep`` names more columns to keep."""
    name = base_name(path)
    return documents.select(
        ids.content_hash(F.col(text)).alias("file_hash"),
        path.alias("path"),
        name.alias("filename"),
        extension(name).alias("extension"),
        F.octet_length(F.col(text)).cast("long").alias("size_bytes"),
        modified_at.alias("modified_at"),
        F.col(text).alias("text"),
        *keep,
    )


def seen_files(sightings: DataFrame, seen_at: str) -> DataFrame:
    """One row per content: first and last sighting, attributes of the last one."""
    latest = F.struct(F.col(seen_at), F.col("path"))
    newest = lambda name: F.max_by(name, latest).alias(name)
    return sightings.groupBy("file_hash").agg(
        newest("filename"),
        newest("extension"),
        newest("size_bytes"),
        newest("modified_at"),
        F.min(seen_at).alias("first_seen_at"),
        F.max(seen_at).alias("last_seen_at"),
    )


def file_locations(sightings: DataFrame, seen_at: str) -> DataFrame:
    return sightings.groupBy("file_hash", "path").agg(
        F.min(seen_at).alias("first_seen_at"), F.max(seen_at).alias("last_seen_at")
    )


def newest_path(locations: DataFrame) -> DataFrame:
    return locations.groupBy("file_hash").agg(F.max_by("path", F.struct("last_seen_at", "path")).alias("path"))


def duplicate_files(locations: DataFrame) -> DataFrame:
    """Contents found under more than one path."""
    counted = locations.groupBy("file_hash").agg(F.count("*").alias("path_count"), F.min("path").alias("first_path"))
    return counted.filter(F.col("path_count") > 1)
