"""Keyed writes on plain tables: upsert, sticky status, slice replace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.grouping import first_per_group
from folioscope.session import scratch_path

TERMINAL_STATUSES = ("ok", "error", "skipped")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Last write wins: delta rows replace base rows of the same key.

    ``order`` decides between several delta rows of one key (later is better).
    """
    marked = base.withColumn("_late", F.lit(0)).unionByName(delta.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    newest = [F.col("_late").desc(), *[column.desc() for column in order]]
    return first_per_group(marked, keys, newest).drop("_late")


def upsert_keep_terminal(base: DataFrame, delta: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Upsert in which a unit that has ended keeps its status when planned again."""
    merged = upsert(base, delta, keys)
    ended = base.filter(F.col(status).isin(*TERMINAL_STATUSES)).select(*keys, F.col(status).alias("_ended"))
    joined = merged.join(ended, list(keys), "left")
    return joined.withColumn(status, F.coalesce("_ended", status)).drop("_ended")


def replace_slice(base: DataFrame, fresh: DataFrame, slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every base row of the given slices, then add the fresh rows.

    ``slices`` names the slices that were rebuilt, also those left empty.
    """
    kept = base.join(slices.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def write_slices(fresh: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions that the new rows touch."""
    (
        fresh.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared scratch folder and read back, to cut lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
