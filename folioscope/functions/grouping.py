"""Grouped helpers that never gather a whole group in one task.

A single key may hold a third of all rows.  ``row_number() <= k`` is pruned
map-side by Spark (WindowGroupLimit), so picking a few rows per key is safe.
Running numbers and sums are done per block and shifted by block totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def null_safe_on(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def _with_block_offset(df: DataFrame, keys: Sequence[str], block: Column, amount: Column) -> DataFrame:
    """Adds ``_block`` and ``_before``: the total of all earlier blocks of the key."""
    blocked = df.withColumn("_block", block)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    return (
        blocked.alias("b")
        .join(offsets.alias("o"), null_safe_on("b", "o", [*keys, "_block"]), "left")
        .select("b.*", "o._before")
    )


def blocked_row_number(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """1-based number within ``keys``; ``block`` must never decrease along ``order``."""
    shifted = _with_block_offset(df, keys, block, F.lit(1))
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    numbered = shifted.withColumn(name, (F.row_number().over(within) + F.col("_before")).cast("long"))
    return numbered.drop("_block", "_before")


def blocked_running_sum(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], amount: Column, name: str
) -> DataFrame:
    """Running total including the row itself; same rule for ``block``."""
    shifted = _with_block_offset(df, keys, block, amount)
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = shifted.withColumn(name, F.sum(amount).over(within) + F.col("_before"))
    return summed.drop("_block", "_before")


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, block_width: float, name: str) -> DataFrame:
    """Exact median of ``value`` per key.

    Equal values are counted first, then ranked block by block, so a large
    group is spread over its blocks instead of one sort.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = blocked_running_sum(
        counted, keys, F.floor(F.col(value) / F.lit(block_width)), [F.col(value)], F.col("_n"), "_upto"
    )
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    joined = ranked.alias("r").join(sizes.alias("s"), null_safe_on("r", "s", keys)).select("r.*", "s._size")
    low = F.floor((F.col("_size") + 1) / 2)
    high = F.floor((F.col("_size") + 2) / 2)
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    picked = F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))
    return joined.groupBy(*keys).agg((picked / 2).alias(name))


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str, name: str, block: int = 512
) -> DataFrame:
    """Join texts of a key in order: first inside blocks of positions, then the blocks."""

    def joined(order_col: str, text_col: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
        whole = F.concat_ws(separator, F.transform(rows, lambda row: row["t"]))
        return F.when(F.count(text_col) > 0, whole)

    blocks = df.groupBy(*keys, F.floor(F.col(order) / block).alias("_block")).agg(joined(order, text).alias("_part"))
    return blocks.groupBy(*keys).agg(joined("_block", "_part").alias(name))


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], salt_from: Sequence[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join whose hot keys on the big side are split over ``salts`` partitions, a quarter of all by default.

    The salt is a hash of row columns, so a recomputed task gives the same
    rows.  It must not depend on the keys alone, which would split nothing.
    """
    if set(salt_from) <= set(on):
        raise ValueError(f"a salt from {list(salt_from)} does not split the keys {list(on)}")
    if salts is None:
        salts = max(4, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    right = small.withColumn("_salt", copies)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


BROADCAST_BYTES = 8 << 20


def _is_small(df: DataFrame, max_bytes: int) -> bool:
    """Whether the rows, written as JSON, take no more than ``max_bytes``."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast behind a check of the size; a larger side is joined by shuffle.

    The side is computed once: its lineage is cut before it is measured.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if _is_small(kept, max_bytes) else kept


def lookup_join(big: DataFrame, side: DataFrame, on: Sequence[str], salt_from: Sequence[str] | None = None) -> DataFrame:
    """Inner join with a side that is mostly small: broadcast, else by shuffle.

    ``side`` should be cut off from its lineage, as it is measured first.
    ``salt_from`` names columns that split hot keys of the big side; without it
    the keys of the big side are unique.
    """
    if _is_small(side, BROADCAST_BYTES):
        return big.join(F.broadcast(side), list(on))
    return big.join(side, list(on)) if salt_from is None else salted_join(big, side, on, salt_from)
