"""Array values to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keep: Sequence[Column | str], values: Column | str, name: str, position: str = "_at"
) -> DataFrame:
    """``keep``, the position and each value of an array.

    A plain explode makes the optimiser add a filter on the size of the
    array, which computes a costly array twice; the outer form does not.
    """
    array = F.col(values) if isinstance(values, str) else values
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(position).isNotNull())
    return rows.drop("_at") if position == "_at" else rows
