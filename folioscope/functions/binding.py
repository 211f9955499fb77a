"""Compute a value once inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Without it an expression that is named several times, or inside the body
    of an array function, is evaluated again each time.
    """
    return F.element_at(F.transform(F.array(value), lambda item: use(item)), 1)
