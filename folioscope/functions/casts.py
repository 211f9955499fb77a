"""Tolerant casts: bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.trim(value.cast("string"))


def to_float(value: Column) -> Column:
    return _text(value).try_cast("double")


def to_int(value: Column) -> Column:
    """Whole part of a number given as number or text."""
    number = _text(value).try_cast("double")
    return F.when(~F.isnan(number), number).try_cast("int")


def int_or_zero(value: Column) -> Column:
    return F.coalesce(to_int(value), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def json_object(value: Column) -> Column:
    """A JSON object as VARIANT; anything else becomes an empty object."""
    parsed = F.try_parse_json(value)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.coalesce(F.when(is_object, parsed), F.parse_json(F.lit("{}")))


def variant_text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def clamp_limit(limit: int, cap: int | None) -> int:
    """At least one row; at most ``cap`` rows when a cap is wanted."""
    low = max(1, int(limit))
    return low if cap is None else min(low, cap)
