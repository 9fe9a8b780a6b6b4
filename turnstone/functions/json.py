"""Strict access to VARIANT values: a field counts only if it has the type that is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """Name of the type, as in OBJECT<...>, ARRAY<...>, STRING, BIGINT; null where there is nothing."""
    return F.schema_of_variant(at(v, path))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("ARRAY"), F.lit(False))


def text(v: Column, path: str) -> Column:
    """A string; a number or anything else is none."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def filled(v: Column, path: str) -> Column:
    """A string that isn't empty."""
    return F.when(F.length(text(v, path)) > 0, text(v, path))


def real(v: Column, path: str) -> Column:
    """A finite number; a numeric string is none."""
    number = F.when(kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))
    return F.when(F.abs(number) < float("inf"), number)  # NaN is above it


def number(v: Column, path: str) -> Column:
    """A whole count, 0 where there is none."""
    return F.coalesce(real(v, path), F.lit(0.0)).cast("long")


def flag(v: Column, path: str) -> Column:
    """True only for true itself."""
    return F.coalesce(F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def items(v: Column, path: str) -> Column:
    """An array of variants, in order; null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def dumped(v: Column) -> Column:
    """Compact JSON. Keys are sorted, and numbers that aren't whole may be spelt differently than in the source."""
    return F.to_json(v)


def instant(v: Column, path: str) -> Column:
    """An ISO time, null for junk."""
    return F.try_to_timestamp(text(v, path))
