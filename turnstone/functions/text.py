"""Scalar functions on columns (survey 2.11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character beyond the basic plane counts as two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "-")


def decode_slug(text: Column) -> Column:
    """The directory that a slug stands for, as far as one can tell."""
    return F.translate(text, "-", "/")


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def words_of_camel(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "([A-Z])", " $1"))


def round_half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + 0.5)


def shorten_path(path: Column, home: str, most: int = 40) -> Column:
    """The home directory as ~; a path still longer than `most` keeps its first part and its last two."""
    at_home = F.when((path == home) | path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)
    parts = F.split(at_home, "/")
    middle = F.concat_ws("/", F.element_at(parts, 1), F.lit("…"), F.slice(parts, -2, 2))
    return F.when((F.length(at_home) > most) & (F.size(parts) > 3), middle).otherwise(at_home)


def compact_number(x: Column) -> Column:
    """1234 as 1.2k, 1234567 as 1.2M."""
    return F.when(F.abs(x) >= 1_000_000, F.format_string("%.1fM", x / 1e6)).when(F.abs(x) >= 1000, F.format_string("%.1fk", x / 1e3)).otherwise(F.format_string("%.0f", x.cast("double")))


def day(ts: Column) -> Column:
    """The UTC day; the session's time zone is UTC throughout."""
    return F.to_date(ts)
