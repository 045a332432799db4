"""Locale-aware parsing and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number after the locale rewrite, and as a date with no time.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))$"
ISO_DATE = r"^\d{4}([-/ \\])\d{1,2}\1\d{1,2}([T ]\d{1,2}:.*)?$"
TIME_PATTERNS = {
    "d/M/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d/M/yyyy H:m": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "M/yyyy": r"^\d{1,2}/\d{4}$",
    "yyyy-M": r"^\d{4}-\d{1,2}$",
    "yyyyMM": r"^\d{6}$",
}
SENTINEL_DATES = ("1900-01-01", "1899-12-30")


def text_of(c: Column) -> Column:
    return F.trim(c.cast("string"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(text_of(c), F.lit(""))


def _guarded_double(text: Column) -> Column:
    # Spark's cast alone would accept suffixes such as 1.0f and 1.5d
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_generic(c: Column) -> Column:
    """``1.234,56``, ``1234,56`` and ``1234.56`` are all read; dots are dropped only beside a comma."""
    t = text_of(c)
    dotted = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _guarded_double(F.when(F.contains(t, F.lit(",")), dotted).otherwise(t))


def number_convention(c: Column) -> Column:
    """Only the comma is rewritten, so ``1.234,56`` is not a number."""
    return _guarded_double(F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("."))))


def number_tariff(c: Column) -> Column:
    """Dots are always thousands separators."""
    t = F.replace(F.replace(c.cast("string"), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _guarded_double(F.trim(t))


def timestamp_iso(t: Column) -> Column:
    """Year first, with ``-``, ``/``, blank or backslash between; an hour without minutes is no time."""
    dashed = F.regexp_replace(t, r"^(\d{4})[/ \\](\d{1,2})[/ \\](\d{1,2})", "$1-$2-$3")
    return F.when(t.rlike(ISO_DATE), dashed.try_cast("timestamp_ntz"))


def timestamp_multi(c: Column) -> Column:
    """The format whose shape fits; day first. Bare years and times of day are not dates."""
    t = text_of(c)
    out = F.when(t.rlike(ISO_DATE), timestamp_iso(t))
    # a pattern is only tried on text of its shape: a failed try costs an exception per row
    for pattern, shape in TIME_PATTERNS.items():
        out = out.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(pattern)).cast("timestamp_ntz"))
    return F.when(t.rlike("^[0-9]"), out)


def drop_sentinel_dates(c: Column) -> Column:
    return F.when(~F.to_date(c).isin(*[F.to_date(F.lit(d)) for d in SENTINEL_DATES]), c)


def packed_date(c: Column) -> Column:
    """``20241001`` to a date."""
    return F.to_date(F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")))


def failed(c: Column, parsed: Column) -> Column:
    """True where a non-blank value did not convert."""
    return c.isNotNull() & (text_of(c) != "") & parsed.isNull()


def day_only(c: Column) -> Column:
    """True where a timestamp has no time of day."""
    return c == F.date_trunc("day", c).cast("timestamp_ntz")


def format_comma(c: Column, digits: int) -> Column:
    """``1234.5`` as ``1.234,5``."""
    return F.translate(F.format_number(c, digits), ",.", ".,")
