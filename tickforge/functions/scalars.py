"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LABELS, RELATIVE_TOLERANCE


def approx_equal(a: Column, b: Column, tolerance: float = RELATIVE_TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def less(a: Column, b: Column) -> Column:
    """a < b where a comparison with NaN is false."""
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def labels(flags: Column) -> Column:
    """The labels of the surfaced bits of flags, in table order."""
    told = [F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(text)) for bit, text in LABELS]
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def describe(flags: Column) -> Column:
    return F.array_join(labels(flags), ", ")


def parse_rfc3339_ns(text: Column) -> Column:
    """Nanoseconds since the epoch of 'YYYY-MM-DDTHH:MM:SS[.fraction]Z', 0 for an empty text, null if malformed.

    Up to nine digits of the fraction count, further ones are dropped; what follows the Z is ignored.
    """
    pattern = r"^(\d{4}-\d{2}-\d{2}).(\d{2}:\d{2}:\d{2})(?:\.(\d*))?Z"
    second = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    fraction = F.rpad(F.substring(F.regexp_extract(text, pattern, 3), 1, 9), 9, "0")
    return F.when(text == "", F.lit(0).cast("long")).when(text.rlike(pattern), F.unix_seconds(second) * 1_000_000_000 + fraction.cast("long"))


def ns_to_text(ns: Column, style: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("long")), style)


def backoff_ceiling(base: Column, attempt: Column, cap: Column) -> Column:
    """base doubled attempt times, at most cap; from 32 attempts on always cap."""
    return F.when(attempt >= 32, cap).otherwise(F.least(cap.cast("double"), base * F.pow(F.lit(2.0), attempt)).cast("long"))


def first_char(text: Column) -> Column:
    return F.when(text != "", F.substring(text, 1, 1))


def wire_symbol(text: Column) -> Column:
    return F.substring(text, 1, 8)


def bit(condition: Column, value: int) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0))


def fixed(x: Column, places: int = 6) -> Column:
    """x to a number of decimals, halves up: the same in every engine, unlike round()."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / F.lit(scale)
