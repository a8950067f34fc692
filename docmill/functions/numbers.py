"""Amounts, dates, hashes and boxes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# The large and small units of Korean numbers.
MYRIADS = (("조", 10**12), ("억", 10**8), ("만", 10**4))
UNITS = (("천", 1000), ("백", 100), ("십", 10))
# Formats in which dates and times are written.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy/MM/dd")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def _small(text: Column) -> Column:
    """A number under a myriad, as digits with units between them; a unit without a digit counts once."""
    total = F.coalesce(F.regexp_extract(text, "([0-9.]+)$", 1).try_cast("double"), F.lit(0.0))
    for unit, size in UNITS:
        digits = F.regexp_extract(text, f"([0-9.]*){unit}", 1)
        total = total + F.when(text.contains(unit), F.coalesce(digits.try_cast("double"), F.lit(1.0)) * size).otherwise(0.0)
    return total


def won(text: str | Column) -> Column:
    """bigint: the first amount of money of a text, as digits with commas or in Korean units; null without one."""
    number = F.regexp_extract(F.regexp_replace(_c(text), "[, ]", ""), "([0-9][0-9.천백십조억만]*)", 1)
    every = "".join(unit for unit, _ in MYRIADS)
    total = _small(F.regexp_extract(number, f"([^{every}]*)$", 1))
    for unit, size in MYRIADS:
        total = total + _small(F.regexp_extract(number, f"([^{every}]*){unit}", 1)) * size
    return F.when(number != "", F.round(total).cast("bigint"))


def plain_budget(text: str | Column) -> Column:
    """bigint: an amount written as digits with commas only, above 0; else null."""
    value = F.regexp_replace(_c(text), ",", "").try_cast("bigint")
    return F.when(value > 0, value)


def any_date(text: str | Column) -> Column:
    """date in any of the usual notations, or as 2026년 3월 5일; null for others and for days that don't exist."""
    text = F.trim(_c(text))
    written = F.regexp_replace(text, "^([0-9]{4})년 *([0-9]{1,2})월 *([0-9]{1,2})일$", "$1-$2-$3")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS), F.try_to_timestamp(written, F.lit("yyyy-M-d")).cast("date"))


def any_timestamp(text: str | Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(_c(text), F.lit(f)) for f in TIME_FORMATS))


def two_digit_year(year: Column, anchor: int) -> Column:
    """Full year of a two-digit one: at most five years beyond the anchor."""
    full = F.lit(anchor // 100 * 100) + year
    return F.when(full > anchor + 5, full - 100).otherwise(full)


def unit_hash(text: Column) -> Column:
    """[0, 1) from sha-256's first 8 hex digits; the same for a text on any run and engine."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def json_hash(*columns: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def clamp(x: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds; null and NaN become `low`."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(_c(x).cast("double"), F.lit(low)), F.lit(low))))


def span_iou(a: Column, b: Column) -> Column:
    """Shared part of two closed integer spans [first, last], by the pages of both."""
    both = F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + 1)
    return both / ((a[1] - a[0] + 1) + (b[1] - b[0] + 1) - both)


def box_iou(a: Column, b: Column) -> Column:
    """Shared area of two boxes [x0, y0, x1, y1] by the area of both; 0 without any area."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    both = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def clamped_box(box: Column, width: Column | float, height: Column | float) -> Column:
    limits = [F.lit(x) if not isinstance(x, Column) else x for x in (width, height, width, height)]
    return F.array(*(F.round(F.greatest(F.lit(0.0), F.least(box[k], limits[k])), 2) for k in range(4)))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost at prices for a million tokens; null where a price is unknown."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
