"""Score columns: scales, rounding to halves, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_null


def number(c: Column) -> Column:
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double")


def to_10(value: Column, best: Column, worst: Column) -> Column:
    """A score between 0 and 10, one decimal: by its range if there is one, else as of 10 or of 100."""
    v, b = number(value), number(best)
    w = F.coalesce(number(worst), F.lit(0.0))
    score = F.when(b.isNotNull() & (b > w), (v - w) / (b - w) * 10).when(v.between(0, 10), v).when(v.between(0, 100), v / 10)
    return F.when(score.between(0, 10), F.bround(score, 1))


def as_100(c: Column) -> Column:
    v = number(c).cast("int")
    return F.when(v.between(0, 100), v)


def as_10(c: Column) -> Column:
    v = number(c)
    return F.when(v.between(0, 10), F.bround(v, 1))


def _bounded(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.least(F.greatest(v, F.lit(1.0)), F.lit(10.0)))


def floor_to_half(c: Column) -> Column:
    return F.floor((_bounded(c) + 1e-9) * 2) / 2


def round_to_half(c: Column) -> Column:
    """Halves to even, as of 1 to 10."""
    return F.bround(_bounded(c) * 2) / 2


def display(raw: Column, best: Column) -> Column:
    r, b = F.trim(F.coalesce(raw.cast("string"), F.lit(""))), F.trim(F.coalesce(best.cast("string"), F.lit("")))
    v = r.try_cast("double")
    return F.when(r == "", "").when((b != "") & ~b.isin("0", "0.0"), F.concat(r, F.lit("/"), b)).when(v.isNull(), r).when(v <= 10, F.concat(r, F.lit("/10"))).otherwise(F.concat(r, F.lit("/100")))


def number_text(c: Column) -> Column:
    """A number without a trailing .0."""
    return F.regexp_replace(F.format_string("%.1f", c.cast("double")), r"\.0$", "")


def quality_rank(points: Column, categorised: Column, categories: Column) -> Column:
    return points * 100 + categorised * 20 + categories * 25


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(or_null(c) for c in columns))
