"""Numeric expressions with the missing-value and rounding rules used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(column: Column, is_float: bool = False) -> Column:
    """True for NULL, and for NaN in floating-point columns."""
    return column.isNull() | F.isnan(column) if is_float else column.isNull()


def nan_to_null(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero or NULL divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def log1p_clipped(column: Column) -> Column:
    return F.log1p(F.greatest(column.cast("double"), F.lit(0.0)))


def to_number(column: Column) -> Column:
    """Text to double; anything unreadable becomes NULL."""
    return column.try_cast("double")


def percent(top: Column, bottom: Column, digits: int = 1) -> Column:
    """``100 * top / bottom`` rounded half to even."""
    return F.bround(100.0 * ratio(top, bottom), digits)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays; a zero vector has similarity 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return ratio_or_zero(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def token_total(prompt: Column, completion: Column, total: Column) -> Column:
    """Prompt plus completion when either is known, else the provider's own total."""
    known = prompt.isNotNull() | completion.isNotNull()
    return F.when(known, F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))).otherwise(total)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end``; the part below a millisecond is cut."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (micros / 1000).cast("long")
