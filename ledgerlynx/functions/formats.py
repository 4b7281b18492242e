"""Human-readable column formatters (null shows as ``N/A``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import ColumnLike, _col, rnd_exact

NOT_AVAILABLE = "N/A"


def fixed(c: ColumnLike, digits: int) -> Column:
    """Fixed number of decimals, without thousands separators."""
    return F.format_string(f"%.{digits}f", rnd_exact(c, digits))


def _or_na(c: Column, text: Column) -> Column:
    return F.when(c.isNull(), NOT_AVAILABLE).otherwise(text)


def market_cap(c: ColumnLike) -> Column:
    v = _col(c)
    return _or_na(
        v,
        F.when(v >= 1e9, F.concat(F.lit("$"), fixed(v / 1e9, 1), F.lit("B"))).otherwise(
            F.concat(F.lit("$"), fixed(v / 1e6, 0), F.lit("M"))
        ),
    )


def volume(c: ColumnLike) -> Column:
    v = _col(c)
    return _or_na(
        v,
        F.when(v >= 1e6, F.concat(fixed(v / 1e6, 1), F.lit("M")))
        .when(v >= 1e3, F.concat(fixed(v / 1e3, 0), F.lit("K")))
        .otherwise(v.cast("bigint").cast("string")),
    )


def percent(c: ColumnLike, digits: int = 1) -> Column:
    v = _col(c)
    return _or_na(v, F.concat(fixed(v * 100, digits), F.lit("%")))


def multiple(c: ColumnLike, digits: int = 1) -> Column:
    v = _col(c)
    return _or_na(v, F.concat(fixed(v, digits), F.lit("x")))


def ratio(c: ColumnLike, digits: int = 2) -> Column:
    v = _col(c)
    return _or_na(v, fixed(v, digits))


def dollars(c: ColumnLike) -> Column:
    """Signed amount in billions, millions or thousands by magnitude."""
    v = _col(c)
    size = F.abs(v)
    return _or_na(
        v,
        F.when(size >= 1e9, F.concat(F.lit("$"), fixed(v / 1e9, 1), F.lit("B")))
        .when(size >= 1e6, F.concat(F.lit("$"), fixed(v / 1e6, 0), F.lit("M")))
        .otherwise(F.concat(F.lit("$"), fixed(v / 1e3, 0), F.lit("K"))),
    )
