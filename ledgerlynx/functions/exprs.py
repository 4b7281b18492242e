"""Small column-expression helpers shared by every operator.

Zero and null are often the same thing in this domain ("no value reported").
``nz`` and ``z`` spell the two directions of that rule, so each operator says
explicitly which one it applies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

#: Bits reserved for the position part of :func:`date_rank_key`.
_POSITION_BITS = 41
_NO_DATE = -(1 << 22)


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: ColumnLike) -> Column:
    """Zero counts as missing: ``0 -> null``."""
    return F.nullif(_col(c), F.lit(0))


def z(c: ColumnLike) -> Column:
    """Missing counts as zero: ``null -> 0.0``."""
    return F.coalesce(_col(c), F.lit(0.0))


def sd(a: ColumnLike, b: ColumnLike) -> Column:
    """Null-safe division: null when either side is null or the divisor is 0."""
    return F.try_divide(_col(a), _col(b))


def rnd(c: ColumnLike, digits: int = 4) -> Column:
    """Round half to even on the double value.

    ``rint`` stays in primitive arithmetic; ``F.round`` on doubles goes through
    BigDecimal per value.  ``+ 0.0`` turns a negative zero into plain zero.
    """
    if digits == 0:
        return F.rint(_col(c)) + F.lit(0.0)
    scale = F.lit(float(10**digits))
    return F.rint(_col(c) * scale) / scale + F.lit(0.0)


def rnd_exact(c: ColumnLike, digits: int) -> Column:
    """Round the exact binary value, as decimal text formatting does.

    ``rnd`` can be off where ``x * 10**digits`` itself rounds onto a tie (2.675
    to two digits).  That matters for showing numbers that were already
    rounded, so here the rounding error of the product is recovered by
    splitting x into two halves and decides such cases.  Refer to plain
    columns only: the argument appears several times.
    """
    x = _col(c)
    scale = F.lit(float(10**digits))
    shifted = x * F.lit(134217729.0)  # 2**27 + 1
    high = shifted - (shifted - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.rint(product)
    rest = product - whole
    step = (
        F.when((rest == 0.5) & (error > 0), 1.0)
        .when((rest == -0.5) & (error < 0), -1.0)
        .otherwise(0.0)
    )
    return (whole + step) / scale + F.lit(0.0)


def flag(cond: Column) -> Column:
    """A predicate that is never null."""
    return F.coalesce(cond, F.lit(False))


def date_rank_key(date: ColumnLike, pos: ColumnLike, later_position_wins: bool) -> Column:
    """One BIGINT that orders rows by date, then by position in the feed.

    Used as the ordering of ``max_by``.  A struct ordering would force a sort
    based aggregate; a fixed-width key keeps the hash aggregate (and its
    map-side combine), so a company holding a third of all facts is reduced
    before the shuffle.  A missing date sorts first.  Positions must lie in
    [0, 2**41); every date from year 1 to 9999 fits the days above them.
    """
    days = F.coalesce(F.unix_date(_col(date)), F.lit(_NO_DATE)).cast("bigint")
    position = _col(pos).cast("bigint")
    if not later_position_wins:
        position = F.lit((1 << _POSITION_BITS) - 1) - position
    return F.shiftleft(days, _POSITION_BITS) + position
