"""Whole-table ordering without a single-task window.

Ranks, exact quantiles and rank sums all need "how much comes before this row".
An un-partitioned window would send the table to one task, and ``percentile``
keeps every distinct value of a group in one buffer.  Here the (already
combined) rows are range-partitioned, sorted, and stored once in the shared
folder together with their range number, so every later step sees the same
ranges even if executors are lost in between.  The offset of a range is a
running total over one row per range.  Sort keys are unique after combining,
so ranges stay balanced for any distribution of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_PART = "_part"
_GROUP = "_group"


@dataclass(frozen=True)
class _Ranges:
    """Stored sorted rows, and per (group, range) the sum, offset and group total."""

    rows: DataFrame
    offsets: DataFrame
    order: Sequence[Column]
    sums: Sequence[str]


def _split(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Sequence[str]
) -> _Ranges:
    # A struct key makes null groups ordinary values and one partitioning serve
    # the window and the join below.
    key = F.struct(*groups) if groups else F.lit(0)
    rows = materialise(
        df.withColumn(_GROUP, key)
        .repartitionByRange(F.col(_GROUP).asc(), *order)
        .sortWithinPartitions(F.col(_GROUP).asc(), *order)
        .withColumn(_PART, F.spark_partition_id()),
        "sorted",
    )
    # A group covers neighbouring ranges: at most ranges + groups rows.
    totals = rows.groupBy(_GROUP, _PART).agg(*[F.sum(s).alias(f"sum_{s}") for s in sums])
    whole = Window.partitionBy(_GROUP)
    earlier = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns(
        {
            **{f"off_{s}": F.coalesce(F.sum(f"sum_{s}").over(earlier), F.lit(0)) for s in sums},
            **{f"total_{s}": F.sum(f"sum_{s}").over(whole) for s in sums},
        }
    )
    return _Ranges(rows, offsets, order, sums)


def _place(r: _Ranges, only: Sequence[int] | None = None) -> DataFrame:
    """Rows with ``before_<s>`` and ``total_<s>``; ``only`` restricts the ranges."""
    rows = r.rows if only is None else r.rows.where(F.col(_PART).isin(list(only)))
    within = (
        Window.partitionBy(_GROUP, _PART)
        .orderBy(*r.order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumns(
        {f"_run_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in r.sums}
    )
    placed = local.join(r.offsets, [_GROUP, _PART])
    return placed.withColumns(
        {f"before_{s}": F.col(f"_run_{s}") + F.col(f"off_{s}") for s in r.sums}
    ).drop(_GROUP, _PART, *[f"{p}_{s}" for p in ("_run", "off", "sum") for s in r.sums])


def running_before(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Sequence[str]
) -> DataFrame:
    """Add ``before_<s>`` (sum of ``s`` over earlier rows of the group) and ``total_<s>``.

    ``groups`` plus ``order`` must identify a row.
    """
    return _place(_split(df, groups, order, sums))


def ordinal_ranks(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """(key, one rank per entry): 1-based position by value, descending.

    ``values`` maps rank name to column.  Nulls get no rank, ties follow
    ``key``.  All ranks share one range sort of narrow (name, value, key) rows.
    """
    long = df.select(key, *[F.col(v).cast("double").alias(n) for n, v in values.items()]).unpivot(
        [key], list(values), "metric", "value"
    )
    rows = long.where(F.col("value").isNotNull()).withColumn("one", F.lit(1))
    placed = running_before(rows, ["metric"], [F.col("value").desc(), F.col(key).asc()], ["one"])
    rank = (F.col("before_one") + 1).cast("bigint")
    return placed.groupBy(key).agg(
        *[F.max(F.when(F.col("metric") == n, rank)).alias(n) for n in values]
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles: rows (groups..., prob, quantile).

    Equal values are combined on the map side, the distinct ones are sorted by range, and
    only the ranges that hold a wanted position are looked at row by row.
    """
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of_counts(counts, "_v", "_n", probs, groups)


def quantiles_of_counts(
    counts: DataFrame, value: str, count: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of a value -> count table (one row per group and value)."""
    order = [F.col(value).asc()]
    return _interpolated(_neighbours(counts, value, count, probs, list(groups), order), groups)


def _interpolated(found: DataFrame, groups: Sequence[str]) -> DataFrame:
    low, high, frac = F.col("low"), F.col("high"), F.col("frac")
    quantile = F.when(frac > 0, low + (high - low) * frac).otherwise(low)
    return found.select(*groups, "prob", quantile.alias("quantile"))


def _neighbours(
    counts: DataFrame,
    value: str,
    count: str,
    probs: Sequence[float],
    groups: Sequence[str],
    order: Sequence[Column],
) -> DataFrame:
    """(groups..., prob, low, high, frac): the values around each wanted position.

    Only the ranges that hold a wanted position are placed row by row.
    """
    ranges = _split(counts, groups, order, [count])
    total = F.col(f"total_{count}")

    def position(p: float) -> Column:
        return (total - 1) * F.lit(float(p))

    def covers(first: Column, end: Column, at: Column) -> Column:
        return (first <= at) & (at < end)

    def near(first: Column, end: Column, p: float) -> Column:
        at = F.floor(position(p))
        return covers(first, end, at) | covers(first, end, at + 1)

    off = F.col(f"off_{count}")
    needed = reduce(or_, [near(off, off + F.col(f"sum_{count}"), p) for p in probs])
    # At most one number per range.
    parts = [r[0] for r in ranges.offsets.where(needed).select(_PART).distinct().collect()]
    placed = _place(ranges, parts)
    first = F.col(f"before_{count}")
    end = first + F.col(count)

    def target(p: float) -> Column:
        at = F.floor(position(p))
        return F.when(
            near(first, end, p),
            F.struct(
                F.lit(float(p)).alias("prob"),
                (position(p) - at).alias("frac"),
                F.when(covers(first, end, at), F.col(value)).alias("low"),
                F.when(covers(first, end, at + 1), F.col(value)).alias("high"),
            ),
        )

    # Each distinct value knows which positions it covers; all others drop out.
    hits = placed.select(
        *groups, F.explode(F.array_compact(F.array(*[target(p) for p in probs]))).alias("hit")
    )
    return hits.groupBy(*groups, F.col("hit.prob").alias("prob")).agg(
        *[F.max(f"hit.{x}").alias(x) for x in ("low", "high", "frac")]
    )


def quantile_columns(
    df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Wide form: one row per group, one column per named probability."""
    q = exact_quantiles(df, value, list(probs.values()), groups)
    aggs = [
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
        for name, p in probs.items()
    ]
    return q.groupBy(*groups).agg(*aggs)
