"""Cross-sectional statistics over the report or the panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import flag, nz, rnd, sd
from .ordered import exact_quantiles, quantile_columns
from .screens import FLAG_CODES

c = F.col


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value): one row per column, all values as double."""
    values = df.select(*keep, *[c(x).cast("double").alias(x) for x in columns])
    return values.unpivot(list(keep), list(columns), "feature", "value")


# -- coverage and counts ------------------------------------------------------


def measured_columns(df: DataFrame) -> list[str]:
    """Columns that hold numbers, by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null count, share and band per column; one pass, one row, then unpivot.

    Without a list, every column that holds numbers counts.
    """
    columns = measured_columns(df) if columns is None else columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(x).alias(x) for x in columns])
    long = one.unpivot(["_rows"], list(columns), "metric", "count")
    pct = rnd(sd(c("count") * 100.0, "_rows"), 1)
    return (
        long.select("metric", "count", pct.alias("coverage_pct"))
        .withColumn("band", coverage_band(c("coverage_pct")))
    )


def top_coverage(df: DataFrame, columns: Sequence[str], n: int = 40) -> DataFrame:
    return coverage(df, columns).orderBy(c("count").desc(), "metric").limit(n)


def coverage_band(pct: Column) -> Column:
    return F.when(pct >= 70, "good").when(pct >= 40, "fair").otherwise("poor")


def domain_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Count and share per value of a fixed ordered domain, zeros included."""
    one = df.agg(*[F.count_if(c(column) == v).alias(v) for v in domain])
    counts = one.unpivot([], list(domain), column, "count")
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    position = F.array_position(F.array(*[F.lit(v) for v in domain]), c(column))
    return counts.select(
        position.cast("int").alias("position"),
        column,
        "count",
        sd(c("count").cast("double"), total).alias("share"),
    )


def yearly_rows(panel: DataFrame, low: int = 2000, high: int = 2030) -> DataFrame:
    """Rows per plausible fiscal year."""
    return (
        panel.where(c("fiscal_year").between(low, high))
        .groupBy("fiscal_year")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    agg = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(F.count(F.lit(1)).alias("rows"), agg.alias("distinct_values"))


def label_coverage(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("forward_return_12m").alias("labelled_12m"),
        F.count("forward_return_24m").alias("labelled_24m"),
        F.count("beat_sp500").alias("beat_labels"),
    )


def flag_tally(df: DataFrame) -> DataFrame:
    """Active count and percent per signal over the filtered set."""
    cols = [f for f, _, _ in FLAG_CODES]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(flag(c(f))).alias(f) for f in cols])
    long = one.unpivot(["_rows"], cols, "signal", "count")
    return long.select("signal", "count", rnd(sd(c("count") * 100.0, "_rows"), 0).alias("pct"))


# -- distributions ------------------------------------------------------------


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, exact median, sample deviation and share above zero (one row)."""
    median = quantile_columns(df, column, {"q": 0.5}).scalar()
    v = c(column).cast("double")
    return df.agg(
        F.count(column).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.avg((v > 0).cast("double")).alias("share_positive"),
    ).withColumn("median", median)


def group_median(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Exact median of each column per group, long form (group, feature, median)."""
    long = long_form(df, columns, [group])
    return exact_quantiles(long, "value", [0.5], [group, "feature"]).select(
        group, "feature", c("quantile").alias("median")
    )


def group_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """mean, median, std, count per group (null groups dropped)."""
    rows = df.where(c(group).isNotNull())
    v = c(column).cast("double")
    stats = rows.groupBy(group).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(column).alias("count")
    )
    median = quantile_columns(rows, column, {"median": 0.5}, [group])
    return stats.join(median, group, "left")


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp, keeping null (``greatest``/``least`` would skip it)."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, lo), hi))


def histogram(
    df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Equal-width counts (bin, count) over the clipped range; the last bin is closed.

    Without bounds, values are clipped at the exact 1% and 99% quantiles.
    """
    v = c(column).cast("double")
    if low is None or high is None:
        q = quantile_columns(df, column, {"lo": 0.01, "hi": 0.99}).first()
        low, high = (0.0 if q[x] is None else q[x] for x in ("lo", "hi"))
    rows = df.where(v.isNotNull()).select(clip(v, low, high).alias("v"))
    span = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    width = (span["hi"] - span["lo"]) / F.lit(float(bins))
    raw = F.floor(F.coalesce(sd(c("v") - span["lo"], width), F.lit(0.0)))
    return (
        rows.groupBy(F.least(raw, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def group_histogram(df: DataFrame, group: str, column: str, bins: int) -> DataFrame:
    """Equal-width counts (group, bin, count) over each group's own range."""
    v = c(column).cast("double")
    rows = df.where(v.isNotNull()).select(group, v.alias("v"))
    # One row per group; null is a group as well.
    ends = rows.groupBy(group).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    ends = ends.withColumnRenamed(group, "_group")
    placed = rows.join(ends, rows[group].eqNullSafe(ends["_group"])).drop("_group")
    width = (c("_hi") - c("_lo")) / F.lit(float(bins))
    raw = F.floor(F.coalesce(sd(c("v") - c("_lo"), width), F.lit(0.0)))
    return placed.groupBy(group, F.least(raw, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )


def winsor_bounds(
    df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """(feature, lo, hi): exact quantiles of many columns, spread over tasks."""
    return quantile_columns(
        long_form(df, columns), "value", {"lo": low, "hi": high}, ["feature"]
    )


def winsorise(
    df: DataFrame,
    columns: Sequence[str],
    low: float = 0.01,
    high: float = 0.99,
    reference: DataFrame | None = None,
) -> DataFrame:
    """Clip columns at their quantiles; ``reference`` supplies the bounds.

    The default takes bounds from all rows, test years included; pass the
    training rows to avoid that leak.  Fitting brings two numbers per column to
    the driver, so the result is a plain projection with constants.
    """
    bounds = winsor_bounds(df if reference is None else reference, columns, low, high)
    fitted = {r["feature"]: (r["lo"], r["hi"]) for r in bounds.collect()}
    return df.withColumns(
        {x: clip(c(x).cast("double"), *fitted[x]) for x in columns if x in fitted}
    )


# -- correlation --------------------------------------------------------------


def _pair_corr(a: Column, b: Column) -> Column:
    """Pearson over rows with both values; null on a constant or single row.

    ``corr`` itself raises on a constant column under ANSI.
    """
    both_a, both_b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(both_a) * F.stddev_samp(both_b))


def label_correlations(df: DataFrame, features: Sequence[str], label: Column) -> DataFrame:
    """(feature, correlation) with one label, in one pass."""
    rows = df.select(*[c(x).cast("double").alias(x) for x in features], label.alias("_label"))
    one = rows.where(c("_label").isNotNull()).agg(
        *[_pair_corr(c(x), c("_label")).alias(x) for x in features]
    )
    return one.unpivot([], list(features), "feature", "correlation").where(
        c("correlation").isNotNull()
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], min_values: int = 100) -> DataFrame:
    """Pairwise-complete Pearson correlations (feature_a, feature_b, n, correlation).

    Each task folds its Arrow batches into masked Gram matrices and emits them
    once; what is shuffled is k x k numbers per task, whatever the row count.
    Values are shifted by the column mean to keep the sums well conditioned.
    Columns with ``min_values`` values or fewer are left out.
    """
    names = list(columns)
    means = df.agg(*[F.avg(c(x).cast("double")).alias(x) for x in names]).first()
    shift = np.array([means[x] or 0.0 for x in names])
    values = df.select(*[c(x).cast("double").alias(x) for x in names])
    k = len(names)

    def fold(batches):
        total = np.zeros((5, k, k))
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float, na_value=np.nan) - shift
            mask = np.isfinite(x).astype(float)
            x = np.where(mask > 0, x, 0.0)
            total[0] += mask.T @ mask
            total[1] += x.T @ mask
            total[2] += mask.T @ x
            total[3] += (x * x).T @ mask
            total[4] += x.T @ x
        i, j = (a.ravel() for a in np.indices((k, k)))
        yield pd.DataFrame(
            {
                "i": i, "j": j, "n": total[0].ravel(), "sx": total[1].ravel(),
                "sy": total[2].ravel(), "sxx": total[3].ravel(), "sxy": total[4].ravel(),
            }
        )

    sums = values.mapInPandas(
        fold, "i int, j int, n double, sx double, sy double, sxx double, sxy double"
    )
    sums = sums.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("n", "sx", "sy", "sxx", "sxy")])
    # The sum of y squared over the pair's rows is the mirrored entry.
    mirror = sums.select(c("i").alias("j"), c("j").alias("i"), c("sxx").alias("syy"))
    own = sums.where(c("i") == c("j")).select(c("i").alias("k"), c("n").alias("values"))
    filled = own.where(c("values") > min_values).select("k")
    pairs = (
        sums.where(c("i") < c("j"))
        .join(mirror, ["i", "j"])
        .join(filled.withColumnRenamed("k", "i"), "i", "left_semi")
        .join(filled.withColumnRenamed("k", "j"), "j", "left_semi")
    )
    cov = c("sxy") - c("sx") * c("sy") / nz("n")
    vx = c("sxx") - c("sx") * c("sx") / nz("n")
    vy = c("syy") - c("sy") * c("sy") / nz("n")
    labels = F.array(*[F.lit(x) for x in names])
    # Relative to the raw second moments, below this a variance is round-off.
    tiny = 1e-12
    usable = (vx > tiny * c("sxx")) & (vy > tiny * c("syy"))
    return pairs.select(
        F.get(labels, c("i")).alias("feature_a"),
        F.get(labels, c("j")).alias("feature_b"),
        c("n").cast("bigint").alias("n"),
        F.when(usable, cov / nz(F.sqrt(vx) * F.sqrt(vy))).alias("correlation"),
    )


def redundant_pairs(matrix: DataFrame, above: float = 0.6) -> DataFrame:
    size = F.abs(c("correlation"))
    return (
        matrix.where(size > above)
        .orderBy(size.desc(), "feature_a", "feature_b")
        .select("feature_a", "feature_b", rnd("correlation", 3).alias("correlation"))
    )


# -- quartiles and audits -----------------------------------------------------

# Quartile labels.
QUARTILES = ["Q1 Low Risk", "Q2", "Q3", "Q4 High Risk"]


def quartile_returns(df: DataFrame, score: str, target: str) -> DataFrame:
    """Mean, median and count of ``target`` per quartile of ``score``.

    Edges are exact quantiles, intervals right-closed, so equal scores stay
    together; collapsed edges merge into the lower bucket.
    """
    rows = df.where(c(score).isNotNull() & c(target).isNotNull()).select(
        c(score).cast("double").alias("s"), c(target).cast("double").alias("t")
    )
    q = quantile_columns(rows, "s", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    edges = q.select(F.struct("q1", "q2", "q3")).scalar()
    bucketed = rows.withColumn(
        "quartile",
        F.when(c("s") <= edges["q1"], QUARTILES[0])
        .when(c("s") <= edges["q2"], QUARTILES[1])
        .when(c("s") <= edges["q3"], QUARTILES[2])
        .otherwise(QUARTILES[3]),
    )
    stats = bucketed.groupBy("quartile").agg(F.avg("t").alias("mean"), F.count("t").alias("count"))
    return stats.join(quantile_columns(bucketed, "t", {"median": 0.5}, ["quartile"]), "quartile")


def early_filings(panel: DataFrame) -> DataFrame:
    """Look-ahead audit: labelled rows filed before their fiscal year ended."""
    year_end = F.make_date("fiscal_year", F.lit(12), F.lit(31))
    return panel.where(
        c("forward_return_12m").isNotNull() & (c("filed_date") < year_end)
    ).select("cik", "ticker", "fiscal_year", "filed_date", year_end.alias("year_end"))


# Points per flag of the approximate score.
APPROX_POINTS = {
    "beneish_flag": 20, "piotroski_weak": 10, "accruals_flag": 10, "cfd_flag": 10,
    "altman_flag": 20, "revenue_quality_flag": 10, "earnings_quality_flag": 10,
}


def approximate_score() -> Column:
    return reduce(add, [flag(c(f)).cast("int") * p for f, p in APPROX_POINTS.items()])
