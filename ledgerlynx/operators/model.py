"""Walk-forward evaluation: preparation, splits, boosted trees, backtest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rnd, sd
from ..session import materialise
from . import boost
from .boost import TreeParams
from .features import EXTENDED_COLUMNS, FLAG_COLUMNS, YOY_COLUMNS
from .ordered import exact_quantiles, quantiles_of_counts, running_before
from .prices import PRICE_FEATURES
from .stats import long_form, winsorise

c = F.col

# The model columns, by group.
SCORE_FEATURES = [
    "beneish_score", "piotroski_score", "accruals_ratio", "cfd_ratio", "altman_score",
    "ar_ratio", "dso", "non_op_ratio",
]
SIGNAL_FLAGS = [
    "beneish_flag", "piotroski_weak", "accruals_flag", "cfd_flag", "altman_flag",
    "revenue_quality_flag", "earnings_quality_flag",
]
VALUE_FEATURES = [
    "earnings_yield", "return_on_capital", "acquirers_multiple", "ncav_ratio", "net_net_flag",
    "gross_profitability", "croic", "roe", "roa", "fcf_yield", "gross_margin", "net_margin",
    "debt_to_equity", "current_ratio", "pe_ratio", "pb_ratio", "ev_ebitda",
]
FEATURES = [
    *SCORE_FEATURES, *SIGNAL_FLAGS, *VALUE_FEATURES, *EXTENDED_COLUMNS, *YOY_COLUMNS,
    *PRICE_FEATURES, *FLAG_COLUMNS,
]

MIN_TRAIN, MIN_TEST = 50, 10
TOP_N = 20


def present_features(df: DataFrame) -> list[str]:
    return [f for f in FEATURES if f in df.columns]


def numeric_features(df: DataFrame) -> list[str]:
    types = dict(df.dtypes)
    return [f for f in present_features(df) if types[f] != "boolean"]


def prepare(panel: DataFrame, label: str, train_only: DataFrame | None = None) -> DataFrame:
    """Labelled rows with label and numeric features winsorised at 1% / 99%."""
    rows = panel.where(c(label).isNotNull())
    return winsorise(rows, [label, *numeric_features(rows)], reference=train_only)


def label_balance(rows: DataFrame, beat: str) -> DataFrame:
    feats = present_features(rows)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(c(beat).cast("double")).alias("label_balance"),
    ).withColumns(
        {
            "features": F.lit(len(feats)),
            "yoy_features": F.lit(sum(f in YOY_COLUMNS for f in feats)),
            "price_features": F.lit(sum(f in PRICE_FEATURES for f in feats)),
        }
    )


def walk_forward_splits(rows: DataFrame) -> DataFrame:
    """(test_year, train_rows, test_rows): from the third year on, big enough only.

    The windows run over one row per fiscal year.
    """
    years = rows.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("test_rows"))
    order = Window.partitionBy(F.lit(1)).orderBy("fiscal_year")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        years.select(
            c("fiscal_year").alias("test_year"),
            F.coalesce(F.sum("test_rows").over(earlier), F.lit(0)).alias("train_rows"),
            "test_rows",
            F.row_number().over(order).alias("nth"),
        )
        .where((c("nth") >= 3) & (c("train_rows") >= MIN_TRAIN) & (c("test_rows") >= MIN_TEST))
        .drop("nth")
    )


def test_years(splits: DataFrame) -> list[int]:
    """The split years on the driver: one number per fiscal year."""
    return sorted(r["test_year"] for r in splits.select("test_year").collect())


def train_medians(rows: DataFrame, years: Sequence[int], features: Sequence[str]) -> DataFrame:
    """(test_year, feature, median) over the rows before each test year.

    Values are combined per year first; only the counts are handed to the later
    splits, not the rows.
    """
    counts = (
        long_form(rows, features, ["fiscal_year"])
        .where(c("value").isNotNull())
        .groupBy("fiscal_year", "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    splits = F.array(*[F.lit(int(y)) for y in years])
    later = F.filter(splits, lambda y: y > c("fiscal_year"))
    handed = counts.withColumn("test_year", F.explode(later))
    merged = handed.groupBy("test_year", "feature", "value").agg(F.sum("n").alias("n"))
    return quantiles_of_counts(merged, "value", "n", [0.5], ["test_year", "feature"]).select(
        "test_year", "feature", c("quantile").alias("median")
    )


# -- metrics ------------------------------------------------------------------


def auc(scored: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC as a rank sum (ties count half), per group."""
    counts = (
        scored.where(c(label).isNotNull() & c(score).isNotNull())
        .groupBy(*groups, c(score).alias("_s"))
        .agg(
            F.sum(c(label).cast("int")).alias("pos"),
            F.sum(1 - c(label).cast("int")).alias("neg"),
        )
    )
    placed = running_before(counts, list(groups), [c("_s").asc()], ["neg"])
    wins = F.sum(c("pos") * (c("before_neg") + c("neg") / 2.0))
    return placed.groupBy(*groups).agg(
        sd(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def mae(scored: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*groups).agg(F.avg(F.abs(c(actual) - c(predicted))).alias("mae"))


def backtest(scored: DataFrame, score: str, n: int = TOP_N) -> DataFrame:
    """Yearly return of the n best scores against the benchmark, and their growth.

    The group limit prunes on the map side; what follows is one row per year.
    """
    w = Window.partitionBy("fiscal_year").orderBy(c(score).desc(), "cik")
    best = (
        scored.where(c(score).isNotNull())
        .withColumn("rn", F.row_number().over(w))
        .where(c("rn") <= n)
    )
    yearly = (
        best.groupBy("fiscal_year")
        .agg(
            F.avg("forward_return_12m").alias("strategy"),
            F.avg("sp500_return_12m").alias("benchmark"),
            F.count(F.lit(1)).alias("n_stocks"),
        )
        .where(c("strategy").isNotNull())
    )
    return cumulative_growth(yearly)


def cumulative_growth(yearly: DataFrame) -> DataFrame:
    """Running product of (1 + r) over years; a missing benchmark year counts as 0."""
    w = (
        Window.partitionBy(F.lit(1))
        .orderBy("fiscal_year")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return yearly.withColumns(
        {
            "cum_strategy": F.product(1 + c("strategy")).over(w),
            "cum_benchmark": F.product(1 + F.coalesce(c("benchmark"), F.lit(0.0))).over(w),
        }
    )


# -- boosted trees ------------------------------------------------------------


@dataclass(frozen=True)
class Horizon:
    """Prepared rows of one horizon: return label, and whether it beat the benchmark.

    ``benchmark``, the benchmark's return over the same time, is carried along if present.
    """

    rows: DataFrame
    label: str
    beat: str
    benchmark: str = ""


@dataclass(frozen=True)
class WalkForward:
    """``predictions``: horizon, cik, fiscal_year, beat, actual, benchmark, proba,
    predicted_return; ``importances``: horizon, test_year, feature, importance.
    """

    predictions: DataFrame
    importances: DataFrame
    fitted: boost.Boosted


def _training_rows(name: str, h: Horizon, features: Sequence[str]) -> DataFrame:
    mark = c(h.benchmark).cast("double") if h.benchmark else F.lit(None).cast("double")
    return h.rows.select(
        F.lit(name).alias("horizon"),
        "cik",
        c("fiscal_year").cast("int").alias("fiscal_year"),
        F.coalesce(c(h.beat).cast("double"), F.lit(0.0)).alias("beat"),
        F.coalesce(c(h.label).cast("double"), F.lit(0.0)).alias("actual"),
        mark.alias("benchmark"),
        *[c(f).cast("double").alias(f) for f in features],
    )


def walk_forward_horizons(
    horizons: dict[str, Horizon], features: Sequence[str] | None = None, params: TreeParams | None = None
) -> WalkForward:
    """A classifier and a regressor per horizon and test year, all grown in lock-step.

    Every fit sees the years before its test year only, and fills missing values with the
    medians of those.  A horizon without a split is left out.
    """
    feats = list(features or present_features(next(iter(horizons.values())).rows))
    parts, fits = [], []
    for name, h in horizons.items():
        rows = materialise(_training_rows(name, h, feats), f"training-{name}")
        years = test_years(walk_forward_splits(rows))
        if not years:
            continue
        # One number per test year and feature.
        medians: dict[int, dict[str, float]] = {}
        for r in train_medians(rows, years, feats).collect():
            medians.setdefault(r["test_year"], {})[r["feature"]] = r["median"]
        for year in years:
            known = medians.get(year, {})
            fits += [boost.Fit(name, year, kind, known) for kind in ("logistic", "squared")]
        parts.append(rows)
    if not fits:
        raise ValueError("not enough labelled years for a walk-forward split")
    spark = parts[0].sparkSession
    rows = reduce(DataFrame.unionByName, parts)
    model = boost.boost(rows, feats, fits, params or TreeParams(), boost.WHOLE_CELLS)
    keys = ["horizon", "cik", "fiscal_year", "beat", "actual", "benchmark"]
    tested = boost.final_margins(model, keys).where(c("before") == c("fiscal_year"))
    # Both fits of a year meet on the row itself, not in a shuffle by key.
    sure, squared = c("kind") == "logistic", c("kind") == "squared"
    predictions = tested.groupBy(*keys).agg(
        F.max(F.when(sure, 1 / (1 + F.exp(-c("margin"))))).alias("proba"),
        F.max(F.when(squared, c("margin"))).alias("predicted_return"),
    )
    rows = [
        (fit.horizon, fit.before, f, v)
        for fit, trees in zip(model.fits, model.trees, strict=True)
        if fit.kind == "logistic"
        for f, v in boost.importances(trees, feats).items()
    ]
    found = spark.createDataFrame(
        rows, "horizon string, test_year int, feature string, importance double"
    )
    return WalkForward(materialise(predictions, "predictions"), found, model)


def walk_forward(
    rows: DataFrame,
    label: str,
    beat: str,
    features: Sequence[str] | None = None,
    params: TreeParams | None = None,
) -> WalkForward:
    """Fit a classifier and a regressor per test year on all earlier years of one horizon.

    ``rows`` comes from :func:`prepare`.
    """
    return walk_forward_horizons({label: Horizon(rows, label, beat)}, features, params)


@dataclass(frozen=True)
class FinalModel:
    """Classifier fitted on all labelled rows, with what it needs to score others."""

    features: Sequence[str]
    fitted: boost.Boosted

    def score(self, rows: DataFrame) -> DataFrame:
        """(cik, fiscal_year, proba) for any panel rows, one company or all."""
        narrow = rows.select("cik", "fiscal_year", *self.features)
        proba = 1 / (1 + F.exp(-c("margin")))
        return boost.score(self.fitted, narrow).select("cik", "fiscal_year", proba.alias("proba"))

    def explain(self, rows: DataFrame) -> DataFrame:
        """What each feature adds to the log odds of a row; see :func:`boost.attributions`."""
        return boost.attributions(self.fitted, rows.select("cik", "fiscal_year", *self.features))

    def importances(self, spark: SparkSession) -> DataFrame:
        found = boost.importances(self.fitted.trees[0], self.features)
        return spark.createDataFrame(
            [(None, f, v) for f, v in found.items()], "test_year int, feature string, importance double"
        )


def fit_final(
    rows: DataFrame,
    beat: str,
    features: Sequence[str] | None = None,
    params: TreeParams | None = None,
) -> FinalModel:
    """Fit on every row of :func:`prepare`, medians over all of them."""
    feats = list(features or present_features(rows))
    medians = {
        r["feature"]: r["quantile"]
        for r in exact_quantiles(long_form(rows, feats), "value", [0.5], ["feature"]).collect()
    }
    narrow = materialise(_training_rows("all", Horizon(rows, beat, beat), feats), "final")
    fit = boost.Fit("all", None, "logistic", medians)
    grown = boost.boost(narrow, feats, [fit], params or TreeParams(), boost.WHOLE_CELLS)
    return FinalModel(feats, grown)


def importance_by_horizon(importances: dict[str, DataFrame], n: int = 15) -> DataFrame:
    """The n most important features of each horizon, stacked."""
    parts = [
        mean_importance(table, n).withColumn("horizon", F.lit(h)) for h, table in importances.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def mean_importance(importances: DataFrame, n: int = 20) -> DataFrame:
    return (
        importances.groupBy("feature")
        .agg(F.avg("importance").alias("importance"))
        .orderBy(c("importance").desc(), "feature")
        .limit(n)
    )


def split_metrics(predictions: DataFrame) -> DataFrame:
    """AUC and MAE per horizon and test year, and pooled (fiscal_year null)."""
    every = predictions.withColumn(
        "fiscal_year", F.explode(F.array(c("fiscal_year"), F.lit(None).cast("int")))
    )
    keys = ["horizon", "fiscal_year"]
    left, right = auc(every, "beat", "proba", keys), mae(every, "actual", "predicted_return", keys)
    same = [left[k].eqNullSafe(right[k]) for k in keys]
    joined = left.join(right, reduce(and_, same)).select(*[left[k] for k in keys], "auc", "mae")
    return joined.select(*keys, rnd("auc").alias("auc"), rnd("mae").alias("mae"))


def backtest_predictions(predictions: DataFrame, n: int = TOP_N) -> DataFrame:
    """Yearly return of the ``n`` likeliest winners of each test year, as :func:`backtest`."""
    named = predictions.withColumnsRenamed(
        {"actual": "forward_return_12m", "benchmark": "sp500_return_12m"}
    )
    return backtest(named, "proba", n)
