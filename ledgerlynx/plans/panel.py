"""The historical panel: company x fiscal year with features and labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prices
from ..operators.facts import (
    PANEL_FIELDS,
    annual_financials,
    annual_values,
    fiscal_year_bounds,
)
from ..operators.features import (
    EXTENDED_COLUMNS,
    FLAG_COLUMNS,
    YOY_COLUMNS,
    add_yoy,
    extended_flags,
    extended_ratios,
)
from ..operators.signals import accounting_columns
from ..operators.value import VALUE_COLUMNS, value_columns

#: Value metrics the panel keeps.
PANEL_VALUES = [v for v in VALUE_COLUMNS if v not in ("ev", "ebitda", "ev_clean")]
PANEL_IDENTITY = ["cik", "fiscal_year", "filed_date", "ticker", "name", "exchange"]
ACCOUNTING_COLUMNS = [
    "beneish_score", "beneish_flag", "piotroski_score", "piotroski_weak", "accruals_ratio",
    "accruals_flag", "cfd_ratio", "cfd_flag", "altman_score", "altman_zone", "altman_flag",
    "ar_ratio", "dso", "revenue_quality_flag", "non_op_ratio", "earnings_quality_flag",
]
PANEL_COLUMNS = [
    *PANEL_IDENTITY, *PANEL_FIELDS, *YOY_COLUMNS, *prices.RETURN_COLUMNS,
    *prices.PRICE_FEATURES, "market_cap", *ACCOUNTING_COLUMNS, *PANEL_VALUES,
    *EXTENDED_COLUMNS, *FLAG_COLUMNS,
]


def annual_panel(
    facts: DataFrame, as_of: dt.date, years: int = 5, floor: int = 2000
) -> DataFrame:
    """Wide annual financials with year-over-year features."""
    return add_yoy(annual_financials(annual_values(facts, as_of, years, floor)))


def priced_panel(
    annual: DataFrame,
    companies: DataFrame,
    bars: DataFrame,
    benchmark: DataFrame,
    as_of: dt.date,
    pit_strict: bool = False,
    first_filed: dt.date | None = None,
) -> DataFrame:
    """Add identity, returns, price features and the point-in-time market cap.

    ``first_filed`` bounds the filing dates from below, and so the bars that are read.
    """
    listed = companies.where(F.coalesce(F.length("ticker"), F.lit(0)) > 0).select(
        "cik", "ticker", "name", "exchange", F.col("market_cap").alias("_current_cap")
    )
    if first_filed is not None:
        bars = prices.prune_bars(bars, listed, first_filed, None if pit_strict else as_of)
    priced = prices.attach_prices(
        annual.join(listed, "cik"),
        prices.price_days(bars),
        prices.benchmark_days(benchmark),
        as_of,
        pit_strict,
    )
    cap = prices.point_in_time_cap("entry_price", "shares_outstanding", "_current_cap")
    return priced.withColumn("market_cap", cap).drop("_current_cap")


def with_features(priced: DataFrame) -> DataFrame:
    """Signals, value metrics, extended ratios and flags: one projection."""
    values = value_columns()
    return priced.withColumns(
        {
            **accounting_columns(),
            **{v: values[v] for v in PANEL_VALUES},
            **extended_ratios(),
            **extended_flags(),
        }
    )


def build_panel(
    companies: DataFrame,
    facts: DataFrame,
    bars: DataFrame,
    benchmark: DataFrame,
    as_of: dt.date,
    years: int = 5,
    floor: int = 2000,
    pit_strict: bool = False,
) -> DataFrame:
    annual = annual_panel(facts, as_of, years, floor)
    # A fiscal year can be filed at the end of the calendar year before it.
    first_filed = dt.date(fiscal_year_bounds(as_of, years, floor)[0] - 1, 1, 1)
    priced = priced_panel(annual, companies, bars, benchmark, as_of, pit_strict, first_filed)
    return with_features(priced).select(*PANEL_COLUMNS)
