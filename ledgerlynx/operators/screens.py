"""Parameterised filters and display columns over the report.

Everything is a plain predicate or projection, so Catalyst merges the chain
and pushes what it can into the parquet scan of the report.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flag, rnd
from ..functions import formats as fmt
from .ordered import quantile_columns
from .scoring import HIGH, MEDIUM, MEDIUM_FROM, HIGH_FROM

c = F.col

# Size presets in millions of dollars.  "Micro" here is a wider
# band than the micro segment of the value metrics.
CAP_PRESETS_MILLIONS: dict[str, tuple[float, float]] = {
    "All sizes": (0, 10_000_000),
    "Micro (<$300M)": (0, 300),
    "Small ($150M-$1B)": (150, 1_000),
    "Mid ($1B-$10B)": (1_000, 10_000),
    "Large (>$10B)": (10_000, 10_000_000),
}
TARGET_CAP = (150_000_000, 1_000_000_000)

FLAG_FILTERS = [
    "beneish_flag", "altman_flag", "going_concern_flag", "revenue_quality_flag",
    "earnings_quality_flag", "pump_dump_flag", "illiquid_flag", "insider_selling_flag",
    "small_auditor_flag",
]

# Short code and label per flag column.
FLAG_CODES: list[tuple[str, str, str]] = [
    ("beneish_flag", "Ben", "Beneish"),
    ("piotroski_weak", "Pio", "Piotroski"),
    ("accruals_flag", "Acc", "Accruals"),
    ("cfd_flag", "CFD", "CF Div."),
    ("altman_flag", "Alt", "Altman Z"),
    ("revenue_quality_flag", "RevQ", "Rev Quality"),
    ("earnings_quality_flag", "EarQ", "Earn Quality"),
    ("going_concern_flag", "GC", "Going Concern"),
    ("illiquid_flag", "Liq", "Illiquid"),
    ("pump_dump_flag", "P&D", "Pump & Dump"),
    ("insider_selling_flag", "Ins", "Insider Selling"),
]


def cap_class(low: float = TARGET_CAP[0], high: float = TARGET_CAP[1]) -> Column:
    """in_range / out_of_range / no_data; a missing ticker is no data."""
    known = (F.coalesce(F.length("ticker"), F.lit(0)) > 0) & c("market_cap").isNotNull()
    return (
        F.when(~known, "no_data")
        .when(c("market_cap").between(low, high), "in_range")
        .otherwise("out_of_range")
    )


def filter_by_cap(df: DataFrame, low: float = TARGET_CAP[0], high: float = TARGET_CAP[1]) -> DataFrame:
    return df.where(cap_class(low, high) == "in_range")


def cap_tally(df: DataFrame, low: float = TARGET_CAP[0], high: float = TARGET_CAP[1]) -> DataFrame:
    return df.groupBy(cap_class(low, high).alias("cap_class")).agg(
        F.count(F.lit(1)).alias("companies")
    )


@dataclass(frozen=True)
class ScreenParams:
    """Interactive filter state.  Zero switches a value filter off."""

    cap_low: float = 0.0
    cap_high: float = 1e13
    risks: Sequence[str] = (HIGH, MEDIUM)
    min_score: float = 0
    min_flags: int = 0
    search: str = ""
    #: False treats the search text as plain text instead of a pattern.
    search_is_pattern: bool = True
    flags: Sequence[str] = field(default_factory=tuple)
    max_pe: float = 0
    max_pb: float = 0
    min_fcf_yield_pct: float = 0
    min_roe_pct: float = 0

    @staticmethod
    def preset(name: str, **kw) -> ScreenParams:
        low, high = CAP_PRESETS_MILLIONS[name]
        return ScreenParams(cap_low=low * 1e6, cap_high=high * 1e6, **kw)


def search_predicate(term: str, pattern: bool = True) -> Column:
    """Ticker holds the upper-cased term, or the name holds it in any case."""
    if pattern:
        return flag(c("ticker").rlike(term.upper())) | flag(c("name").rlike(f"(?i){term}"))
    return flag(c("ticker").contains(term.upper())) | flag(F.lower("name").contains(term.lower()))


def screen(report: DataFrame, p: ScreenParams) -> DataFrame:
    """Apply the interactive filters; a missing market cap passes the size filter."""
    out = report.where(
        c("market_cap").isNull() | c("market_cap").between(p.cap_low, p.cap_high)
    )
    if p.risks:
        out = out.where(c("risk").isin(list(p.risks)))
    out = out.where(F.coalesce(c("fraud_score"), F.lit(0.0)) >= p.min_score)
    out = out.where(c("red_flags_count") >= p.min_flags)
    if p.search:
        out = out.where(search_predicate(p.search, p.search_is_pattern))
    for name in p.flags:
        out = out.where(c(name))
    if p.max_pe > 0:
        out = out.where(c("pe_ratio").isNull() | (c("pe_ratio") <= p.max_pe))
    if p.max_pb > 0:
        out = out.where(c("pb_ratio").isNull() | (c("pb_ratio") <= p.max_pb))
    if p.min_fcf_yield_pct != 0:
        out = out.where(c("fcf_yield") >= p.min_fcf_yield_pct / 100)
    if p.min_roe_pct != 0:
        out = out.where(c("roe") >= p.min_roe_pct / 100)
    return out


# -- candidate screens --------------------------------------------------------

CANDIDATE_COLUMNS = [
    "ticker", "name", "market_cap_segment", "fraud_score", "risk", "magic_formula_rank",
    "earnings_yield", "return_on_capital", "acquirers_multiple", "gross_profitability",
]
NET_NET_COLUMNS = [
    "ticker", "name", "market_cap_segment", "fraud_score", "risk", "ncav_ratio", "ncav",
    "market_cap", "current_ratio", "going_concern_flag",
]


def magic_formula_top(report: DataFrame, n: int = 20) -> DataFrame:
    """The n best combined ranks, with percentages as text."""
    top = report.where(c("magic_formula_rank").isNotNull()).orderBy("magic_formula_rank", "cik")

    def pct(name: str) -> Column:
        return F.when(c(name).isNull(), "").otherwise(fmt.percent(name)).alias(name)

    texts = {"earnings_yield", "return_on_capital", "gross_profitability"}
    return top.limit(n).select("cik", *[pct(x) if x in texts else x for x in CANDIDATE_COLUMNS])


def _threshold(report: DataFrame, column: str, p: float) -> Column:
    """An exact quantile of one column as a scalar subquery."""
    return quantile_columns(report, column, {"q": p}).scalar()


def _cheap_and_clean(report: DataFrame) -> Column:
    return (
        (c("magic_formula_rank") <= _threshold(report, "magic_formula_rank", 0.25))
        & (c("fraud_score") < MEDIUM_FROM)
        & c("altman_zone").isin("safe", "grey")
        & ~flag(c("going_concern_flag"))
    )


def alpha_screen(report: DataFrame) -> DataFrame:
    """Cheapest quartile, low score, not in distress, no going-concern doubt."""
    return report.where(_cheap_and_clean(report))


def alpha_screen_plus(report: DataFrame) -> DataFrame:
    """The alpha screen within the calmer half and the more profitable half.

    Without any volatility data the threshold is null and nothing qualifies.
    """
    return report.where(
        _cheap_and_clean(report)
        & (c("volatility_90d") <= _threshold(report, "volatility_90d", 0.5))
        & (c("gross_profitability") >= _threshold(report, "gross_profitability", 0.5))
    )


def net_nets(report: DataFrame) -> DataFrame:
    """Trading below net current assets, cheapest first."""
    return (
        report.where(flag(c("net_net_flag")))
        .orderBy(c("ncav_ratio").asc_nulls_last(), "cik")
        .select("cik", *NET_NET_COLUMNS)
    )


def segment_tally(df: DataFrame) -> DataFrame:
    return df.groupBy("market_cap_segment").agg(F.count(F.lit(1)).alias("companies"))


# -- display ------------------------------------------------------------------


def flag_codes() -> Column:
    active = [F.when(flag(c(col)), code) for col, code, _ in FLAG_CODES]
    joined = F.concat_ws(" · ", *active)
    return F.when(joined == "", "—").otherwise(joined)


# One sentence per active signal, in display order.
EXPLANATIONS: Mapping[str, str] = {
    "beneish_flag": "Beneish flagged: earnings may be manipulated.",
    "piotroski_weak": "Piotroski weak: poor financial health.",
    "accruals_flag": "High accruals: profit is not turning into cash.",
    "cfd_flag": "Cash flow divergence: income runs well ahead of operating cash flow.",
    "altman_flag": "Altman distress zone: Z-score of 1.81 or less.",
    "altman_grey": "Altman grey zone: Z-score between 1.81 and 2.99.",
    "revenue_quality_flag": "Revenue quality risk: receivables are high for the revenue.",
    "earnings_quality_flag": "Low earnings quality: over 30% of income is non-operating.",
    "pump_dump_flag": "Pump and dump pattern: volume spike with a steep price rise.",
    "illiquid_flag": "Illiquid stock: very low average volume.",
    "insider_selling_flag": "Insider net selling over the last 12 months.",
    "small_auditor_flag": "Small auditor for a company of this size.",
    "going_concern_flag": "Going concern doubt disclosed.",
}
NO_EXPLANATION = "No major red flags detected."


def explanations() -> Column:
    """Array of sentences; the grey zone speaks only if distress does not."""

    def active(key: str) -> Column:
        if key == "altman_grey":
            return ~flag(c("altman_flag")) & flag(c("altman_zone") == "grey")
        return flag(c(key))

    found = F.array_compact(F.array(*[F.when(active(k), text) for k, text in EXPLANATIONS.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(NO_EXPLANATION))).otherwise(found)


def display_table(report: DataFrame) -> DataFrame:
    """Renamed, rounded columns of the main table."""
    return report.select(
        "cik",
        c("ticker").alias("Ticker"),
        c("risk").alias("Risk"),
        rnd("fraud_score", 1).alias("Score"),
        c("red_flags_count").alias("Flags"),
        flag_codes().alias("Signals"),
        fmt.market_cap("market_cap").alias("Mkt_Cap"),
        rnd("beneish_score", 2).alias("Beneish"),
        rnd("altman_score", 2).alias("Altman_Z"),
        c("name").alias("Company"),
    )


def lookup(report: DataFrame, ticker: str) -> DataFrame:
    """First company with the ticker, in report order."""
    return (
        report.where(c("ticker") == ticker)
        .orderBy(F.coalesce(c("fraud_score"), F.lit(0.0)).desc(), "cik")
        .limit(1)
    )


def score_band(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "high").when(score >= MEDIUM_FROM, "medium").otherwise("none")


def altman_band(zscore: Column) -> Column:
    return F.when(zscore < 1.81, "high").when(zscore < 2.99, "medium").otherwise("none")


def risk_band(risk: Column) -> Column:
    return F.when(risk == HIGH, "high").when(risk == MEDIUM, "medium").otherwise("low")


def spike_band() -> Column:
    return (
        F.when(flag(c("pump_dump_flag")), "red")
        .when(c("volume_spike_ratio") > 2, "amber")
        .otherwise("green")
    )


def price_band() -> Column:
    return F.when(c("price_change_90d") > 0.5, "red").otherwise("green")

