"""Composite risk score, red flags, ranks and the flat report."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flag, rnd, sd
from ..functions.formats import NOT_AVAILABLE, fixed
from ..session import materialise
from .ordered import ordinal_ranks
from .signals import flatten_signals

c = F.col

# The twelve booleans counted as red flags.
RED_FLAGS = [
    "beneish_flag", "piotroski_weak", "accruals_flag", "cfd_flag", "altman_flag",
    "revenue_quality_flag", "earnings_quality_flag", "going_concern_flag",
    "small_auditor_flag", "pump_dump_flag", "illiquid_flag", "insider_selling_flag",
]
HIGH, MEDIUM, LOW = "HIGH RISK", "MEDIUM RISK", "LOW RISK"
NO_DATA = "INSUFFICIENT DATA"
HIGH_FROM, MEDIUM_FROM = 70, 45


def _scaled(x: Column, start: float, span: float) -> Column:
    """0..1 severity that saturates at 1."""
    return F.least((x - start) / span, F.lit(1.0))


def _when(cond: Column, points: Column) -> Column:
    return F.when(flag(cond), points).otherwise(0.0)


def composite_terms() -> list[tuple[float, Column, Column]]:
    """(weight, available?, points) per signal, over the flat report columns."""
    zscore, ar, dso = c("altman_score"), c("ar_ratio"), F.coalesce(c("dso"), F.lit(0.0))
    return [
        (20, c("beneish_score").isNotNull(),
         _when(c("beneish_flag"), 20 * (0.5 + 0.5 * _scaled(c("beneish_score"), -1.78, 3)))),
        (10, c("piotroski_score").isNotNull(),
         F.coalesce(10 * (1 - c("piotroski_score") / 9), F.lit(0.0))),
        (10, c("accruals_ratio").isNotNull(),
         _when(c("accruals_flag"), 10 * _scaled(c("accruals_ratio"), 0.0, 0.2))),
        (10, c("cfd_ratio").isNotNull(),
         _when(c("cfd_flag"), 10 * _scaled(c("cfd_ratio"), 0.0, 1.0))),
        # Exactly 1.81 is grey here although the zone column calls it distress.
        (20, zscore.isNotNull(),
         F.when(zscore < 1.81, 20 * F.least((1.81 - zscore) / 3.81, F.lit(1.0)))
         .when(zscore < 2.99, 10 * ((2.99 - zscore) / (2.99 - 1.81))).otherwise(0.0)),
        (10, ar.isNotNull(),
         _when(c("revenue_quality_flag"), 10 * F.greatest(
             _when(ar > 0.25, _scaled(ar, 0.25, 0.5)), _when(dso > 90, _scaled(dso, 90, 270))))),
        (10, c("non_op_ratio").isNotNull(),
         _when(c("earnings_quality_flag"), 10 * _scaled(c("non_op_ratio"), 0.30, 0.70))),
        (10, c("going_concern_flag").isNotNull(), _when(c("going_concern_flag"), F.lit(10.0))),
        (5, c("avg_volume_90d").isNotNull(), _when(c("illiquid_flag"), F.lit(5.0))),
        (5, c("volume_spike_ratio").isNotNull(),
         _when(c("pump_dump_flag"), 5 * (0.5 + 0.5 * _scaled(c("volume_spike_ratio"), 3.0, 7.0)))),
        (5, c("net_insider_shares").isNotNull(), _when(c("insider_selling_flag"), F.lit(5.0))),
        (5, c("auditor_name").isNotNull(), _when(c("small_auditor_flag"), F.lit(5.0))),
    ]


def composite_score() -> Column:
    """0-100 score normalised by the weights of the signals that exist."""
    terms = composite_terms()
    points = reduce(add, [F.when(ok, p).otherwise(0.0) for _, ok, p in terms])
    weights = reduce(add, [F.when(ok, float(w)).otherwise(0.0) for w, ok, _ in terms])
    return rnd(sd(points, weights) * 100, 1)


def risk_label(score: Column) -> Column:
    return (
        F.when(score.isNull(), NO_DATA)
        .when(score >= HIGH_FROM, HIGH)
        .when(score >= MEDIUM_FROM, MEDIUM)
        .otherwise(LOW)
    )


def red_flag_count() -> Column:
    return reduce(add, [flag(c(f)).cast("int") for f in RED_FLAGS])


def score_signals(signals: DataFrame) -> DataFrame:
    """Flat, scored rows without the cross-sectional ranks: no shuffle."""
    flat = flatten_signals(signals)
    scored = flat.withColumns(
        {"fraud_score": composite_score(), "red_flags_count": red_flag_count()}
    )
    return scored.withColumn("risk", risk_label(c("fraud_score")))


def magic_ranks(scored: DataFrame, key: str = "cik") -> DataFrame:
    """Ordinal ranks by earnings yield and return on capital, and their sum.

    Ties are broken by ``key``, which must identify a row: a repeated key fails the job,
    as its rows would share ranks.  The ranks run ``scored`` once more, so hand in a
    stored table.
    """
    again = scored.groupBy(key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][key]} occurs more than once; ranks need one row each")
    ranks = ordinal_ranks(
        scored, key, {"earnings_yield_rank": "earnings_yield", "roc_rank": "return_on_capital"}
    )
    return scored.join(ranks, key, "left").withColumn(
        "magic_formula_rank", c("earnings_yield_rank") + c("roc_rank")
    )


REPORT_COLUMNS = [
    "ticker", "name", "exchange", "market_cap", "fraud_score", "risk", "red_flags_count",
    "beneish_score", "beneish_flag", "piotroski_score", "piotroski_weak", "accruals_ratio",
    "accruals_flag", "cfd_ratio", "cfd_flag", "altman_score", "altman_zone", "altman_flag",
    "ar_ratio", "dso", "revenue_quality_flag", "non_op_ratio", "earnings_quality_flag",
    "going_concern_flag", "auditor_name", "big4_auditor", "small_auditor_flag",
    "avg_volume_90d", "volume_spike_ratio", "price_change_90d", "illiquid_flag",
    "pump_dump_flag", "volatility_90d", "beta", "bid_ask_spread", "net_insider_shares",
    "insider_sale_count", "insider_buy_count", "insider_selling_flag", "pe_ratio", "pb_ratio",
    "ev_ebitda", "fcf_yield", "fcf", "roe", "roa", "gross_margin", "net_margin",
    "debt_to_equity", "current_ratio", "earnings_yield", "return_on_capital",
    "acquirers_multiple", "ncav", "ncav_ratio", "net_net_flag", "gross_profitability", "croic",
    "invested_capital", "market_cap_segment", "earnings_yield_rank", "roc_rank",
    "magic_formula_rank",
]


def order_by_risk(df: DataFrame, *ties: str) -> DataFrame:
    """Most suspicious first; a missing score sorts as 0."""
    return df.orderBy(F.coalesce(c("fraud_score"), F.lit(0.0)).desc(), *(ties or ("cik",)))


def build_report(signals: DataFrame) -> DataFrame:
    """The gold table: 63 flat columns plus the company key.

    The scored rows are stored before ranking: the pipeline behind them runs
    once, and the rank sort then reads three columns of a parquet table.
    """
    scored = materialise(score_signals(signals), "scored")
    return magic_ranks(scored).select("cik", *REPORT_COLUMNS)


def top_suspicious(report: DataFrame, n: int = 20) -> DataFrame:
    return order_by_risk(report).limit(n)


def console_lines(report: DataFrame, n: int = 20) -> DataFrame:
    """The top-n as aligned text lines, most suspicious first."""

    def cell(col: str, digits: int) -> Column:
        return F.when(c(col).isNull(), NOT_AVAILABLE).otherwise(fixed(col, digits))

    def left(x: Column, width: int) -> Column:
        return F.format_string(f"%-{width}s", x)

    def right(x: Column, width: int) -> Column:
        return F.format_string(f"%{width}s", x)

    top = top_suspicious(report, n)
    line = F.concat(
        left(F.coalesce(c("ticker"), F.lit(NOT_AVAILABLE)), 8), F.lit(" "),
        left(c("risk"), 14), F.lit(" "),
        right(cell("fraud_score", 1), 6), F.lit(" "),
        right(cell("beneish_score", 2), 8), F.lit(" "),
        right(cell("altman_score", 2), 8), F.lit(" "),
        right(c("red_flags_count").cast("string"), 6), F.lit("  "),
        F.substring("name", 1, 35),
    )
    return top.select("cik", line.alias("line"))


def risk_tally(report: DataFrame) -> DataFrame:
    """Totals under the report: "low" is what remains, so it includes no-data rows."""
    high = F.count_if(c("risk") == HIGH)
    medium = F.count_if(c("risk") == MEDIUM)
    total = F.count(F.lit(1))
    return report.agg(
        total.alias("companies"),
        high.alias("high_risk"),
        medium.alias("medium_risk"),
        (total - high - medium).alias("low_risk"),
    )
