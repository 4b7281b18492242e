"""Accounting red-flag signals: one projection per company, no shuffle.

Every builder returns named columns over the snapshot fields.  A flag is
decided on the unrounded number, the stored number is rounded; the composite
score later reads the rounded one.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flag, nz, rnd, sd, z
from .value import VALUE_COLUMNS, value_columns

# Published model constants and thresholds.
BENEISH_BASE = -4.84
BENEISH_THRESHOLD = -1.78
BENEISH_WEIGHTS = {
    "dsri": 0.920, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892,
    "depi": 0.115, "tata": 4.679, "lvgi": -0.327,
}
ALTMAN_WEIGHTS = (1.2, 1.4, 3.3, 0.6, 1.0)
ALTMAN_SAFE = 2.99
ALTMAN_GREY = 1.81
ACCRUALS_THRESHOLD = 0.05
DIVERGENCE_THRESHOLD = 0.25
AR_THRESHOLD = 0.25
DSO_THRESHOLD = 90
NON_OPERATING_THRESHOLD = 0.30

c = F.col


def beneish_components() -> dict[str, Column]:
    """The seven ratios, unrounded; null when their inputs are missing."""
    ta = c("total_assets")
    return {
        "dsri": sd("receivables", "revenue"),
        "gmi": sd("gross_profit", "revenue"),
        "aqi": sd(z(ta) - z("current_assets") - z("ppe_net"), ta),
        "sgi": sd("revenue", ta),
        "depi": sd("depreciation", z("depreciation") + z("ppe_net")),
        "tata": sd(z("net_income") - z("operating_cash_flow"), ta),
        "lvgi": sd(z("long_term_debt") + z("current_liabilities"), ta),
    }


def beneish() -> dict[str, Column]:
    """M-score: null terms are skipped, so the score itself is never null."""
    parts = beneish_components()
    raw = reduce(add, [z(F.lit(w) * parts[k]) for k, w in BENEISH_WEIGHTS.items()],
                 F.lit(BENEISH_BASE))
    names = F.array(*[F.lit(k) for k in parts])
    values = F.array(*[rnd(v) for v in parts.values()])
    return {
        "beneish_score": rnd(raw),
        "beneish_flag": raw > BENEISH_THRESHOLD,
        "beneish_components": F.map_filter(
            F.map_from_arrays(names, values), lambda _, v: v.isNotNull()
        ),
    }


def piotroski_tests() -> dict[str, Column]:
    """Nine 0/1 tests on one period; a missing divisor counts as 1."""
    ni, ocf = z("net_income"), z("operating_cash_flow")
    ta = F.coalesce(nz("total_assets"), F.lit(1.0))
    cl = F.coalesce(nz("current_liabilities"), F.lit(1.0))
    rev = F.coalesce(nz("revenue"), F.lit(1.0))
    tests = {
        "F1_positive_roa": sd(ni, ta) > 0,
        "F2_positive_cfo": ocf > 0,
        "F3_cfo_gt_income": ocf > ni,
        "F4_low_accruals": sd(ocf - ni, ta) > 0,
        "F5_low_leverage": sd(z("long_term_debt"), ta) < 0.4,
        "F6_good_liquidity": sd(z("current_assets"), cl) > 1,
        "F7_no_dilution": F.lit(True),
        "F8_improving_margin": sd(z("gross_profit"), rev) > 0.2,
        "F9_asset_turnover": sd(rev, ta) > 0.5,
    }
    return {k: v.cast("int") for k, v in tests.items()}


def piotroski() -> dict[str, Column]:
    tests = piotroski_tests()
    score = reduce(add, tests.values())
    return {
        "piotroski_score": score,
        "piotroski_weak": score <= 2,
        "piotroski_signals": F.struct(*[v.alias(k) for k, v in tests.items()]),
    }


def accruals() -> dict[str, Column]:
    raw = sd(z("net_income") - z("operating_cash_flow"), "total_assets")
    return {"accruals_ratio": rnd(raw), "accruals_flag": flag(raw > ACCRUALS_THRESHOLD)}


def cash_flow_divergence() -> dict[str, Column]:
    raw = sd(c("net_income") - z("operating_cash_flow"), F.abs(c("net_income")))
    return {"cfd_ratio": rnd(raw), "cfd_flag": flag(raw > DIVERGENCE_THRESHOLD)}


def altman() -> dict[str, Column]:
    """Z-score from at least three of five terms; needs assets."""
    ta = nz("total_assets")
    debt = F.coalesce(
        nz("total_liabilities"), z("long_term_debt") + z("current_liabilities")
    )
    terms = [
        sd(z("current_assets") - z("current_liabilities"), ta),
        sd("retained_earnings", ta),
        sd("operating_income", ta),
        sd(nz("market_cap"), debt),
        sd("revenue", ta),
    ]
    used = reduce(add, [t.isNotNull().cast("int") for t in terms])
    total = reduce(add, [z(F.lit(w) * t) for w, t in zip(ALTMAN_WEIGHTS, terms)])
    raw = F.when(used >= 3, total)
    zone = (
        F.when(raw > ALTMAN_SAFE, "safe")
        .when(raw > ALTMAN_GREY, "grey")
        .when(raw.isNotNull(), "distress")
    )
    return {
        "altman_score": rnd(raw),
        "altman_zone": zone,
        "altman_flag": flag(raw <= ALTMAN_GREY),
    }


def revenue_quality() -> dict[str, Column]:
    ar = sd("receivables", nz("revenue"))
    dso = ar * 365
    return {
        "ar_ratio": rnd(ar),
        "dso": rnd(dso, 1),
        "revenue_quality_flag": flag((ar > AR_THRESHOLD) | (dso > DSO_THRESHOLD)),
    }


def earnings_quality() -> dict[str, Column]:
    raw = sd(c("net_income") - c("operating_income"), F.abs(c("net_income")))
    return {
        "non_op_ratio": rnd(raw),
        "earnings_quality_flag": flag(raw > NON_OPERATING_THRESHOLD),
    }


def accounting_columns(with_parts: bool = False) -> dict[str, Column]:
    """All seven accounting signals as flat columns.

    ``with_parts`` also keeps the component map and the nine tests.
    """
    out: dict[str, Column] = {}
    for build in (beneish, piotroski, accruals, cash_flow_divergence, altman,
                  revenue_quality, earnings_quality):
        out.update(build())
    if not with_parts:
        del out["beneish_components"], out["piotroski_signals"]
    return out


# -- assembly -----------------------------------------------------------------

_IDENTITY = ["cik", "name", "ticker", "exchange", "market_cap", "total_assets", "revenue"]


def assemble_signals(financials: DataFrame) -> DataFrame:
    """Nested signals, one row per company: a single narrow transformation.

    Expects a frame aligned to ``schemas.FINANCIALS``.
    """
    a = accounting_columns(with_parts=True)
    v = value_columns()
    gc = flag(c("going_concern"))

    def pack(**fields: Column) -> Column:
        return F.struct(*[e.alias(n) for n, e in fields.items()])

    return financials.select(
        *_IDENTITY,
        pack(score=a["beneish_score"], manipulator=a["beneish_flag"],
             components=a["beneish_components"]).alias("beneish"),
        pack(score=a["piotroski_score"], weak=a["piotroski_weak"],
             signals=a["piotroski_signals"]).alias("piotroski"),
        pack(ratio=a["accruals_ratio"], red_flag=a["accruals_flag"]).alias("accruals"),
        pack(divergence=a["cfd_ratio"], red_flag=a["cfd_flag"]).alias("cash_flow_divergence"),
        pack(score=a["altman_score"], zone=a["altman_zone"],
             distress=a["altman_flag"]).alias("altman"),
        pack(ar_ratio=a["ar_ratio"], dso=a["dso"],
             red_flag=a["revenue_quality_flag"]).alias("revenue_quality"),
        pack(non_op_ratio=a["non_op_ratio"],
             red_flag=a["earnings_quality_flag"]).alias("earnings_quality"),
        pack(flagged=gc, red_flag=gc).alias("going_concern"),
        pack(auditor_name=c("auditor_name"), big4_auditor=flag(c("big4_auditor")),
             small_auditor_flag=flag(c("small_auditor_flag"))).alias("auditor"),
        pack(avg_volume=c("avg_volume_90d"), volume_spike_ratio=c("volume_spike_ratio"),
             price_change_90d=c("price_change_90d"), illiquid_flag=flag(c("illiquid_flag")),
             pump_dump_flag=flag(c("pump_dump_flag")), volatility_90d=c("volatility_90d"),
             beta=c("beta"), bid_ask_spread=c("bid_ask_spread")).alias("market"),
        pack(net_insider_shares=c("net_insider_shares"),
             insider_sale_count=c("insider_sale_count"),
             insider_buy_count=c("insider_buy_count"),
             insider_selling_flag=flag(c("insider_selling_flag"))).alias("insider"),
        pack(**v).alias("value"),
    )


# Flat report name -> path in the nested signals.
REPORT_PATHS: dict[str, str] = {
    "ticker": "ticker",
    "name": "name",
    "exchange": "exchange",
    "market_cap": "market_cap",
    "beneish_score": "beneish.score",
    "beneish_flag": "beneish.manipulator",
    "piotroski_score": "piotroski.score",
    "piotroski_weak": "piotroski.weak",
    "accruals_ratio": "accruals.ratio",
    "accruals_flag": "accruals.red_flag",
    "cfd_ratio": "cash_flow_divergence.divergence",
    "cfd_flag": "cash_flow_divergence.red_flag",
    "altman_score": "altman.score",
    "altman_zone": "altman.zone",
    "altman_flag": "altman.distress",
    "ar_ratio": "revenue_quality.ar_ratio",
    "dso": "revenue_quality.dso",
    "revenue_quality_flag": "revenue_quality.red_flag",
    "non_op_ratio": "earnings_quality.non_op_ratio",
    "earnings_quality_flag": "earnings_quality.red_flag",
    "going_concern_flag": "going_concern.flagged",
    **{n: f"auditor.{n}" for n in ("auditor_name", "big4_auditor", "small_auditor_flag")},
    "avg_volume_90d": "market.avg_volume",
    **{n: f"market.{n}" for n in (
        "volume_spike_ratio", "price_change_90d", "illiquid_flag", "pump_dump_flag",
        "volatility_90d", "beta", "bid_ask_spread",
    )},
    **{n: f"insider.{n}" for n in (
        "net_insider_shares", "insider_sale_count", "insider_buy_count", "insider_selling_flag",
    )},
    # Enterprise value and EBITDA stay in the nested table only.
    **{n: f"value.{n}" for n in VALUE_COLUMNS if n not in ("ev", "ebitda", "ev_clean")},
}


def flatten_signals(signals: DataFrame, keep_cik: bool = True) -> DataFrame:
    """Nested signals to the flat report columns (before scoring)."""
    keys = ["cik"] if keep_cik else []
    return signals.select(*keys, *[F.col(p).alias(n) for n, p in REPORT_PATHS.items()])
