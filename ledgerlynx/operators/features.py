"""Panel features: extended ratios and year-over-year changes.

Unlike the value metrics, inputs here are *not* zero-filled: a missing input
makes the ratio missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flag, nz, rnd, sd

# Growth column -> source field.
GROWTH_FIELDS = {
    "revenue_growth_yoy": "revenue",
    "asset_growth_yoy": "total_assets",
    "receivables_growth_yoy": "receivables",
    "inventory_growth_yoy": "inventory",
    "net_income_growth_yoy": "net_income",
    "gross_profit_growth_yoy": "gross_profit",
    "capex_growth_yoy": "capex",
    "ocf_growth_yoy": "operating_cash_flow",
    "shares_dilution": "shares_outstanding",
    "eps_growth_yoy": "eps_diluted",
    "equity_change_yoy": "equity",
    "debt_growth_yoy": "long_term_debt",
    "cash_change_yoy": "cash",
    "rd_growth_yoy": "rd_expense",
    "sga_growth_yoy": "sga_expense",
}
# Delta column -> (numerator, denominator) of the compared ratio.
RATIO_DELTAS = {
    "gross_margin_change": ("gross_profit", "revenue"),
    "operating_margin_change": ("operating_income", "revenue"),
    "net_margin_change": ("net_income", "revenue"),
    "ar_to_revenue_change": ("receivables", "revenue"),
    "asset_turnover_change": ("revenue", "total_assets"),
    "cash_conversion_change": ("operating_cash_flow", "net_income"),
}
YOY_COLUMNS = [*GROWTH_FIELDS, *RATIO_DELTAS]


def add_yoy(panel: DataFrame) -> DataFrame:
    """Add 15 growth rates and 6 ratio deltas against the previous fiscal year.

    Only a row exactly one year earlier counts; after a gap everything is null.
    A partition of the window is one company's fiscal years, a few dozen rows.
    """
    w = Window.partitionBy("cik").orderBy("fiscal_year")
    adjacent = F.col("fiscal_year") - F.lag("fiscal_year").over(w) == 1
    fields = sorted({*GROWTH_FIELDS.values(), *(f for pair in RATIO_DELTAS.values() for f in pair)})
    lagged = panel.withColumns(
        {f"_prev_{f}": F.when(adjacent, F.lag(f).over(w)) for f in fields}
    )

    def growth(field: str) -> Column:
        prev = F.col(f"_prev_{field}")
        return rnd(sd(F.col(field) - prev, F.abs(prev)))

    def delta(num: str, den: str) -> Column:
        return rnd(sd(num, den) - sd(f"_prev_{num}", f"_prev_{den}"))

    return lagged.withColumns(
        {
            **{name: growth(field) for name, field in GROWTH_FIELDS.items()},
            **{name: delta(*pair) for name, pair in RATIO_DELTAS.items()},
        }
    ).drop(*[f"_prev_{f}" for f in fields])


def extended_ratios() -> dict[str, Column]:
    """29 cross-sectional ratios."""
    c = F.col
    rev, ni, oi, ocf = c("revenue"), c("net_income"), c("operating_income"), c("operating_cash_flow")
    ta, ltd, cash, dep = c("total_assets"), c("long_term_debt"), c("cash"), c("depreciation")
    ebitda = oi + dep
    tax = c("tax_expense")
    interest = c("interest_expense")

    def positive(x: Column) -> Column:
        return F.when(x > 0, x)

    return {
        "operating_margin": rnd(sd(oi, rev)),
        "ebitda_margin": rnd(sd(ebitda, rev)),
        "rd_to_revenue": rnd(sd("rd_expense", rev)),
        "sga_to_revenue": rnd(sd("sga_expense", rev)),
        "tax_rate": rnd(sd(tax, ni + tax)),
        "ocf_to_assets": rnd(sd(ocf, ta)),
        "fcf_to_assets": rnd(sd(ocf - c("capex"), ta)),
        "asset_turnover": rnd(sd(rev, ta)),
        "inventory_days": rnd(sd(nz("inventory"), positive(rev) / 365), 1),
        "receivables_turnover": rnd(sd(rev, "receivables")),
        "cash_to_assets": rnd(sd(cash, ta)),
        "cash_to_debt": rnd(sd(cash, positive(ltd))),
        "nwc_to_assets": rnd(sd(c("current_assets") - c("current_liabilities"), ta)),
        "equity_ratio": rnd(sd("equity", ta)),
        "equity_multiplier": rnd(sd(ta, "equity")),
        "liabilities_to_equity": rnd(sd("total_liabilities", "equity")),
        "debt_to_ebitda": rnd(sd(ltd, ebitda)),
        "net_debt_to_ebitda": rnd(sd(ltd - cash, ebitda)),
        "interest_coverage": rnd(sd(oi, positive(interest)), 2),
        "retained_earnings_ratio": rnd(sd("retained_earnings", ta)),
        "capex_to_assets": rnd(sd("capex", ta)),
        "capex_to_revenue": rnd(sd("capex", rev)),
        "capex_intensity": rnd(sd("capex", positive(ocf))),
        "reinvestment_rate": rnd(sd(nz("capex") - nz(dep), positive(oi))),
        "depreciation_to_assets": rnd(sd(dep, ta)),
        "ppe_to_assets": rnd(sd("ppe_net", ta)),
        "cash_conversion": rnd(sd(ocf, positive(ni))),
        "accruals_to_assets": rnd(sd(nz(ni) - nz(ocf), ta)),
        "ev_to_ocf": rnd(sd(nz("market_cap") + ltd - cash, positive(ocf))),
    }


def extended_flags() -> dict[str, Column]:
    """Five derived warnings; never null.  Needs the year-over-year columns."""
    c = F.col
    ni, ocf, rev = c("net_income"), c("operating_cash_flow"), c("revenue")
    return {
        "high_dilution_flag": flag(c("shares_dilution") > 0.05),
        "cash_burning_flag": flag(c("cash_change_yoy") < -0.30),
        "high_rd_flag": flag((rev > 0) & (c("rd_expense") != 0) & (sd("rd_expense", rev) > 0.15)),
        "revenue_vs_ar_flag": flag(
            c("revenue_growth_yoy").isNotNull()
            & (c("receivables_growth_yoy") > 2 * F.greatest(c("revenue_growth_yoy"), F.lit(0.01)))
        ),
        "earnings_ocf_diverge_flag": flag((ni > 0) & (ocf > 0) & (ni > 2 * ocf)),
    }


EXTENDED_COLUMNS = [
    "operating_margin", "ebitda_margin", "rd_to_revenue", "sga_to_revenue", "tax_rate",
    "ocf_to_assets", "fcf_to_assets", "asset_turnover", "inventory_days",
    "receivables_turnover", "cash_to_assets", "cash_to_debt", "nwc_to_assets", "equity_ratio",
    "equity_multiplier", "liabilities_to_equity", "debt_to_ebitda", "net_debt_to_ebitda",
    "interest_coverage", "retained_earnings_ratio", "capex_to_assets", "capex_to_revenue",
    "capex_intensity", "reinvestment_rate", "depreciation_to_assets", "ppe_to_assets",
    "cash_conversion", "accruals_to_assets", "ev_to_ocf",
]
FLAG_COLUMNS = [
    "high_dilution_flag", "cash_burning_flag", "high_rd_flag", "revenue_vs_ar_flag",
    "earnings_ocf_diverge_flag",
]
