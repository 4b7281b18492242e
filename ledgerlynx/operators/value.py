"""Value and quality metrics: column expressions over the snapshot fields.

Debt, working-capital parts, depreciation and capex count as 0 when missing;
equity exists only if assets and liabilities both do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import flag, nz, rnd, sd, z

# Upper bounds of the size segments, in dollars.
SEGMENT_BOUNDS = [("micro", 150e6), ("small", 1e9), ("mid", 10e9)]
LARGEST_SEGMENT = "large"
SEGMENTS = ["micro", "small", "mid", "large"]

VALUE_COLUMNS = [
    "pe_ratio", "pb_ratio", "ev", "ebitda", "ev_ebitda", "fcf_yield", "fcf", "roe", "roa",
    "gross_margin", "net_margin", "debt_to_equity", "current_ratio", "ev_clean",
    "earnings_yield", "return_on_capital", "acquirers_multiple", "ncav", "ncav_ratio",
    "net_net_flag", "gross_profitability", "croic", "invested_capital", "market_cap_segment",
]


def segment(cap: Column) -> Column:
    out = F.when(cap.isNull(), F.lit(None).cast("string"))
    for name, bound in SEGMENT_BOUNDS:
        out = out.when(cap < bound, name)
    return out.otherwise(LARGEST_SEGMENT)


def value_columns() -> dict[str, Column]:
    c = F.col
    cap = nz("market_cap")
    ni, oi, ocf = c("net_income"), c("operating_income"), c("operating_cash_flow")
    ta, tl, gp, rev = (
        c("total_assets"), c("total_liabilities"), c("gross_profit"), c("revenue"),
    )
    debt, ca, cl, capex = (
        z("long_term_debt"), z("current_assets"), z("current_liabilities"), z("capex"),
    )
    equity = ta - tl
    cash = F.greatest(F.lit(0.0), ca - z("receivables") - z("inventory"))
    # Zero market cap is a value here and "missing" in the multiple above it.
    ev_any = c("market_cap") + debt - cash
    ev = F.when(cap.isNotNull() & oi.isNotNull(), ev_any)
    ebitda = F.when(cap.isNotNull(), oi + z("depreciation"))
    fcf = F.when(c("market_cap") > 0, ocf - capex)
    ev_clean = F.when(oi.isNotNull(), ev_any)
    operating_capital = F.when(ev_clean.isNotNull(), ca - cl + z("ppe_net"))
    invested = equity + debt
    ncav = F.when(ca != 0, ca - tl)

    def positive(x: Column) -> Column:
        return F.when(x > 0, x)

    out = {
        "pe_ratio": rnd(sd(cap, positive(ni)), 2),
        "pb_ratio": rnd(sd(cap, positive(equity)), 2),
        "ev": rnd(ev, 0),
        "ebitda": rnd(ebitda, 0),
        "ev_ebitda": rnd(sd(ev, positive(ebitda)), 2),
        "fcf_yield": rnd(sd(fcf, "market_cap")),
        "fcf": rnd(fcf, 0),
        "roe": rnd(sd(ni, positive(equity))),
        "roa": rnd(sd(ni, positive(ta))),
        "gross_margin": rnd(sd(gp, positive(rev))),
        "net_margin": rnd(sd(ni, positive(rev))),
        "debt_to_equity": rnd(sd(debt, positive(equity))),
        "current_ratio": rnd(sd(nz(ca), positive(cl)), 2),
        "ev_clean": rnd(ev_clean, 0),
        "earnings_yield": rnd(sd(oi, positive(ev_clean))),
        "return_on_capital": rnd(
            sd(F.when(ev_clean.isNotNull(), oi), positive(operating_capital))
        ),
        "acquirers_multiple": rnd(sd(ev_clean, positive(oi)), 2),
        "ncav": rnd(ncav, 0),
        "ncav_ratio": rnd(sd(cap, positive(ncav)), 2),
        "net_net_flag": flag(cap.isNotNull() & (ncav > 0) & (cap < ncav)),
        "gross_profitability": rnd(sd(gp, positive(ta))),
        "croic": rnd(sd(ocf - capex, positive(invested))),
        "invested_capital": rnd(nz(invested), 0),
        "market_cap_segment": segment(c("market_cap")),
    }
    return {name: out[name] for name in VALUE_COLUMNS}
