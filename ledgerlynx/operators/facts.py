"""From long filing facts to wide financials, as-filed and as-restated.

Facts are reduced with ``max_by`` on a fixed-width key instead of a
``row_number`` window: the hash aggregate combines on the map side, so the
shuffle carries one row per (company, concept, year) and no group is ever
sorted in a single task, however many restatements a company has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import date_rank_key, nz

GAAP = "us-gaap"
ANNUAL_FORMS = ("10-K", "10-K/A")

# Concept names per panel field, first name wins.
CONCEPT_ALIASES: dict[str, list[str]] = {
    "revenue": [
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "SalesRevenueNet",
    ],
    "net_income": ["NetIncomeLoss"],
    "operating_income": ["OperatingIncomeLoss"],
    "gross_profit": ["GrossProfit"],
    "tax_expense": ["IncomeTaxExpenseBenefit"],
    "interest_expense": ["InterestExpense", "InterestAndDebtExpense"],
    "rd_expense": ["ResearchAndDevelopmentExpense"],
    "sga_expense": ["SellingGeneralAndAdministrativeExpense"],
    "total_assets": ["Assets"],
    "current_assets": ["AssetsCurrent"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue"],
    "receivables": ["AccountsReceivableNetCurrent"],
    "inventory": ["InventoryNet"],
    "ppe_net": ["PropertyPlantAndEquipmentNet"],
    "total_liabilities": ["Liabilities"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "long_term_debt": ["LongTermDebt", "LongTermDebtNoncurrent"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "equity": ["StockholdersEquity"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"],
    "depreciation": ["DepreciationDepletionAndAmortization", "Depreciation"],
    "total_expenses": ["CostsAndExpenses"],
    "shares_outstanding": ["CommonStockSharesOutstanding"],
    "eps_basic": ["EarningsPerShareBasic"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "dividends_per_share": ["CommonStockDividendsPerShareDeclared"],
}

# Concept per snapshot field (no alias fallback except revenue).
SNAPSHOT_CONCEPTS: dict[str, str] = {
    "net_income": "NetIncomeLoss",
    "gross_profit": "GrossProfit",
    "operating_income": "OperatingIncomeLoss",
    "ebit": "OperatingIncomeLoss",
    "total_assets": "Assets",
    "current_assets": "AssetsCurrent",
    "current_liabilities": "LiabilitiesCurrent",
    "total_liabilities": "Liabilities",
    "long_term_debt": "LongTermDebt",
    "retained_earnings": "RetainedEarningsAccumulatedDeficit",
    "shares_outstanding": "CommonStockSharesOutstanding",
    "receivables": "AccountsReceivableNetCurrent",
    "inventory": "InventoryNet",
    "ppe_net": "PropertyPlantAndEquipmentNet",
    "operating_cash_flow": "NetCashProvidedByUsedInOperatingActivities",
    "capex": "PaymentsToAcquirePropertyPlantAndEquipment",
    "depreciation": "DepreciationDepletionAndAmortization",
}
SNAPSHOT_REVENUE = ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax")

# Presence of either text block means a going-concern doubt.
GOING_CONCERN_CONCEPTS = (
    "SubstantialDoubtAboutGoingConcernTextBlock",
    "GoingConcernDisclosureTextBlock",
)

PANEL_FIELDS = list(CONCEPT_ALIASES)
PANEL_CONCEPTS = [c for names in CONCEPT_ALIASES.values() for c in names]


# -- identifiers --------------------------------------------------------------


def padded_cik(c: Column) -> Column:
    return F.lpad(c.cast("string"), 10, "0")


def stripped_cik(c: Column) -> Column:
    return F.ltrim(c.cast("string"), F.lit("0"))


def plain_accession(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def newest_rows(rows: DataFrame, order: Column, key: str) -> DataFrame:
    """The row of every ``key`` with the greatest ``order``, a BIGINT.

    A text has no fixed-width buffer, so ``max_by`` of one would sort; the key alone is
    hash aggregated and joined back.  ``order`` must differ among the rows of a key.
    """
    keyed = rows.withColumn("_order", order)
    best = keyed.groupBy(key).agg(F.max("_order").alias("_order"))
    return keyed.join(best, [key, "_order"], "left_semi").drop("_order")


# -- current snapshot ---------------------------------------------------------


def latest_values(facts: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """Newest original annual value per (cik, concept, unit).

    Only form 10-K; newest period end wins, the last listed among equal ends.
    """
    rows = facts.where((F.col("namespace") == GAAP) & (F.col("form") == "10-K"))
    if concepts is not None:
        rows = rows.where(F.col("concept").isin(concepts))
    return rows.groupBy("cik", "concept", "unit").agg(
        F.max_by("val", date_rank_key("end", "pos", later_position_wins=True)).alias("val"),
        F.max("end").alias("end"),
    )


def going_concern_flags(facts: DataFrame) -> DataFrame:
    """Per company: does any going-concern text block exist?"""
    hit = (F.col("namespace") == GAAP) & F.col("concept").isin(*GOING_CONCERN_CONCEPTS)
    return facts.groupBy("cik").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("going_concern"))


def latest_by_concept(facts: DataFrame) -> DataFrame:
    """(cik, concept, val, end): the newest annual value of every concept the snapshot needs.

    One hash aggregate keyed by (cik, concept), over a table or over a stream of facts; text
    blocks, and concepts without an annual value, keep a row with nulls.
    """
    concepts = sorted({*SNAPSHOT_CONCEPTS.values(), *SNAPSHOT_REVENUE, *GOING_CONCERN_CONCEPTS})
    wanted = F.when(F.col("concept") == "CommonStockSharesOutstanding", "shares").otherwise("USD")
    text_block = F.col("concept").isin(*GOING_CONCERN_CONCEPTS)
    counts = (F.col("form") == "10-K") & (F.col("unit") == wanted) & ~text_block
    order = F.when(counts, date_rank_key("end", "pos", later_position_wins=True))
    rows = facts.where((F.col("namespace") == GAAP) & F.col("concept").isin(concepts))
    return rows.groupBy("cik", "concept").agg(
        F.max_by("val", order).alias("val"), F.max(F.when(counts, F.col("end"))).alias("end")
    )


def wide_snapshot(latest: DataFrame) -> DataFrame:
    """One row per company from :func:`latest_by_concept`; partitioned by cik alone."""
    text_block = F.col("concept").isin(*GOING_CONCERN_CONCEPTS)

    def pick(concept: str) -> Column:
        return F.max(F.when(F.col("concept") == concept, F.col("val")))

    wide = latest.groupBy("cik").agg(
        *[pick(c).alias(f) for f, c in SNAPSHOT_CONCEPTS.items()],
        *[pick(c).alias(f"_revenue_{i}") for i, c in enumerate(SNAPSHOT_REVENUE)],
        F.bool_or(text_block).alias("going_concern"),
    )
    return wide.withColumn("revenue", F.coalesce(nz("_revenue_0"), F.col("_revenue_1"))).drop(
        "_revenue_0", "_revenue_1"
    )


def snapshot(facts: DataFrame) -> DataFrame:
    """Wide current financials: one row per company with 18 fields and the flag.

    Step one reduces to one row per (cik, concept); step two is partitioned by
    cik alone, at most one row per mapped concept, and needs no further shuffle.
    """
    return wide_snapshot(latest_by_concept(facts).drop("end").repartition("cik"))


def valid_snapshot(df: DataFrame, need_revenue: bool = True) -> DataFrame:
    """Keep companies with assets (and revenue); zero counts as missing."""
    keep = nz("total_assets").isNotNull()
    if need_revenue:
        keep = keep & nz("revenue").isNotNull()
    return df.where(keep)


def latest_auditor(facts: DataFrame) -> DataFrame:
    """Newest auditor name per company from annual filings and amendments."""
    rows = facts.where(
        (F.col("namespace") == "dei")
        & (F.col("concept") == "AuditorName")
        & (F.col("unit") == "")
        & F.col("form").isin(*ANNUAL_FORMS)
    )
    return newest_rows(
        rows, date_rank_key("end", "pos", later_position_wins=True), "cik"
    ).select("cik", F.col("val_text").alias("auditor_name"))


# -- annual panel -------------------------------------------------------------


def fiscal_year_bounds(as_of: dt.date, years: int = 5, floor: int = 2000) -> tuple[int, int]:
    """Inclusive fiscal-year window that moves with ``as_of``."""
    return max(floor, as_of.year - years), as_of.year + 1


def annual_values(
    facts: DataFrame, as_of: dt.date, years: int = 5, floor: int = 2000
) -> DataFrame:
    """Value per (cik, concept, fiscal year) as last filed.

    Amendments supersede: the latest filing date wins, the first listed among
    equal dates.
    """
    lo, hi = fiscal_year_bounds(as_of, years, floor)
    return (
        facts.where(
            (F.col("namespace") == GAAP)
            & F.col("concept").isin(PANEL_CONCEPTS)
            & F.col("form").isin(*ANNUAL_FORMS)
            & (F.col("fp") == "FY")
            & F.col("fy").between(lo, hi)
            & F.col("val").isNotNull()
            & F.col("preferred_unit")
        )
        .groupBy("cik", "concept", F.col("fy").alias("fiscal_year"))
        .agg(
            F.max_by("val", date_rank_key("filed", "pos", later_position_wins=False)).alias("val"),
            F.max("filed").alias("filed"),
        )
    )


def annual_financials(annual: DataFrame) -> DataFrame:
    """One wide row per (cik, fiscal_year): aliases resolved, newest filing date.

    The explicit ``repartition("cik")`` serves this aggregate and every later
    window per company, so the year-over-year step adds no shuffle.  The input
    already holds at most 32 rows per (cik, year), so cik cannot be hot.
    """

    def pick(concept: str) -> Column:
        return F.max(F.when(F.col("concept") == concept, F.col("val")))

    wide = (
        annual.repartition("cik")
        .groupBy("cik", "fiscal_year")
        .agg(
            F.max("filed").alias("filed_date"),
            *[pick(c).alias(f"_{c}") for c in PANEL_CONCEPTS],
        )
    )
    return wide.select(
        "cik",
        "fiscal_year",
        "filed_date",
        *[
            F.coalesce(*[F.col(f"_{c}") for c in names]).alias(field)
            for field, names in CONCEPT_ALIASES.items()
        ],
    )
