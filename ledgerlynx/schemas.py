"""Explicit table schemas (never inferred) and schema alignment."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nested documents as they are landed.
FACT_ENTRY = "struct<form:string,fy:int,fp:string,end:string,filed:string,val:string>"
FACTS_DOCUMENT = (
    "struct<facts:map<string,map<string,struct<units:map<string,array<" + FACT_ENTRY + ">>>>>>"
)
DIRECTORY_DOCUMENT = "struct<data:array<array<string>>>"
SUBMISSIONS_DOCUMENT = (
    "struct<filings:struct<recent:struct<"
    "form:array<string>,filingDate:array<string>,accessionNumber:array<string>>>>"
)
SEARCH_HITS_DOCUMENT = (
    "struct<hits:struct<total:struct<value:bigint>,hits:array<struct<_source:struct<"
    "ciks:array<string>,entity_id:string,display_names:array<string>,"
    "file_type:string,file_date:string>>>>>"
)

FACTS_LONG = (
    "cik bigint, namespace string, concept string, unit string, preferred_unit boolean, "
    "form string, fy int, fp string, end date, filed date, val double, val_text string, pos bigint"
)
PRICES = "ticker string, date date, close double, volume double"
QUOTES = "ticker string, market_cap double, beta double, bid double, ask double"

IDENTITY = ["cik", "name", "ticker", "exchange", "market_cap"]

#: Money and count fields of the current snapshot.
SNAPSHOT_FIELDS = [
    "revenue", "net_income", "gross_profit", "operating_income", "ebit",
    "total_assets", "current_assets", "current_liabilities", "total_liabilities",
    "long_term_debt", "retained_earnings", "shares_outstanding", "receivables",
    "inventory", "ppe_net", "operating_cash_flow", "capex", "depreciation",
]

MARKET_FIELDS = {
    "avg_volume_90d": "double", "volume_spike_ratio": "double", "price_change_90d": "double",
    "illiquid_flag": "boolean", "pump_dump_flag": "boolean", "volatility_90d": "double",
    "beta": "double", "bid_ask_spread": "double",
}
INSIDER_FIELDS = {
    # Both counts are numbers of filings, not of transactions.
    "insider_sale_count": "bigint", "insider_buy_count": "bigint",
    "net_insider_shares": "bigint", "insider_selling_flag": "boolean",
}
AUDITOR_FIELDS = {
    "auditor_name": "string", "big4_auditor": "boolean", "small_auditor_flag": "boolean",
}

FINANCIALS: dict[str, str] = {
    "cik": "bigint", "name": "string", "ticker": "string", "exchange": "string",
    "market_cap": "double", **{f: "double" for f in SNAPSHOT_FIELDS}, "going_concern": "boolean",
    **MARKET_FIELDS, **INSIDER_FIELDS, **AUDITOR_FIELDS,
}

#: Columns older reports may lack, with the value a reader should see.
REPORT_DEFAULTS: dict[str, tuple[str, Any]] = {
    "market_cap": ("double", None),
    **{c: ("double", None) for c in (
        "altman_score", "ar_ratio", "dso", "non_op_ratio", "avg_volume_90d",
        "volume_spike_ratio", "price_change_90d", "volatility_90d", "beta", "bid_ask_spread",
        "pe_ratio", "pb_ratio", "ev_ebitda", "fcf_yield", "fcf", "roe", "roa", "gross_margin",
        "net_margin", "debt_to_equity", "current_ratio", "earnings_yield", "return_on_capital",
        "acquirers_multiple", "ncav", "ncav_ratio", "gross_profitability", "croic",
        "invested_capital",
    )},
    **{c: ("bigint", None) for c in (
        "net_insider_shares", "insider_sale_count", "insider_buy_count",
        "earnings_yield_rank", "roc_rank", "magic_formula_rank",
    )},
    **{c: ("string", None) for c in ("altman_zone", "auditor_name", "market_cap_segment")},
    **{c: ("boolean", False) for c in (
        "altman_flag", "revenue_quality_flag", "earnings_quality_flag", "going_concern_flag",
        "big4_auditor", "small_auditor_flag", "illiquid_flag", "pump_dump_flag",
        "insider_selling_flag", "net_net_flag",
    )},
}


def struct_type(ddl: str) -> T.StructType:
    """DDL text to a StructType."""
    return T.StructType.fromDDL(ddl)


def align_schema(df: DataFrame, schema: Mapping[str, str | tuple[str, Any]]) -> DataFrame:
    """Add missing columns with their defaults and coerce the present ones.

    Values are ``type`` or ``(type, default)``.  Text that is not a number
    becomes null.  Null stays null: a default fills a missing *column* only.
    """
    new = {}
    for name, spec in schema.items():
        dtype, default = spec if isinstance(spec, tuple) else (spec, None)
        if name not in df.columns:
            new[name] = F.lit(default).cast(dtype)
        elif df.schema[name].dataType.simpleString() != dtype:
            new[name] = F.col(name).try_cast(dtype)
    return df.withColumns(new) if new else df
