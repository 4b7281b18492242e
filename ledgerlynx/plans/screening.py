"""The full screen: landed inputs to enriched financials, signals and report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import enrich, facts as facts_ops, governance, insider, market
from ..operators.scoring import build_report
from ..operators.signals import assemble_signals
from ..schemas import align_schema
from ..session import materialise


@dataclass(frozen=True)
class ScreenInputs:
    """Landed tables; all but the first two are optional."""

    companies: DataFrame
    facts: DataFrame
    bars: DataFrame | None = None
    quotes: DataFrame | None = None
    submissions: DataFrame | None = None
    form4_documents: DataFrame | None = None
    filing_texts: DataFrame | None = None
    #: Optional phrase, start and end of the text search.
    phrase: tuple = ()


def base_financials(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Directory x current snapshot, valid companies only, full schema."""
    snap = facts_ops.valid_snapshot(facts_ops.snapshot(facts))
    return align_schema(companies.join(snap, "cik"), schemas.FINANCIALS)


def enrich_market(
    financials: DataFrame,
    bars: DataFrame,
    quotes: DataFrame | None,
    as_of: dt.date,
    params: market.MarketParams | None = None,
) -> DataFrame:
    signals = market.market_signals(bars, as_of, params)
    if quotes is not None:
        signals = signals.join(market.quote_signals(quotes), "ticker", "left")
    columns = [x for x in schemas.MARKET_FIELDS if x in signals.columns]
    return enrich.update_columns(financials, signals, "ticker", columns)


def enrich_insider(
    financials: DataFrame, submissions: DataFrame, documents: DataFrame, as_of: dt.date
) -> DataFrame:
    signals = insider_company_signals(submissions, documents, as_of)
    return enrich.update_columns(financials, signals, "cik", list(schemas.INSIDER_FIELDS))


def insider_company_signals(
    submissions: DataFrame, documents: DataFrame, as_of: dt.date
) -> DataFrame:
    """Insider signals per company; only documents of the filings that count are parsed.

    The newest filings are used twice and stored in between: at most 20 rows per company.
    """
    newest = insider.newest_per_company(insider.recent_filings(submissions, as_of))
    filings = materialise(newest, "newest-filings")
    wanted = documents.join(filings.select("cik", "accession"), ["cik", "accession"], "left_semi")
    sums = insider.filing_sums(insider.parse_transactions(wanted))
    return insider.insider_signals(filings, sums)


def enrich_auditor_names(financials: DataFrame, facts: DataFrame) -> DataFrame:
    """Newest auditor name; the tagged going-concern flag came with the snapshot."""
    return enrich.update_columns(
        financials, facts_ops.latest_auditor(facts), "cik", ["auditor_name"]
    )


def classify_auditors(financials: DataFrame) -> DataFrame:
    """Needs the final market cap."""
    return financials.withColumns(
        governance.classify_auditor(F.col("auditor_name"), F.col("market_cap"))
    )


def override_going_concern(financials: DataFrame, ciks: DataFrame) -> DataFrame:
    """The text search replaces the tagged flag.

    Auditor fields stay, as they come from the facts and not from the search.
    """
    hits = ciks.select("cik_text", F.lit(True).alias("_hit"))
    return (
        financials.withColumn("cik_text", facts_ops.stripped_cik(F.col("cik")))
        .join(hits, "cik_text", "left")
        .withColumn("going_concern", F.col("_hit").isNotNull())
        .drop("_hit", "cik_text")
    )


def enriched_financials(
    inputs: ScreenInputs, as_of: dt.date, base: DataFrame | None = None
) -> DataFrame:
    """All enrichments.  Joins on cik come first and share one partitioning, then ticker.

    ``base`` replaces the snapshot of the facts, as after a refresh.
    """
    fin = base if base is not None else base_financials(inputs.companies, inputs.facts)
    if inputs.submissions is not None and inputs.form4_documents is not None:
        fin = enrich_insider(fin, inputs.submissions, inputs.form4_documents, as_of)
    fin = enrich_auditor_names(fin, inputs.facts)
    if inputs.quotes is not None:
        fin = enrich.fill_market_cap(fin, inputs.quotes)
    if inputs.bars is not None:
        fin = enrich_market(fin, inputs.bars, inputs.quotes, as_of)
    if inputs.filing_texts is not None:
        ciks = governance.phrase_ciks(inputs.filing_texts, *inputs.phrase)
        fin = override_going_concern(fin, ciks)
    return classify_auditors(fin)


def run_screen(
    inputs: ScreenInputs, as_of: dt.date, base: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(financials, signals, report)."""
    fin = enriched_financials(inputs, as_of, base)
    signals = assemble_signals(fin)
    return fin, signals, build_report(signals)
