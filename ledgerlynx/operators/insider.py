"""Insider transactions: submissions feed and transaction documents to a signal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flag
from .facts import plain_accession

NET_SELL_THRESHOLD = 10_000
FILINGS_PER_COMPANY = 20
LOOKBACK_DAYS = 365

# The document patterns.
BLOCK = r"(?s)<nonDerivativeTransaction>(.*?)</nonDerivativeTransaction>"
CODE = r"<transactionCode>([^<]+)</transactionCode>"
SHARES = r"<transactionShares>\s*<value>([^<]+)</value>"


def recent_filings(submissions: DataFrame, as_of: dt.date, days_back: int = LOOKBACK_DAYS) -> DataFrame:
    """Form 4 rows of the last ``days_back`` days; the accession loses its dashes."""
    since = as_of - dt.timedelta(days=days_back)
    return submissions.where(
        (F.col("form") == "4") & (F.col("filed") >= F.lit(since))
    ).withColumn("accession", plain_accession(F.col("accession")))


def newest_per_company(filings: DataFrame, n: int = FILINGS_PER_COMPANY) -> DataFrame:
    """The first ``n`` filings of each company in feed order (``pos``).

    ``row_number() <= n`` becomes a group limit that already prunes on the map
    side, so a company with a flood of filings sends ``n`` rows per task.
    """
    w = Window.partitionBy("cik").orderBy("pos", "accession")
    return filings.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def parse_transactions(documents: DataFrame) -> DataFrame:
    """(cik, accession, code, shares) per complete transaction block of each document."""
    blocks = documents.select(
        "cik", "accession", F.explode(F.regexp_extract_all("xml", F.lit(BLOCK), 1)).alias("block")
    )
    parsed = blocks.select(
        "cik",
        "accession",
        F.trim(F.regexp_extract("block", CODE, 1)).alias("code"),
        F.abs(F.trim(F.regexp_extract("block", SHARES, 1)).try_cast("double")).alias("shares"),
    )
    return parsed.where((F.col("code") != "") & F.col("shares").isNotNull())


def filing_sums(transactions: DataFrame) -> DataFrame:
    """Shares sold and bought per filing, truncated to whole shares."""

    def total(code: str):
        shares = F.sum(F.when(F.col("code") == code, F.col("shares")))
        return F.coalesce(shares, F.lit(0.0)).cast("bigint")

    return transactions.groupBy("cik", "accession").agg(
        total("S").alias("sales"), total("P").alias("purchases")
    )


def insider_signals(filings: DataFrame, sums: DataFrame) -> DataFrame:
    """Company signal over the given filings; companies without filings are absent.

    ``filings`` come from :func:`newest_per_company`.  The counts are numbers of
    filings with a sale / a purchase.
    """
    joined = filings.join(sums, ["cik", "accession"], "left")
    sales = F.coalesce("sales", F.lit(0))
    bought = F.coalesce("purchases", F.lit(0))
    agg = joined.groupBy("cik").agg(
        F.count_if(sales > 0).alias("insider_sale_count"),
        F.count_if(bought > 0).alias("insider_buy_count"),
        (F.sum(bought) - F.sum(sales)).cast("bigint").alias("net_insider_shares"),
    )
    return agg.withColumn(
        "insider_selling_flag",
        flag(
            (F.col("net_insider_shares") < -NET_SELL_THRESHOLD)
            & (F.col("insider_sale_count") > F.col("insider_buy_count"))
        ),
    )
