"""Going-concern search over filing texts and auditor classification."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flag, z
from .facts import stripped_cik

# The searched phrase and the audit-firm name patterns.
GOING_CONCERN_PHRASE = "substantial doubt about its ability to continue"
BIG4 = ["deloitte", "ernst & young", "kpmg", "pricewaterhousecoopers"]
OTHER_MAJOR = [
    "bdo ", "grant thornton", "rsm us", "rsm llp", "mazars", "crowe", "baker tilly",
    "cohnreznick", "moss adams", "plante moran", "cherry bekaert", "forvis", "dixon hughes",
    "eide bailly", "marcum", "citrin", "withum", "weaver", "cbiz", "wipfli", "armanino",
    "friedman", "rkl", "svb alliant", "sensiba", "mgq",
]
LARGE_CAP = 50_000_000


def phrase_ciks(
    texts: DataFrame,
    phrase: str = GOING_CONCERN_PHRASE,
    start: dt.date = dt.date(2021, 1, 1),
    end: dt.date = dt.date(2026, 12, 31),
) -> DataFrame:
    """Distinct stripped CIKs of annual filings whose whole text holds the phrase.

    ``texts``: ciks array<string>, form, filed, text.
    """
    hits = texts.where(
        (F.col("form") == "10-K")
        & F.col("filed").between(F.lit(start), F.lit(end))
        & F.lower("text").contains(phrase.lower())
    )
    listed = hits.select(F.explode("ciks").alias("cik"))
    return listed.select(stripped_cik(F.col("cik")).alias("cik_text")).distinct()


def flag_going_concern(companies: DataFrame, ciks: DataFrame) -> DataFrame:
    """Membership flag; also resets the auditor columns, which this source lacks."""
    marked = ciks.select("cik_text", F.lit(True).alias("_hit"))
    joined = companies.withColumn("cik_text", stripped_cik(F.col("cik"))).join(
        marked, "cik_text", "left"
    )
    return joined.withColumns(
        {
            "going_concern": F.col("_hit").isNotNull(),
            "auditor_name": F.lit(None).cast("string"),
            "big4_auditor": F.lit(False),
            "small_auditor_flag": F.lit(False),
        }
    ).drop("_hit", "cik_text")


def classify_auditor(name: Column, market_cap: Column) -> dict[str, Column]:
    """Big-4 flag and "unknown firm on a larger company" flag.

    The short form of one Big-4 name counts as Big-4, the other only as major.
    """
    n = F.lower(name)

    def any_of(patterns: list[str]) -> Column:
        return reduce(or_, [n.contains(p) for p in patterns])

    bare = F.trim(n)
    big4 = any_of(BIG4) | n.contains("ey llp") | bare.isin("ey", "e&y")
    major = big4 | any_of(OTHER_MAJOR) | n.contains("pwc llp") | (bare == "pwc")
    named = flag(F.length(name) > 0)
    return {
        "big4_auditor": named & flag(big4),
        "small_auditor_flag": named & ~flag(major) & (z(market_cap) > LARGE_CAP),
    }


def auditor_tier(name: Column, big4: Column, small: Column) -> Column:
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "Not available")
        .when(flag(big4), "Big 4")
        .when(flag(small), "Small firm")
        .otherwise("Mid-tier")
    )
