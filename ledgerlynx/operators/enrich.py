"""Joins that enrich, resume and upsert the company table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nz
from ..schemas import SNAPSHOT_FIELDS


def update_columns(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join; a matching right row overwrites ``columns``, else old values stay.

    ``right`` has one row per key.
    """
    fresh = right.select(
        key, F.lit(True).alias("_new"), *[F.col(x).alias(f"_new_{x}") for x in columns]
    )
    joined = left.join(fresh, key, "left")
    hit = F.col("_new").isNotNull()

    def merged(x: str) -> Column:
        old = F.col(x) if x in left.columns else F.lit(None).cast(right.schema[x].dataType)
        return F.when(hit, F.col(f"_new_{x}")).otherwise(old)

    return joined.withColumns({x: merged(x) for x in columns}).drop(
        "_new", *[f"_new_{x}" for x in columns]
    )


def fill_market_cap(companies: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fill only missing (or zero) caps; a missing or zero quote changes nothing."""
    q = quotes.select("ticker", F.col("market_cap").alias("_quote"))
    return (
        companies.join(q, "ticker", "left")
        .withColumn("market_cap", F.coalesce(nz("market_cap"), nz("_quote"), F.col("market_cap")))
        .drop("_quote")
        .select(*companies.columns)
    )


def needs_market() -> Column:
    """Has a ticker and lacks volume or volatility."""
    return _has_ticker() & (F.col("avg_volume_90d").isNull() | F.col("volatility_90d").isNull())


def needs_insider() -> Column:
    return F.col("net_insider_shares").isNull()


def needs_cap() -> Column:
    return nz("market_cap").isNull()


def _has_ticker() -> Column:
    return F.coalesce(F.length("ticker"), F.lit(0)) > 0


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return rows.join(done, key, "left_anti")


def with_defaults(df: DataFrame, defaults: Mapping[str, tuple[str, Any]]) -> DataFrame:
    """Fill absent values (or whole absent columns) with defaults."""
    new = {}
    for name, (dtype, default) in defaults.items():
        value = F.lit(default).cast(dtype)
        new[name] = F.coalesce(F.col(name), value) if name in df.columns else value
    return df.withColumns(new)


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; columns of either side may be missing in the other."""
    return existing.unionByName(new, allowMissingColumns=True)


def upsert_snapshot(
    companies: DataFrame, fresh: DataFrame, directory: DataFrame | None = None
) -> DataFrame:
    """Replace all financial fields of refreshed companies, insert unknown ones.

    Nulls in ``fresh`` also replace; other columns of known companies stay.
    Inserted rows take name, ticker and exchange from ``directory``.
    """
    fields = [*SNAPSHOT_FIELDS, "going_concern"]
    new = fresh.select(
        F.col("cik"), F.lit(True).alias("_new"), *[F.col(f).alias(f"_new_{f}") for f in fields]
    )
    old = companies.withColumn("_old", F.lit(True))
    joined = old.join(new, "cik", "full")
    hit = F.col("_new").isNotNull()
    joined = joined.withColumns(
        {f: F.when(hit, F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    )
    if directory is not None:
        identity = [x for x in ("name", "ticker", "exchange") if x in companies.columns]
        d = directory.select("cik", *[F.col(x).alias(f"_dir_{x}") for x in identity])
        joined = joined.join(d, "cik", "left").withColumns(
            {
                x: F.when(F.col("_old").isNull(), F.col(f"_dir_{x}")).otherwise(F.col(x))
                for x in identity
            }
        )
    return joined.select(*companies.columns)
