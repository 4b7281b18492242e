"""Market signals from recent bars and quotes, per ticker."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flag, nz, rnd, sd


@dataclass(frozen=True)
class MarketParams:
    """Window lengths and thresholds.

    With the default 90-day window the recent mean cannot exceed three times
    the overall mean, so the pump flag needs a longer ``window_days`` to fire.
    """

    window_days: int = 90
    recent_bars: int = 30
    min_bars: int = 10
    min_returns: int = 10
    illiquid_below: float = 10_000
    spike_above: float = 3.0
    pump_above: float = 0.50


def market_signals(bars: DataFrame, as_of: dt.date, params: MarketParams | None = None) -> DataFrame:
    """Volume, price-change, volatility and flag columns per ticker.

    One shuffle: the window and the aggregate share the ticker partitioning,
    and a partition is at most ``window_days`` bars.
    """
    p = params or MarketParams()
    start = as_of - dt.timedelta(days=p.window_days)
    recent = bars.where((F.col("date") > F.lit(start)) & (F.col("date") <= F.lit(as_of)))
    forward = Window.partitionBy("ticker").orderBy("date")
    backward = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    prev = F.lag("close").over(forward)
    marked = recent.withColumns(
        {
            "ret": sd("close", prev) - 1,
            "broken": flag((prev == 0) & (F.col("close") != 0)),
            "from_end": F.row_number().over(backward),
        }
    )
    in_recent = F.col("from_end") <= p.recent_bars
    stats = marked.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg("volume").alias("avg_all"),
        F.avg(F.when(in_recent, F.col("volume"))).alias("avg_recent"),
        F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"),
        F.max(F.when(F.col("from_end") == p.recent_bars, F.col("close"))).alias("recent_close"),
        F.count("ret").alias("returns"),
        F.stddev_samp("ret").alias("deviation"),
        F.bool_or("broken").alias("broken"),
    )
    c = F.col
    long_enough = c("bars") >= p.recent_bars
    spike = sd(F.when(long_enough, c("avg_recent")).otherwise(c("avg_all")), c("avg_all"))
    spike = F.when(c("avg_all") > 0, spike)
    base = F.when(long_enough, c("recent_close")).otherwise(c("first_close"))
    change = F.when(c("first_close") > 0, (c("last_close") - c("first_close")) / nz("first_close"))
    recent_change = F.when(base > 0, (c("last_close") - base) / nz(base))
    volatility = F.when(
        (c("returns") >= p.min_returns) & ~c("broken"), c("deviation") * F.sqrt(F.lit(252.0))
    )
    return stats.where(c("bars") >= p.min_bars).select(
        "ticker",
        rnd("avg_all", 0).alias("avg_volume_90d"),
        rnd(nz(spike), 3).alias("volume_spike_ratio"),
        rnd(change).alias("price_change_90d"),
        flag(c("avg_all") < p.illiquid_below).alias("illiquid_flag"),
        flag((spike > p.spike_above) & (recent_change > p.pump_above)).alias("pump_dump_flag"),
        rnd(volatility).alias("volatility_90d"),
    )


def quote_signals(quotes: DataFrame) -> DataFrame:
    """Beta and relative bid/ask spread per ticker."""
    bid, ask = F.col("bid"), F.col("ask")
    spread = F.when((bid > 0) & (ask > 0) & (ask >= bid), sd(ask - bid, (bid + ask) / 2))
    return quotes.select(
        "ticker", rnd("beta", 3).alias("beta"), rnd(spread).alias("bid_ask_spread")
    )
