"""Point-in-time prices: as-of joins, forward returns and momentum.

The as-of tolerance is bounded (10 days), so instead of a range join every bar
is spread over the few calendar days it answers for.  That *day table* has one
row per (ticker, day); all look-backs and look-aheads are computed on it, in
one partitioning by ticker, and filings then meet it in a single equi-join
on (ticker, filed_date).  Filings never enter a window, so a ticker with a huge
number of filings is an ordinary skewed join that AQE can split.  A window
partition is one ticker's calendar; bars without a close are dropped, and of several
bars on one (ticker, date) the one with the highest close stays.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import flag, nz, rnd, sd

TOLERANCE_DAYS = 10
HORIZONS = {"12m": 365, "24m": 730}
BENCHMARK_SLACK_DAYS = 5
LOOKBACK_DAYS = 430
HISTORY_AHEAD_DAYS = 5
MOMENTUM_BARS = {"momentum_12m_prior": 252, "momentum_6m_prior": 126, "momentum_3m_prior": 63}
HIGH_BARS = 252
MIN_HISTORY = 30
MIN_RETURNS = 20
TRADING_DAYS = 252
#: Totals of returns and of their squares; a larger return voids the deviation.
EXACT = "decimal(38,18)"
MAX_RETURN = 1e7
#: Days that one task of the day table sorts, over a kilobyte each for all sorts together.
DAYS_PER_TASK = 250_000

PRICE_FEATURES = [*MOMENTUM_BARS, "price_to_52w_high", "vol_prior_12m"]
RETURN_COLUMNS = [
    "entry_price", "exit_price", "forward_return_12m", "sp500_return_12m", "beat_sp500",
    "forward_return_24m", "sp500_return_24m", "beat_sp500_24m",
]


def price_range(bars: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Bars with date in [start, end)."""
    return bars.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))


def one_bar_per_day(bars: DataFrame) -> DataFrame:
    """(ticker, date, close, prev_date): the day's bar and the date of the one before.

    The windows share the partitioning and order that the look-backs use anyway.
    """
    in_order = Window.partitionBy("ticker").orderBy("date", F.col("close").desc())
    known = bars.where(F.col("close").isNotNull() & F.col("date").isNotNull())
    marked = known.select("ticker", "date", "close", F.lag("date").over(in_order).alias("prev_date"))
    return marked.where(F.col("prev_date").isNull() | (F.col("prev_date") < F.col("date")))


def prune_bars(
    bars: DataFrame, companies: DataFrame, first: dt.date, last: dt.date | None = None
) -> DataFrame:
    """Bars of listed tickers within the dates that filings from ``first`` to ``last`` reach.

    The bounds go to the scan; the look-back and a month of margin lie before ``first``,
    and the as-of tolerance after ``last``.
    """
    since = first - dt.timedelta(days=LOOKBACK_DAYS + 31)
    near = bars.where(F.col("date") >= F.lit(since))
    if last is not None:
        near = near.where(F.col("date") <= F.lit(last + dt.timedelta(days=TOLERANCE_DAYS)))
    return near.join(companies.select("ticker"), "ticker", "left_semi")


def _spread(bars: DataFrame, first_day: Column, *carry: str) -> DataFrame:
    """One row per (ticker, day) from ``first_day`` to the bar.

    Days between two bars belong to the later one, so no day appears twice.
    """
    return bars.select(
        "ticker",
        F.col("date").alias("bar_date"),
        *carry,
        F.explode(F.sequence(first_day, "date", F.expr("interval 1 day"))).alias("day"),
    )


def asof_prices(bars: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """(ticker, day, bar_date, close): the first close on or after each day."""
    first_day = F.greatest(F.date_add("prev_date", 1), F.date_sub("date", tolerance - 1))
    return _spread(one_bar_per_day(bars), first_day, "close")


def asof_join(queries: DataFrame, bars: DataFrame, date: str, name: str) -> DataFrame:
    """Attach the forward as-of close of (ticker, ``date``) as ``name``."""
    days = asof_prices(bars).select("ticker", F.col("day").alias(date), F.col("close").alias(name))
    return queries.join(days, ["ticker", date], "left")


def block_maxima(df: DataFrame, axis: str, value: str, width: int) -> DataFrame:
    """First half of a sliding maximum over ``width`` rows, in linear time.

    A sliding frame would rescan ``width`` rows per row.  Here every row knows
    the maximum from the start of its block (``_up``) and to its end
    (``_down``); a window of ``width`` rows is the tail of one block and the
    head of the next.  ``axis`` numbers the rows of a ticker without gaps.
    ``_block`` grows with it, so windows ordered by (``_block``, axis) reuse the
    sort made here.
    """
    block = Window.partitionBy("ticker", "_block")
    so_far = (Window.unboundedPreceding, 0)
    return (
        df.withColumn("_block", F.floor(F.col(axis) / width))
        .withColumn("_down", F.max(value).over(block.orderBy(F.col(axis).desc()).rowsBetween(*so_far)))
        .withColumn("_up", F.max(value).over(block.orderBy(axis).rowsBetween(*so_far)))
    )


def sliding_max(series: WindowSpec, width: int) -> Column:
    """Second half: combine the two blocks.  ``series`` orders by (``_block``, axis)."""
    full = F.row_number().over(series) >= width
    later_block = F.col("_block") > F.first("_block").over(series)
    begin = (
        F.when(full, F.lag("_down", width - 1).over(series))
        # Before a full window exists, it begins with the first row.
        .when(later_block, F.first("_down").over(series))
    )
    return F.greatest(begin, F.col("_up"))


def _total(value: Column, running: WindowSpec) -> Column:
    exact = F.sum(value.cast(EXACT)).over(running)
    return F.coalesce(exact, F.lit(0).cast(EXACT)).cast(EXACT)


def day_tasks(bars: DataFrame, tolerance: int = TOLERANCE_DAYS) -> int:
    """How many tasks the day table takes, from the first and last bar of every ticker.

    Days come from a few bars inside a task, so what is shuffled does not tell how much a
    task will hold, and adaptive execution would join far too many tickers.
    """
    known = bars.where(F.col("close").isNotNull() & F.col("date").isNotNull())
    ends = known.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = ends.agg(F.sum(F.date_diff("b", "a") + tolerance).alias("n")).first()["n"]
    return -(-(days or 0) // DAYS_PER_TASK) or 1


def price_days(bars: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Everything a filing needs to know about its ticker, per (ticker, day).

    ``entry`` / ``exit_12m`` / ``exit_24m`` look forward; the rest looks back
    from the day.  Bars carry running totals, the days of a ticker are dense
    until its last bar, so every look-back is a difference between
    two rows a fixed distance apart: linear in the number of days.  The totals of
    returns are decimals, so a difference is exact and an extreme bar leaves no trace
    in windows that do not hold it.

    Tasks hold about ``DAYS_PER_TASK`` days whatever the number of tickers; their number is
    counted when the plan is built.
    """
    tasks = day_tasks(bars, tolerance)
    bars = bars.repartition(tasks, "ticker")
    by_date = Window.partitionBy("ticker").orderBy("date")
    prev_close = F.lag("close").over(by_date)
    marked = one_bar_per_day(bars).withColumns(
        {
            "bar_no": F.row_number().over(by_date),
            "ret": sd("close", prev_close) - 1,
            # A rise from zero has no finite return; it voids the deviation.
            "broken": (prev_close == 0) & (F.col("close") != 0),
        }
    )
    marked = marked.withColumn(
        "broken", (F.col("broken") | (F.abs("ret") > MAX_RETURN)).cast("int")
    ).withColumn("ret", F.when(F.abs("ret") <= MAX_RETURN, F.col("ret")))
    marked = block_maxima(marked, "bar_no", "close", HIGH_BARS)
    per_bar = Window.partitionBy("ticker").orderBy("_block", "bar_no")
    running = per_bar.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns(
        {
            # State once this bar is in: totals up to and including it.
            "here": F.struct(
                F.col("bar_no").alias("n"),
                F.count("ret").over(running).alias("n_ret"),
                _total(F.col("ret"), running).alias("s1"),
                _total(F.col("ret") * F.col("ret"), running).alias("s2"),
                F.coalesce(F.sum("broken").over(running), F.lit(0)).alias("broken"),
                sliding_max(per_bar, HIGH_BARS).alias("high"),
                *[F.lag("close", n).over(per_bar).alias(f"lag_{n}") for n in MOMENTUM_BARS.values()],
            ),
        }
    )
    marked = marked.withColumn("before", F.lag("here").over(per_bar))
    # A filing shortly before the first bar still finds it.
    first_day = F.coalesce(F.date_add("prev_date", 1), F.date_sub("date", tolerance - 1))
    on_bar = F.col("day") == F.col("bar_date")
    days = _spread(marked, first_day, "close", "here", "before").select(
        "ticker",
        "day",
        F.unix_date("day").alias("t"),
        F.when(F.date_diff("bar_date", "day") < tolerance, F.col("close")).alias("entry"),
        F.when(on_bar, F.col("close")).alias("bar_close"),
        F.struct(*[F.col(f"here.{x}") for x in ("n", "n_ret", "s1", "s2", "broken")]).alias("next"),
        F.when(on_bar, F.col("here")).otherwise(F.col("before")).alias("last"),
    )
    days = block_maxima(days, "t", "bar_close", LOOKBACK_DAYS + 1)
    axis = Window.partitionBy("ticker").orderBy("_block", "t")
    ahead = axis.rowsBetween(0, HISTORY_AHEAD_DAYS - 1)
    c = F.col
    # First bar of the look-back; its own return lies outside of it.
    looked = days.withColumns(
        {
            **{f"exit_{h}": F.lead("entry", n).over(axis) for h, n in HORIZONS.items()},
            "first": F.lag("next", LOOKBACK_DAYS).over(axis),
            "last_ahead": F.max("last.n").over(ahead),
            "recent_high": sliding_max(axis, LOOKBACK_DAYS + 1),
        }
    )

    def since_first(name: str, start: float) -> Column:
        last = c(f"last.{name}")
        before = F.coalesce(c(f"first.{name}"), F.lit(start).cast(EXACT) if name in ("s1", "s2") else F.lit(start))
        return last - before

    n_past = since_first("n", 1) + 1
    n = since_first("n_ret", 0)
    s1, s2 = (since_first(s, 0.0).cast("double") for s in ("s1", "s2"))
    spread = F.greatest(s2 - s1 * s1 / nz(n), F.lit(0.0)) / nz(n - 1)
    return looked.select(
        "ticker",
        "day",
        "entry",
        *[f"exit_{h}" for h in HORIZONS],
        (c("last_ahead") - F.coalesce(c("first.n"), F.lit(1)) + 1).alias("n_history"),
        n_past.alias("n_past"),
        *[
            F.when(n_past > n_bars, c(f"last.lag_{n_bars}")).alias(f"close_{n_bars}_back")
            for n_bars in MOMENTUM_BARS.values()
        ],
        F.when(n_past <= HIGH_BARS, c("recent_high")).otherwise(c("last.high")).alias("high_52w"),
        F.when(
            (n >= MIN_RETURNS) & (since_first("broken", 0) == 0),
            F.sqrt(spread) * F.sqrt(F.lit(float(TRADING_DAYS))),
        ).alias("volatility"),
    ).repartition(tasks, "ticker", "day")


def benchmark_days(benchmark: DataFrame, series: str | None = None) -> DataFrame:
    """(day, benchmark_12m, benchmark_24m): unrounded benchmark return from each day.

    Between the first close on or after the day and the last close before
    horizon + 5 days; needs two bars and a positive start.  ``benchmark`` has
    the shape of bars; of several series the one named ``series`` is read, by default
    the first by name, so there is one row per day.  The days before its first bar that
    can still reach it are included.
    """
    if series is not None:
        benchmark = benchmark.where(F.col("ticker") == series)
    reach = max(HORIZONS.values()) + BENCHMARK_SLACK_DAYS - 1
    numbered = one_bar_per_day(benchmark).withColumn(
        "n", F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    )
    first_day = F.coalesce(F.date_add("prev_date", 1), F.date_sub("date", reach))
    on_bar = F.col("day") == F.col("bar_date")
    days = _spread(numbered, first_day, "close", "n").select(
        "ticker",
        "day",
        F.unix_date("day").alias("t"),
        F.col("close").alias("start"),
        F.col("n").alias("next_n"),
        F.when(on_bar, F.struct("n", "close")).alias("bar"),
    )
    axis = Window.partitionBy("ticker").orderBy("t")
    # Newest bar on or before each day, and the newest of all for the days past the end.
    days = days.withColumns(
        {
            "last": F.last("bar", ignorenulls=True).over(axis.rowsBetween(Window.unboundedPreceding, 0)),
            "final": F.last("bar", ignorenulls=True).over(
                axis.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )
    for h, n in HORIZONS.items():
        step = n + BENCHMARK_SLACK_DAYS - 1
        inside = F.lead("t", step).over(axis).isNotNull()
        # Past the end of the series its final bar is the newest one.
        days = days.withColumn(
            f"end_{h}", F.when(inside, F.lead("last", step).over(axis)).otherwise(F.col("final"))
        )

    def total_return(h: str) -> Column:
        end = F.col(f"end_{h}")
        enough = end["n"] > F.col("next_n")
        change = (end["close"] - F.col("start")) / nz("start")
        return F.when(enough & (F.col("start") > 0), change)

    returns = days.select(
        "ticker", "day", *[total_return(h).alias(f"benchmark_{h}") for h in HORIZONS]
    )
    # One row per calendar day and series.
    names = [f"benchmark_{h}" for h in HORIZONS]
    first = F.min_by(F.struct(*names), "ticker")
    return returns.groupBy("day").agg(first.alias("b")).select("day", *[f"b.{n}" for n in names])


def attach_prices(
    filings: DataFrame,
    days: DataFrame,
    bench: DataFrame,
    as_of: dt.date,
    pit_strict: bool = False,
) -> DataFrame:
    """Forward returns, benchmark labels and backward features per filing.

    By default the entry price exists only together with a 12-month exit, and
    the backward features depend on it.  ``pit_strict`` always uses the as-of
    entry instead, so young filings keep their features.
    """
    # The benchmark is one series, so one row per calendar day (about 36,500 in a
    # century), whatever the number of companies: small enough to broadcast.
    joined = filings.join(
        days.withColumnRenamed("day", "filed_date"), ["ticker", "filed_date"], "left"
    ).join(F.broadcast(bench.withColumnRenamed("day", "filed_date")), "filed_date", "left")
    c = F.col

    def matured(horizon: int) -> Column:
        return c("filed_date") <= F.lit(as_of - dt.timedelta(days=horizon))

    def has_return(h: str) -> Column:
        return flag(matured(HORIZONS[h]) & (c("entry") > 0) & nz(f"exit_{h}").isNotNull())

    out: dict[str, Column] = {}
    for h, beat in (("12m", "beat_sp500"), ("24m", "beat_sp500_24m")):
        ok = has_return(h)
        forward = (c(f"exit_{h}") - c("entry")) / nz("entry")
        out[f"forward_return_{h}"] = F.when(ok, rnd(forward))
        out[f"sp500_return_{h}"] = F.when(ok, rnd(nz(f"benchmark_{h}")))
        # A missing benchmark reads as "did not beat it".
        out[beat] = F.when(ok, flag(forward > c(f"benchmark_{h}")))
    out["entry_price"] = F.when(
        F.lit(pit_strict) & (c("entry") > 0) | has_return("12m"), rnd("entry")
    )
    out["exit_price"] = F.when(has_return("12m"), rnd("exit_12m"))
    priced = joined.withColumns(out)

    usable = flag((c("entry_price") > 0) & (c("n_history") >= MIN_HISTORY) & (c("n_past") >= 1))

    def momentum(n: int) -> Column:
        past = c(f"close_{n}_back")
        return F.when(usable & (past > 0), rnd((c("entry_price") - past) / nz(past)))

    return priced.withColumns(
        {
            **{name: momentum(n) for name, n in MOMENTUM_BARS.items()},
            "price_to_52w_high": F.when(
                usable & (c("high_52w") > 0), rnd(sd("entry_price", "high_52w"))
            ),
            "vol_prior_12m": F.when(usable, rnd("volatility")),
        }
    ).select(*filings.columns, *RETURN_COLUMNS, *PRICE_FEATURES)


def point_in_time_cap(entry: str, shares: str, current: str) -> Column:
    """Entry price x shares when both are known, else the current market cap."""
    return F.coalesce(nz(entry) * nz(shares), F.col(current))
