"""Price operators against brute force over small random calendars."""

import datetime as dt
import math
import random
import statistics

import pytest

from conftest import rows_by
from ledgerlynx.operators import market, prices
from pyspark.sql import functions as F

D0 = dt.date(2020, 1, 1)
AS_OF = dt.date(2023, 6, 1)


def make_bars(seed, days, keep, start=D0):
    rng, price, out = random.Random(seed), 100.0, {}
    for i in range(days):
        if rng.random() < keep:
            price = max(0.5, price * (1 + rng.uniform(-0.05, 0.055)))
            out[start + dt.timedelta(days=i)] = round(price, 4)
    return out


SERIES = {
    "DAILY": make_bars(1, 1200, 0.7),
    "SPARSE": make_bars(2, 1200, 0.05),
    "LATE": make_bars(3, 200, 0.9, dt.date(2022, 10, 1)),
    "ZERO": {**make_bars(4, 900, 0.6), dt.date(2021, 3, 3): 0.0},
    "SHORT": {D0 + dt.timedelta(days=i): 10.0 + i for i in range(9)},
}
BENCH = make_bars(9, 1150, 0.8)


def first_on_or_after(bars, d, within):
    hits = [x for x in bars if d <= x < d + dt.timedelta(days=within)]
    return bars[min(hits)] if hits else None


def bench_return(d, days):
    end = d + dt.timedelta(days=days + 5)
    hits = sorted(x for x in BENCH if d <= x < end)
    if len(hits) < 2 or BENCH[hits[0]] <= 0:
        return None
    return (BENCH[hits[-1]] - BENCH[hits[0]]) / BENCH[hits[0]]


def expected(bars, d, strict=False):
    out = dict.fromkeys([*prices.RETURN_COLUMNS, *prices.PRICE_FEATURES])
    entry = first_on_or_after(bars, d, 10)
    for h, days, beat in (("12m", 365, "beat_sp500"), ("24m", 730, "beat_sp500_24m")):
        if d > AS_OF - dt.timedelta(days=days):
            continue
        exit_ = first_on_or_after(bars, d + dt.timedelta(days=days), 10)
        if entry and exit_:
            r, b = (exit_ - entry) / entry, bench_return(d, days)
            out[f"forward_return_{h}"] = r
            out[f"sp500_return_{h}"] = b or None
            out[beat] = b is not None and r > b
            if h == "12m":
                out["entry_price"], out["exit_price"] = entry, exit_
    if strict and entry:
        out["entry_price"] = entry
    entry = out["entry_price"]
    back = dt.timedelta(days=430)
    history = [x for x in bars if d - back <= x < d + dt.timedelta(days=5)]
    past = sorted(x for x in bars if d - back <= x <= d)
    if not entry or len(history) < 30 or not past:
        return out
    closes = [bars[x] for x in past]
    for name, n in prices.MOMENTUM_BARS.items():
        if n < len(closes) and closes[-n - 1] > 0:
            out[name] = (entry - closes[-n - 1]) / closes[-n - 1]
    out["price_to_52w_high"] = entry / max(closes[-252:])
    pairs = list(zip(closes, closes[1:]))
    if all(a > 0 for a, _ in pairs) and len(pairs) >= 20:
        out["vol_prior_12m"] = statistics.stdev(b / a - 1 for a, b in pairs) * math.sqrt(252)
    return out


@pytest.fixture(scope="module")
def frames(spark):
    bars = [(t, d, p, 1000.0) for t, s in SERIES.items() for d, p in s.items()]
    bench = [("B", d, p, 1.0) for d, p in BENCH.items()]
    schema = "ticker string, date date, close double, volume double"
    return spark.createDataFrame(bars, schema), spark.createDataFrame(bench, schema)


@pytest.fixture(scope="module")
def filings(spark):
    rng = random.Random(5)
    rows = [
        (i, t, D0 + dt.timedelta(days=rng.randrange(-20, 1260)))
        for i, t in enumerate(list(SERIES) * 45)
    ]
    return spark.createDataFrame(rows, "cik bigint, ticker string, filed_date date")


@pytest.mark.parametrize("strict", [False, True])
def test_attach_prices_equals_brute_force(frames, filings, strict):
    bars, bench = frames
    got = prices.attach_prices(
        filings, prices.price_days(bars), prices.benchmark_days(bench), AS_OF, strict
    ).collect()
    assert len(got) == 45 * len(SERIES)
    seen = set()
    for r in got:
        want = expected(SERIES[r["ticker"]], r["filed_date"], strict)
        for name, value in want.items():
            where = (r["ticker"], r["filed_date"], name)
            if isinstance(value, float):
                assert r[name] == pytest.approx(value, abs=6e-5), where
                seen.add(name)
            else:
                assert r[name] == value, where
    assert seen >= {"vol_prior_12m", "momentum_12m_prior", "forward_return_24m"}


def test_asof_tolerance(frames, filings):
    bars, _ = frames
    for r in prices.asof_join(filings, bars, "filed_date", "p").collect():
        assert r["p"] == first_on_or_after(SERIES[r["ticker"]], r["filed_date"], 10)


def test_repeated_bars_and_missing_closes(spark, frames, filings):
    bars, bench = frames
    ticker = next(iter(SERIES))
    extra = bars.where(F.col("ticker") == ticker).withColumn("close", F.col("close") / 2)
    holes = extra.withColumn("close", F.lit(None).cast("double"))
    noisy = bars.unionByName(extra).unionByName(holes)
    other = bench.withColumn("ticker", F.lit("ZZZ")).withColumn("close", F.col("close") * 7)
    args = (prices.benchmark_days(bench), AS_OF)
    plain = prices.attach_prices(filings, prices.price_days(bars), *args).collect()
    args = (prices.benchmark_days(bench.unionByName(other)), AS_OF)
    again = prices.attach_prices(filings, prices.price_days(noisy), *args).collect()
    assert sorted(map(str, again)) == sorted(map(str, plain))


def test_an_extreme_bar_leaves_later_windows_alone(spark):
    start = dt.date(2015, 1, 1)
    rng = random.Random(4)
    closes = [100 * (1 + rng.uniform(-0.02, 0.02)) for _ in range(1_500)]
    clean = [("X", start + dt.timedelta(days=i), v) for i, v in enumerate(closes)]
    wild = [(t, d, v * 1e7 if i == 20 else v) for i, (t, d, v) in enumerate(clean)]
    schema = "ticker string, date date, close double"
    day = F.col("day") > F.lit(start + dt.timedelta(days=600))
    a, b = (
        {r["day"]: r["volatility"] for r in prices.price_days(spark.createDataFrame(x, schema)).where(day).collect()}
        for x in (clean, wild)
    )
    assert a == b and all(v > 0 for v in a.values())


def test_pruning_changes_nothing(spark, frames, filings):
    bars, bench = frames
    first = min(r["filed_date"] for r in filings.collect())
    whole = prices.attach_prices(filings, prices.price_days(bars), prices.benchmark_days(bench), AS_OF)
    near = prices.prune_bars(bars, filings, first, AS_OF)
    pruned = prices.attach_prices(filings, prices.price_days(near), prices.benchmark_days(bench), AS_OF)
    assert sorted(map(str, pruned.collect())) == sorted(map(str, whole.collect()))


def test_as_of_never_looks_back(frames):
    days = prices.asof_prices(frames[0]).collect()
    assert len({(r["ticker"], r["day"]) for r in days}) == len(days)
    assert all(0 <= (r["bar_date"] - r["day"]).days < 10 for r in days)


def test_row_order_does_not_matter(frames):
    bars, _ = frames
    a = sorted(map(tuple, prices.price_days(bars).collect()), key=str)
    b = sorted(map(tuple, prices.price_days(bars.repartition(7, "date")).collect()), key=str)
    assert a == b


def test_filings_meet_prices_in_one_equi_join(frames, filings):
    bars, bench = frames
    out = prices.attach_prices(
        filings, prices.price_days(bars), prices.benchmark_days(bench), AS_OF
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Filings are only joined: no window contains their columns.
    assert not [x for x in plan.splitlines() if "Window" in x and "cik" in x]


def test_market_signals(spark):
    as_of = dt.date(2024, 1, 1)
    def series(t, n, volume, close):
        return [(t, as_of - dt.timedelta(days=n - 1 - i), float(close(i)), float(volume(i))) for i in range(n)]
    rows = (
        series("PUMP", 200, lambda i: 100 if i < 170 else 50_000, lambda i: 10 if i < 171 else 10 + (i - 170))
        + series("FEW", 9, lambda i: 1, lambda i: 1)
        + series("MID", 20, lambda i: 20_000, lambda i: 100 + i)
    )
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    short = rows_by(market.market_signals(bars, as_of), "ticker")
    assert set(short) == {"PUMP", "MID"}
    assert short["MID"]["volume_spike_ratio"] == 1.0 and not short["MID"]["illiquid_flag"]
    assert short["MID"]["price_change_90d"] == 0.19
    assert not short["PUMP"]["pump_dump_flag"]  # 90 bars cannot exceed three times
    wide = market.MarketParams(window_days=300)
    long = rows_by(market.market_signals(bars, as_of, wide), "ticker")
    assert long["PUMP"]["pump_dump_flag"] and long["PUMP"]["volume_spike_ratio"] > 3


def test_quotes(spark):
    q = spark.createDataFrame(
        [("A", 0.0, 1.23456, 9.0, 11.0), ("B", 0.0, None, 0.0, 1.0), ("C", 0.0, 1.0, 2.0, 1.0)],
        "ticker string, market_cap double, beta double, bid double, ask double",
    )
    r = rows_by(market.quote_signals(q), "ticker")
    assert (r["A"]["beta"], r["A"]["bid_ask_spread"]) == (1.235, 0.2)
    assert r["B"]["bid_ask_spread"] is None and r["C"]["bid_ask_spread"] is None


def test_price_scan_reads_only_dates_in_reach(spark):
    from ledgerlynx.demo import catalog

    panel = catalog.build_panel(spark, "/root/testdata/sf0.001")
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan" in plan


def test_day_table_has_tasks_for_its_days(spark, monkeypatch):
    # Two bars a year apart stand for 370 days, so few bytes reach the task that spreads them.
    rows = [(f"T{i:03d}", dt.date(2020 + j, 1, 2), 10.0 + j) for i in range(40) for j in range(2)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    monkeypatch.setattr(prices, "DAYS_PER_TASK", 1_000, raising=False)
    days = prices.price_days(bars)
    n = days.count()
    parts = days.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert n >= 40 * 366 and days.rdd.getNumPartitions() >= n // 1_000 and parts < n / 5
