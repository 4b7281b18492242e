"""Upserts and the streaming refresh."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows_by
from ledgerlynx import schemas
from ledgerlynx.operators import enrich
from ledgerlynx.streaming import refresh

DDL = ", ".join(f"`{k}` {v}" for k, v in schemas.FINANCIALS.items())


def company(**kw):
    return tuple(kw.get(k) for k in schemas.FINANCIALS)


@pytest.fixture
def base(spark):
    return spark.createDataFrame(
        [company(cik=1, name="One", ticker="A", revenue=5.0, total_assets=9.0, beta=1.1),
         company(cik=2, name="Two", ticker="B", revenue=6.0, total_assets=8.0)], DDL,
    )


def fresh_rows(spark, *rows):
    fields = ["cik", "period_end", "batch_id", *schemas.SNAPSHOT_FIELDS, "going_concern"]
    ddl = "cik bigint, period_end date, batch_id int, " + ", ".join(
        f"{f} double" for f in schemas.SNAPSHOT_FIELDS
    ) + ", going_concern boolean"
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], ddl)


def test_upsert_replaces_inserts_and_is_idempotent(spark, base):
    fresh = fresh_rows(spark, dict(cik=1, total_assets=10.0), dict(cik=3, total_assets=1.0))
    directory = spark.createDataFrame([(3, "Three", "C", "X")], "cik bigint, name string, ticker string, exchange string")
    once = enrich.upsert_snapshot(base, fresh, directory)
    r = rows_by(once, "cik")
    assert r[1]["revenue"] is None and r[1]["total_assets"] == 10.0 and r[1]["beta"] == 1.1
    assert r[2]["revenue"] == 6.0
    assert (r[3]["name"], r[3]["ticker"]) == ("Three", "C")
    twice = enrich.upsert_snapshot(once, fresh, directory)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_newest_change_wins_by_period_not_arrival(spark):
    d = dt.date
    changes = fresh_rows(
        spark,
        dict(cik=1, period_end=d(2023, 12, 31), batch_id=0, revenue=2023.0),
        dict(cik=1, period_end=d(2022, 12, 31), batch_id=1, revenue=2022.0),
        dict(cik=2, period_end=d(2023, 12, 31), batch_id=0, revenue=1.0),
        dict(cik=2, period_end=d(2023, 12, 31), batch_id=1, revenue=2.0),
    )
    r = rows_by(refresh.newest_changes(changes), "cik")
    assert r[1]["revenue"] == 2023.0 and r[2]["revenue"] == 2.0


def test_stream_drops_duplicates_and_equals_batch(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1, 12)
    src, changes, ckpt = (str(tmp_path / x) for x in ("src", "changes", "ckpt"))
    schema = "cik bigint, form string, filed_ts timestamp"
    facts = spark.createDataFrame(
        [(c, "us-gaap", n, "USD", True, "10-K", 2023, "FY", dt.date(2023, 12, 31), dt.date(2024, 1, 1), v, None, 0)
         for c, n, v in [(1, "Assets", 10.0), (2, "Assets", 20.0), (3, "Assets", 30.0), (2, "Revenues", 5.0)]],
        schemas.FACTS_LONG,
    )

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        refresh.start_refresh(stream, lambda s: facts, changes, ckpt).awaitTermination()

    run([(1, "10-K", ts), (1, "10-K", ts), (2, "10-K", ts)])
    first = spark.read.parquet(changes)
    assert sorted(r["cik"] for r in first.collect()) == [1, 2]
    # A repeated notice inside the watermark brings nothing new, a new company does.
    run([(1, "10-K", ts), (3, "10-Q", ts + dt.timedelta(hours=1))])
    applied = rows_by(refresh.newest_changes(spark.read.parquet(changes)), "cik")
    batch = rows_by(refresh.refreshed_snapshots(facts.select("cik"), facts), "cik")
    assert set(applied) == set(batch) == {1, 2, 3}
    assert all(applied[k]["total_assets"] == batch[k]["total_assets"] for k in batch)
    assert sum(r["cik"] == 1 for r in spark.read.parquet(changes).collect()) == 1


def test_enrichment_joins(spark, base):
    quotes = spark.createDataFrame([("A", 7.0), ("B", 0.0)], "ticker string, market_cap double")
    r = rows_by(enrich.fill_market_cap(base, quotes), "cik")
    assert r[1]["market_cap"] == 7.0 and r[2]["market_cap"] is None
    new = spark.createDataFrame([("A", None, 3.0)], "ticker string, beta double, volatility_90d double")
    u = rows_by(enrich.update_columns(base, new, "ticker", ["beta", "volatility_90d"]), "cik")
    assert u[1]["beta"] is None and u[1]["volatility_90d"] == 3.0 and u[2]["beta"] is None
    assert base.where(enrich.needs_market()).count() == 2
    done = spark.createDataFrame([(1,)], "cik bigint")
    assert [x["cik"] for x in enrich.not_done(base, done, "cik").collect()] == [2]
    filled = enrich.with_defaults(base, {"going_concern": ("boolean", False), "extra": ("int", 4)})
    assert filled.where("going_concern = false AND extra = 4").count() == 2
    both = enrich.append_rows(base.select("cik"), base.select("cik", F.lit(1).alias("x")))
    assert both.count() == 4 and both.where("x IS NULL").count() == 2


def test_filed_within_and_daily_counts(spark):
    t = dt.datetime
    rows = [(1, "10-K", t(2024, 1, 1, 3)), (2, "10-K", t(2024, 1, 1, 23)), (3, "10-Q", t(2024, 1, 5))]
    filings = spark.createDataFrame(rows, "cik bigint, form string, filed_ts timestamp")
    near = refresh.filed_within(filings, t(2024, 1, 5), 3)
    assert [r["cik"] for r in near.collect()] == [3]
    days = {(str(r["day"]), r["form"]): r["filings"] for r in refresh.daily_counts(filings).collect()}
    assert days == {("2024-01-01", "10-K"): 2, ("2024-01-05", "10-Q"): 1}


def test_notice_beyond_the_watermark_is_dropped(spark, tmp_path):
    src, changes, ckpt = (str(tmp_path / x) for x in ("src", "changes", "ckpt"))
    schema = "cik bigint, form string, filed_ts timestamp"
    facts = spark.createDataFrame(
        [(k, "us-gaap", "Assets", "USD", True, "10-K", 2023, "FY", dt.date(2023, 12, 31), dt.date(2024, 1, 1), 1.0, None, 0)
         for k in (1, 2, 3)], schemas.FACTS_LONG,
    )
    for rows in (
        [(1, "10-K", dt.datetime(2024, 3, 1))],
        [(2, "10-K", dt.datetime(2024, 1, 1)), (3, "10-K", dt.datetime(2024, 2, 27))],
    ):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        refresh.start_refresh(stream, lambda s: facts, changes, ckpt).awaitTermination()
    assert sorted(r["cik"] for r in spark.read.parquet(changes).collect()) == [1, 3]
