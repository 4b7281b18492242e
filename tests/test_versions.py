"""Versioned tables, and the refresh whose state is the newest facts."""

import datetime as dt
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows_by
from ledgerlynx import schemas
from ledgerlynx.operators import facts as facts_ops
from ledgerlynx.sources.versions import KeyedTable
from ledgerlynx.streaming import refresh

DDL = "cik bigint, v double"


def replace(old, fresh):
    return old.join(fresh, "cik", "left_anti").unionByName(fresh)


@pytest.fixture
def held(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), "cik", DDL, buckets=8)
    table.create(spark.range(100).select(F.col("id").alias("cik"), F.lit(0.0).alias("v")))
    return table


def fresh(spark, *ciks, v=1.0):
    return spark.createDataFrame([(k, v) for k in ciks], DDL)


def test_upsert_rewrites_only_its_buckets(spark, held):
    before = held.folders()
    rows = fresh(spark, 3, 500)
    touched = {r[0] for r in rows.select(held.bucket()).collect()}
    seen = []

    def merge(old, new):
        seen.append({r[0] for r in old.select(held.bucket()).distinct().collect()})
        return replace(old, new)

    held.upsert(rows, merge)
    after = held.folders()
    assert seen == [touched & before.keys()]
    assert all((before[b] != after[b]) == (b in touched) for b in before)
    got = rows_by(held.read(), "cik")
    assert len(got) == 101 and got[3]["v"] == got[500]["v"] == 1.0 and got[4]["v"] == 0.0
    assert held.read(version=0).where("v = 1").count() == 0  # the version before stays


def test_two_upserts_and_the_same_again(spark, held):
    held.upsert(fresh(spark, 1, 2), replace)
    held.upsert(fresh(spark, 2, 3, v=2.0), replace)
    once = sorted(map(tuple, held.read().collect()))
    held.upsert(fresh(spark, 2, 3, v=2.0), replace)
    assert sorted(map(tuple, held.read().collect())) == once
    assert dict(once)[1] == 1.0 and dict(once)[2] == dict(once)[3] == 2.0
    assert held.versions() == [0, 1, 2, 3]


def test_crash_before_publishing_changes_nothing(spark, held, monkeypatch):
    def crash(self, folders):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", crash)
        with pytest.raises(RuntimeError):
            held.upsert(fresh(spark, 1), replace)
    assert held.versions() == [0] and held.read().where("v = 1").count() == 0
    # A version whose commit did not finish is not seen either.
    held.upsert(fresh(spark, 1), replace)
    shutil.copytree(f"{held.path}/versions/1", f"{held.path}/versions/2")
    Path(f"{held.path}/versions/2/_SUCCESS").unlink()
    assert held.versions() == [0, 1]


def test_second_writer_of_a_version_fails(spark, held):
    folders = held.folders()
    held._publish(folders)
    with pytest.raises(Exception, match="exist"):
        spark.createDataFrame([(0, "x")], "bucket int, folder string").write.mode("errorifexists").parquet(
            f"{held.path}/versions/1"
        )


def test_expired_versions_take_only_their_own_folders(spark, held):
    held.upsert(fresh(spark, 1), replace)
    held.upsert(fresh(spark, 1, v=2.0), replace)
    want = sorted(map(tuple, held.read().collect()))
    held.expire(keep=1)
    assert held.versions() == [2] and sorted(map(tuple, held.read().collect())) == want


def test_empty_tables(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "none"), "cik", DDL, buckets=4)
    assert table.versions() == [] and table.read().count() == 0
    table.create(spark.createDataFrame([], DDL))
    table.upsert(spark.createDataFrame([], DDL), replace)
    assert table.read().count() == 0
    table.upsert(fresh(spark, 1, None), replace)
    assert table.read().count() == 2


# -- facts as keyed state -----------------------------------------------------


def fact(cik, concept, year, val, form="10-K", filed=None, pos=0):
    end = dt.date(year, 12, 31)
    filed = filed or dt.date(year + 1, 2, 1)
    return (cik, "us-gaap", concept, "USD", True, form, year, "FY", end, filed, val, None, pos)


BATCHES = [
    [fact(1, "Assets", 2022, 10.0), fact(2, "Assets", 2022, 20.0), fact(1, "Revenues", 2022, 3.0)],
    # A late filing about an older period, an amendment that does not count, a new company.
    [fact(1, "Assets", 2020, 7.0), fact(2, "Assets", 2023, 9.0, form="10-K/A"), fact(3, "Assets", 2023, 30.0)],
    [fact(1, "Assets", 2023, 11.0, pos=1), fact(1, "Assets", 2023, 12.0, pos=2), fact(2, "NetIncomeLoss", 2023, 5.0)],
]


def arrive(spark, src, rows):
    spark.createDataFrame(rows, schemas.FACTS_LONG).coalesce(1).write.mode("append").parquet(src)


def run(spark, src, changes, ckpt, apply=None):
    stream = spark.readStream.schema(schemas.FACTS_LONG).parquet(src)
    query = refresh.start_fact_refresh(stream, changes, ckpt, apply)
    query.awaitTermination()
    return query


def same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def batch_snapshot(spark, rows):
    facts = spark.createDataFrame(rows, schemas.FACTS_LONG)
    snap = facts_ops.valid_snapshot(facts_ops.snapshot(facts), need_revenue=False)
    return snap.select("cik", *refresh.FIELDS)


def test_state_equals_a_batch_over_all_facts_and_reads_no_old_file(spark, tmp_path):
    src, changes, ckpt = (str(tmp_path / x) for x in ("src", "changes", "ckpt"))
    for k, rows in enumerate(BATCHES):
        arrive(spark, src, rows)
        run(spark, src, changes, ckpt)
        got = refresh.logged_snapshots(spark.read.parquet(changes))
        assert same_rows(got, batch_snapshot(spark, sum(BATCHES[: k + 1], [])))
        # What has been processed is never read again: empty the folder.
        for file in (tmp_path / "src").glob("*.parquet"):
            file.unlink()
    logged = rows_by(spark.read.parquet(changes), "batch_id", "cik", "concept")
    assert logged[1, 1, "Assets"]["val"] == 10.0  # the late filing changed nothing
    assert logged[2, 1, "Assets"]["val"] == 12.0  # the later position of one filing day
    assert len(spark.read.parquet(changes).where("batch_id = 2").collect()) == 2


def test_refresh_survives_a_crash_between_log_and_table(spark, tmp_path):
    src, changes, ckpt = (str(tmp_path / x) for x in ("src", "changes", "ckpt"))
    fields = ", ".join(f"{f} double" for f in schemas.SNAPSHOT_FIELDS)
    table = KeyedTable(spark, str(tmp_path / "t"), "cik", f"cik bigint, {fields}, going_concern boolean", 4)
    crashes = [True, False, False, True, False]

    def apply(rows, batch_id):
        if crashes.pop(0):
            raise RuntimeError("lost")
        # Companies met by this batch, with all their newest facts from the log.
        log = spark.read.parquet(changes).join(rows.select("cik").distinct(), "cik", "left_semi")
        table.upsert(refresh.logged_snapshots(log), replace)

    for k, rows in enumerate(BATCHES):
        arrive(spark, src, rows)
        while True:
            try:
                run(spark, src, changes, ckpt, apply)
                break
            except Exception as e:  # noqa: BLE001
                assert "lost" in str(e)
        got = table.read().select("cik", *refresh.FIELDS)
        assert same_rows(got, batch_snapshot(spark, sum(BATCHES[: k + 1], [])))
    assert crashes == []


def test_no_batch_scans_the_fact_table(spark, tmp_path):
    src, changes, ckpt = (str(tmp_path / x) for x in ("src", "changes", "ckpt"))
    arrive(spark, src, BATCHES[0])
    query = run(spark, src, changes, ckpt)
    assert query.lastProgress["numInputRows"] == 3
    arrive(spark, src, BATCHES[1])
    query = run(spark, src, changes, ckpt)
    assert query.lastProgress["numInputRows"] == 3  # the new file alone
    states = query.lastProgress["stateOperators"]
    assert [s["numRowsTotal"] for s in states] == [4]  # one row per company and concept
