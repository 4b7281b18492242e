"""Incremental refresh on Structured Streaming.

Facts arrive as a stream, and the newest value of every (company, concept) with its period
end is the stream's keyed state: no batch reads facts again that an earlier one has seen,
and a late filing about an older period changes no value.  Where only notices of filings
arrive, each batch reads the facts of the companies that filed instead.

Either way a batch writes what changed to a change log partitioned by batch id; replaying a
batch overwrites its own partition, so a restart after a lost executor or driver leaves the
same state.  The current company table is merge-on-read, or a versioned table to which each
batch is applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import date_rank_key
from ..operators import facts as facts_ops
from ..operators.enrich import upsert_snapshot
from ..operators.facts import newest_rows
from ..schemas import SNAPSHOT_FIELDS

c = F.col
BATCH = "batch_id"
WATERMARK = "10 days"
FIELDS = [*SNAPSHOT_FIELDS, "going_concern"]


def deduplicated(filings: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Drop repeated notices of one filing; hits carry no accession number."""
    return filings.withWatermark("filed_ts", watermark).dropDuplicatesWithinWatermark(
        ["cik", "form", "filed_ts"]
    )


def refreshed_snapshots(ciks: DataFrame, facts: DataFrame) -> DataFrame:
    """Valid snapshots of the given companies with the newest period end seen."""
    mine = facts.join(ciks.select("cik").distinct(), "cik", "left_semi")
    ends = mine.where(c("form") == "10-K").groupBy("cik").agg(F.max("end").alias("period_end"))
    snap = facts_ops.valid_snapshot(facts_ops.snapshot(mine), need_revenue=False)
    return snap.join(ends, "cik", "left").select("cik", "period_end", *FIELDS)


def start_refresh(
    filings: DataFrame,
    load_facts: Callable[[SparkSession], DataFrame],
    changes_path: str,
    checkpoint: str,
    watermark: str = WATERMARK,
) -> StreamingQuery:
    """Process everything available, then stop.

    ``filings``: streaming (cik bigint, form, filed_ts timestamp).
    ``load_facts`` gives the fact table as it stands when the batch runs.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = refreshed_snapshots(batch, load_facts(spark))
        fresh.write.mode("overwrite").parquet(f"{changes_path}/{BATCH}={batch_id}")

    return (
        deduplicated(filings, watermark)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_fact_refresh(
    facts: DataFrame,
    changes_path: str,
    checkpoint: str,
    apply: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the newest value per (cik, concept) of a stream of facts; process all, then stop.

    The state has one row per company and concept, however many facts arrive.  Every batch
    logs the keys it met with their value after the batch: (cik, concept, val, end).
    ``apply`` gets the same rows, and the batch id, after they are logged.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        path = f"{changes_path}/{BATCH}={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if apply is not None:
            apply(batch.sparkSession.read.schema(batch.schema).parquet(path), batch_id)

    return (
        facts_ops.latest_by_concept(facts)
        .writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_facts(changes: DataFrame) -> DataFrame:
    """(cik, concept, val, end) as the last batch that met a key left it."""
    last = F.max_by(F.struct("val", "end"), BATCH).alias("last")
    return changes.groupBy("cik", "concept").agg(last).select("cik", "concept", "last.val", "last.end")


def logged_snapshots(changes: DataFrame) -> DataFrame:
    """Valid snapshots of all companies in the log of :func:`start_fact_refresh`."""
    wide = facts_ops.wide_snapshot(newest_facts(changes).drop("end").repartition("cik"))
    return facts_ops.valid_snapshot(wide, need_revenue=False).select("cik", *FIELDS)


def newest_changes(changes: DataFrame) -> DataFrame:
    """One change per company: newest period end, then the later batch.

    A late filing about an older period never replaces a newer one.
    """
    order = date_rank_key("period_end", BATCH, later_position_wins=True)
    return newest_rows(changes, order, "cik").select("cik", *FIELDS)


def current_companies(
    base: DataFrame, changes: DataFrame, directory: DataFrame | None = None
) -> DataFrame:
    """Base table with the change log applied; applying it twice changes nothing."""
    return upsert_snapshot(base, newest_changes(changes), directory)


def daily_counts(filings: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Filings per day and form."""
    windowed = filings.withWatermark("filed_ts", watermark).groupBy(
        F.window("filed_ts", "1 day"), "form"
    )
    return windowed.agg(F.count(F.lit(1)).alias("filings")).select(
        F.to_date("window.start").alias("day"), "form", "filings"
    )


def start_daily(
    filings: DataFrame, counts_path: str, checkpoint: str, watermark: str = WATERMARK
) -> StreamingQuery:
    """Log the counts each batch changed; days behind the watermark leave the state."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{counts_path}/{BATCH}={batch_id}")

    return (
        daily_counts(filings, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_counts(counts: DataFrame) -> DataFrame:
    """The count of every day and form as the last batch that changed it left it."""
    return counts.groupBy("day", "form").agg(F.max_by("filings", BATCH).alias("filings"))


def filed_within(filings: DataFrame, as_of_ts, days: int) -> DataFrame:
    """Rows filed in the last ``days`` days before ``as_of_ts``."""
    return filings.where(c("filed_ts") >= F.lit(as_of_ts) - F.make_dt_interval(F.lit(days)))
