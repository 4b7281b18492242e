"""Skewed inputs give whole results, and plans keep the shape that scales."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows_by
from ledgerlynx import schemas
from ledgerlynx.operators import facts, ordered, prices, scoring
from ledgerlynx.sources import sinks

AS_OF = dt.date(2024, 6, 1)
SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot_facts(spark):
    """A third of all rows belong to one company, concept and year."""
    n = 30_000
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(hot, 7).otherwise(F.col("id") % 500).cast("bigint").alias("cik"),
        F.lit("us-gaap").alias("namespace"),
        F.when(hot, "Assets").otherwise(F.get(F.array(F.lit("Assets"), F.lit("Revenues")), (F.col("id") % 2).cast("int"))).alias("concept"),
        F.lit("USD").alias("unit"), F.lit(True).alias("preferred_unit"), F.lit("10-K").alias("form"),
        F.lit(2023).alias("fy"), F.lit("FY").alias("fp"), F.lit(dt.date(2023, 12, 31)).alias("end"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 50).cast("int")).alias("filed"),
        F.col("id").cast("double").alias("val"), F.lit(None).cast("string").alias("val_text"),
        F.col("id").alias("pos"),
    )


def test_hot_company_is_whole(hot_facts):
    got = rows_by(facts.annual_values(hot_facts, AS_OF), "cik", "concept")
    pdf = hot_facts.toPandas().sort_values(["filed", "pos"], ascending=[False, True])
    want = pdf.groupby(["cik", "concept"]).first()["val"]
    assert {k: r["val"] for k, r in got.items()} == want.to_dict()


def test_shuffle_order_does_not_matter(hot_facts):
    a = facts.annual_financials(facts.annual_values(hot_facts, AS_OF))
    b = facts.annual_financials(facts.annual_values(hot_facts.repartition(5, "pos"), AS_OF))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_panel_needs_two_shuffles_of_facts(hot_facts):
    from ledgerlynx.operators.features import add_yoy

    plan = plan_of(add_yoy(facts.annual_financials(facts.annual_values(hot_facts, AS_OF))))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert "SortAggregate" not in plan


def test_filters_and_columns_reach_a_stored_fact_table(spark, hot_facts, tmp_path):
    path = str(tmp_path / "facts")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    sinks.write_table(hot_facts, path)
    stored = spark.read.schema(schemas.FACTS_LONG).parquet(path)
    plan = plan_of(facts.annual_values(stored, AS_OF))
    pushed = re.search(r"PushedFilters: \[(.*)", plan).group(1)
    for column in ("namespace", "concept", "form", "fp", "fy", "val"):
        assert column in pushed
    assert "val_text" not in plan[plan.index("ReadSchema"):]


def test_hot_filing_day_is_whole(spark):
    """A third of all filings meet one (ticker, day)."""
    bars = spark.createDataFrame(
        [("T", dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i, 1.0) for i in range(0, 900, 3)],
        "ticker string, date date, close double, volume double",
    )
    filings = spark.range(6000).select(
        F.col("id").alias("cik"), F.lit("T").alias("ticker"),
        F.when(F.col("id") % 3 == 0, F.lit(dt.date(2020, 2, 1)))
        .otherwise(F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 600).cast("int")))
        .alias("filed_date"),
    )
    out = prices.asof_join(filings, bars, "filed_date", "p")
    assert out.count() == 6000 and out.where("p IS NULL").count() == 0
    assert out.where("filed_date = DATE'2020-02-01'").select("p").distinct().count() == 1


def test_ranks_when_a_third_ties(spark):
    df = spark.range(9000).select(
        F.col("id").alias("cik"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 100).alias("earnings_yield"),
        F.lit(None).cast("double").alias("return_on_capital"),
    )
    ranked = scoring.magic_ranks(df)
    stats = ranked.agg(F.count_distinct("earnings_yield_rank"), F.max("earnings_yield_rank"),
                       F.count("roc_rank"), F.count("magic_formula_rank")).first()
    assert tuple(stats) == (9000, 9000, 0, 0)
    tied = ranked.where("earnings_yield = 1.0").orderBy("cik").collect()
    ranks = [r["earnings_yield_rank"] for r in tied]
    assert ranks == sorted(ranks)


def test_quantiles_read_only_the_wanted_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).cast("double").alias("v"))
        q = ordered.exact_quantiles(df, "v", [0.5])
        assert re.search(r"_part#\d+ (IN|=)|EqualTo\(_part|In\(_part", plan_of(q))
        values = sorted(i * 7919 % 40_009 for i in range(40_000))
        assert q.first()["quantile"] == (values[19_999] + values[20_000]) / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_panel_writer_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = spark.createDataFrame([(1, 2020, 1.0), (1, 2021, 2.0)], "cik bigint, fiscal_year int, v double")
    sinks.write_panel(rows, path)
    sinks.write_panel(rows.where("fiscal_year = 2021").withColumn("v", F.lit(9.0)), path)
    back = spark.read.parquet(path)
    assert sorted((r["fiscal_year"], r["v"]) for r in back.collect()) == [(2020, 1.0), (2021, 9.0)]
    assert "PartitionFilters: [isnotnull(fiscal_year" in plan_of(back.where("fiscal_year = 2021"))


@pytest.mark.parametrize(
    "name", ["historical_panel", "all_signals", "insider_signals", "going_concern_flag", "upsert", "quartiles"]
)
def test_no_nested_loops_and_no_python_rows(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_text_search_overrides_tagged_going_concern(spark):
    from dataclasses import replace

    from ledgerlynx.demo import tables as t
    from ledgerlynx.operators.facts import stripped_cik
    from ledgerlynx.plans import screening

    inputs = replace(
        t.screen_inputs(spark, SF), filing_texts=t.filing_texts(spark, SF),
        phrase=(t.PHRASE, t.PHRASE_START, t.PHRASE_END),
    )
    fin = screening.enriched_financials(inputs, t.AS_OF)
    hits = {r[0] for r in entry.queries()["phrase_search"](spark, SF).collect()}
    rows = fin.select(stripped_cik(F.col("cik")), "going_concern", "auditor_name").collect()
    assert rows and all(gc == (cik in hits) for cik, gc, _ in rows)
    assert any(name for *_, name in rows)


def test_a_company_document_takes_one_shuffle(spark):
    from ledgerlynx.demo import lifecycle

    plan = plan_of(lifecycle.company_documents(spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
