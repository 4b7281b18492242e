"""Filing-shaped views derived from generic star-schema tables.

The driver's tables hold no filings, so each view below maps one of them, row
for row or by aggregation, to the shape the operators expect.  All views are
lazy, scan whole tables and grow with them:

=============  ==============================================================
companies      supplier; four neighbouring suppliers share a ticker
facts          lineitem: one tagged fact per line, filed on the ship date
auditor facts  lineitem: one auditor name per line
bars           lineitem per (ticker, day): mean price, summed quantity
benchmark      lineitem per day
quotes         supplier per ticker
form 4         events: one document per event, one filing per user and day
filing texts   documents
=============  ==============================================================
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import GOING_CONCERN_CONCEPTS, PANEL_CONCEPTS
from ..plans.screening import ScreenInputs

AS_OF = dt.date(2001, 11, 4)
EVENTS_AS_OF = dt.date(2024, 1, 31)
YEARS = 6
FLOOR = 1990
PHRASE = "the of"
PHRASE_START, PHRASE_END = dt.date(1998, 3, 1), dt.date(2000, 6, 30)

LINES_PER_TASK = 500_000

SHARES_CONCEPT = "CommonStockSharesOutstanding"
PER_SHARE = [
    "EarningsPerShareBasic", "EarningsPerShareDiluted", "CommonStockDividendsPerShareDeclared",
]
AUDITORS = [
    "Deloitte & Touche LLP", "EY LLP", "PwC LLP", "Grant Thornton LLP", "Smith & Sons CPA",
    "KPMG LLP", "E&Y", "Harbor Point Audit",
]

c = F.col


# Stored schemas, so that building a plan starts no inference job.
TABLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key: str) -> Column:
    return F.concat(F.lit("T"), F.lpad(F.floor(c(key) / 4).cast("string"), 6, "0"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select(
        c("n_nationkey").alias("s_nationkey"), c("n_name").alias("exchange")
    )
    key = c("s_suppkey")
    return supplier.join(nation, "s_nationkey", "left").select(
        key.alias("cik"),
        c("s_name").alias("name"),
        F.when(key % 17 != 5, ticker_of("s_suppkey")).alias("ticker"),
        "exchange",
        F.when(key % 11 == 0, F.lit(None).cast("double"))
        .when(key % 13 == 0, F.lit(0.0))
        .otherwise(c("s_acctbal") * 1e6)
        .alias("market_cap"),
    )


def _filing_columns() -> dict[str, Column]:
    """Form, dates and position of the filing a line item stands for."""
    filed = c("l_shipdate").cast("date")
    form = (
        F.when(c("l_returnflag") == "R", "10-K")
        .when(c("l_returnflag") == "A", "10-K/A")
        .otherwise("10-Q")
    )
    return {
        "cik": c("l_suppkey"),
        "form": form,
        "fy": F.year(F.date_sub(filed, 30)),
        "fp": F.when(form == "10-Q", "Q3").otherwise("FY"),
        "end": F.date_sub(filed, 60),
        "filed": filed,
        "pos": c("l_orderkey") * 8 + c("l_linenumber"),
    }


def _concept() -> Column:
    listed = F.array(*[F.lit(x) for x in PANEL_CONCEPTS])
    return (
        F.when(c("l_partkey") % 4001 == 7, GOING_CONCERN_CONCEPTS[0])
        .when(c("l_partkey") % 4003 == 9, GOING_CONCERN_CONCEPTS[1])
        .otherwise(F.get(listed, (c("l_partkey") % 32).cast("int")))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "lineitem"))


def facts_of(lines: DataFrame) -> DataFrame:
    """Line items, a table or a stream, as facts."""
    f = _filing_columns()
    concept = _concept()
    sign = F.when(c("l_tax") >= 0.07, -1.0).otherwise(1.0)
    scale = (
        F.when(c("concept") == SHARES_CONCEPT, 1000.0)
        .when(c("concept").isin(PER_SHARE), 0.001)
        .otherwise(10000.0)
    )
    unit = (
        F.when(c("concept") == SHARES_CONCEPT, "shares")
        .when(c("concept").isin(PER_SHARE), "USD/shares")
        .otherwise("USD")
    )
    rows = lines.select(
        *[e.alias(n) for n, e in f.items()],
        concept.alias("concept"),
        (sign * c("l_extendedprice")).alias("_amount"),
    )
    val = c("_amount") * scale
    return rows.select(
        "cik", F.lit("us-gaap").alias("namespace"), "concept", unit.alias("unit"),
        F.lit(True).alias("preferred_unit"), "form", "fy", "fp", "end", "filed",
        val.alias("val"), F.lit(None).cast("string").alias("val_text"), "pos",
    )


def auditor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(a) for a in AUDITORS])
    pick = ((c("l_partkey") * 7 + c("l_suppkey")) % 8).cast("int")
    f = _filing_columns()
    return lines.select(
        f["cik"].alias("cik"), F.lit("dei").alias("namespace"), F.lit("AuditorName").alias("concept"),
        F.lit("").alias("unit"), F.lit(False).alias("preferred_unit"),
        *[f[n].alias(n) for n in ("form", "fy", "fp", "end", "filed")],
        F.lit(None).cast("double").alias("val"), F.get(names, pick).alias("val_text"),
        f["pos"].alias("pos"),
    )


def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).unionByName(auditor_facts(spark, sf_dir))


def _mean_price() -> Column:
    # Exact decimal sum: the result does not depend on the order of addition.
    total = F.sum(c("l_extendedprice").cast("decimal(12,2)")).cast("double")
    return total / F.count(F.lit(1)) / 100


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # Most days have one or two lines, so a task that combined its split before the shuffle
    # would hold nearly all of it; the count comes from the files' footers.
    tasks = -(-lines.count() // LINES_PER_TASK) or 1
    keyed = lines.select(
        F.floor(c("l_suppkey") / 4).alias("_t"), c("l_shipdate").cast("date").alias("date"),
        "l_extendedprice", "l_quantity",
    )
    return (
        keyed.repartition(tasks, "_t", "date")
        .groupBy("_t", "date")
        .agg(_mean_price().alias("close"), (F.sum("l_quantity") * 250).alias("volume"))
        .select(
            F.concat(F.lit("T"), F.lpad(c("_t").cast("string"), 6, "0")).alias("ticker"),
            "date", "close", "volume",
        )
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.groupBy(c("l_shipdate").cast("date").alias("date"))
        .agg(_mean_price().alias("close"), F.sum("l_quantity").alias("volume"))
        .select(F.lit("BENCH").alias("ticker"), "date", "close", "volume")
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    low, high = F.min("s_acctbal"), F.max("s_acctbal")
    return supplier.groupBy(ticker_of("s_suppkey").alias("ticker")).agg(
        F.when(high > 5000, high * 1e5).alias("market_cap"),
        F.when(F.max("s_nationkey") < 22, F.sum("s_nationkey") / F.lit(37.0)).alias("beta"),
        (low / 10).alias("bid"),
        (high / 10 - 100).alias("ask"),
    )


def _accession() -> Column:
    return F.concat(
        F.lpad(c("user_id").cast("string"), 10, "0"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")
    )


def form4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks per document: one transaction, one award without a share count."""
    events = table(spark, sf_dir, "events")
    code = F.when(c("event_type") == "purchase", "P").when(c("event_type") == "error", "S").otherwise("A")
    shares = F.rint(c("value") * 100).cast("bigint").cast("string")
    xml = F.concat(
        F.lit("<ownershipDocument>\n<nonDerivativeTransaction>\n<transactionCode>"), code,
        F.lit("</transactionCode>\n<transactionShares> <value>"), shares,
        F.lit("</value></transactionShares>\n</nonDerivativeTransaction>\n"),
        F.lit("<nonDerivativeTransaction><transactionCode>A</transactionCode>"),
        F.lit("</nonDerivativeTransaction></ownershipDocument>"),
    )
    return events.select(
        c("user_id").alias("cik"),
        F.replace(_accession(), F.lit("-"), F.lit("")).alias("accession"),
        xml.alias("xml"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form 4 per user and day, newest first in the feed."""
    days = table(spark, sf_dir, "events").select(
        c("user_id").alias("cik"), c("ts").cast("date").alias("filed"), _accession().alias("accession")
    )
    return days.distinct().select(
        "cik", (F.lit(100_000) - F.unix_date("filed")).alias("pos"),
        F.lit("4").alias("form"), "filed", "accession",
    )


def submission_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, doc): parallel arrays of unequal length, one document per event."""
    day = F.date_format("ts", "yyyy-MM-dd")
    form = F.when(c("event_type") == "signup", "8-K").otherwise("4")
    doc = F.concat(
        F.lit('{"filings":{"recent":{"form":["'), form, F.lit('","4"],"filingDate":["'), day,
        F.lit('","'), day, F.lit('"],"accessionNumber":["'), _accession(), F.lit('"]}}}'),
    )
    return table(spark, sf_dir, "events").select(c("user_id").alias("cik"), doc.alias("doc"))


def hit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing-search responses, one hit each; some hits have no display name."""
    padded = F.lpad(c("user_id").cast("string"), 10, "0")
    names = F.when(c("event_type") == "view", "").otherwise(
        F.concat(F.lit('"User '), c("user_id").cast("string"), F.lit('"'))
    )
    doc = F.concat(
        F.lit('{"hits":{"total":{"value":1},"hits":[{"_source":{"ciks":["'), padded,
        F.lit('"],"entity_id":"CIK'), padded, F.lit('","display_names":['), names,
        F.lit('],"file_type":"'), event_form(), F.lit('","file_date":"'),
        F.date_format("ts", "yyyy-MM-dd"), F.lit('"}}]}}'),
    )
    return table(spark, sf_dir, "events").select(doc.alias("doc"))


def event_form() -> Column:
    return (
        F.when(c("event_type") == "purchase", "10-K")
        .when(c("event_type") == "error", "10-Q")
        .otherwise("8-K")
    )


def facts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, doc): one small facts document per line item, with two units."""
    f = _filing_columns()
    rows = table(spark, sf_dir, "lineitem").select(
        *[e.alias(n) for n, e in f.items()],
        _concept().alias("concept"),
        "l_extendedprice",
        "l_linenumber",
    )
    entry = F.concat(
        F.lit('[{"form":"'), c("form"), F.lit('","fy":'), c("fy").cast("string"), F.lit(',"fp":"'),
        c("fp"), F.lit('","end":"'), c("end").cast("string"), F.lit('","filed":"'),
        c("filed").cast("string"), F.lit('","val":'),
        c("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("}]"),
    )
    # Odd lines carry an empty USD list, which still wins over the shares list.
    usd = F.when(c("l_linenumber") % 2 == 1, F.lit('"USD":[],')).otherwise("")
    doc = F.concat(
        F.lit('{"facts":{"us-gaap":{"'), c("concept"), F.lit('":{"units":{'), usd,
        F.lit('"shares":'), entry, F.lit("}}}}}"),
    )
    return rows.select("cik", doc.alias("doc"))


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cik = F.floor(c("doc_id") / 10).cast("string")
    return docs.select(
        F.array(F.lpad(cik, 10, "0")).alias("ciks"),
        F.when(c("doc_id") % 3 == 0, "10-Q").otherwise("10-K").alias("form"),
        F.date_add(F.lit(dt.date(1998, 1, 1)), (c("doc_id") % 1000).cast("int")).alias("filed"),
        "text",
    )


def screen_inputs(spark: SparkSession, sf_dir: str) -> ScreenInputs:
    return ScreenInputs(
        companies=companies(spark, sf_dir),
        facts=all_facts(spark, sf_dir),
        bars=bars(spark, sf_dir),
        quotes=quotes(spark, sf_dir),
        submissions=submissions(spark, sf_dir),
        form4_documents=form4_documents(spark, sf_dir),
    )
