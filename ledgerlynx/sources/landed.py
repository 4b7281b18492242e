"""Readers for landed documents and tables, and their explosion into rows.

``read_*`` touches storage, ``explode_*`` turns a column of document texts into
rows and can be fed from any source, batch or streaming.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

c = F.col


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold an array of objects, or one object, under an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: (path, doc)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), c("value").alias("doc")
    )


def cik_from_path(path: Column) -> Column:
    """The number in ``.../CIK0000123456.json``."""
    return F.regexp_extract(path, r"CIK0*(\d+)", 1).try_cast("bigint")


def first_rows(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """Source limit in key order; None reads everything."""
    return df if n is None else df.orderBy(*keys).limit(n)


# -- documents to rows --------------------------------------------------------


def explode_directory(docs: DataFrame, doc: str = "doc", page: str | None = None) -> DataFrame:
    """Company directory: positional arrays to (pos, cik, name, ticker, exchange).

    ``page`` names the number of a page (0 up to 2^31) where a directory has several; positions
    then go on from page to page.
    """
    data = F.from_json(doc, schemas.DIRECTORY_DOCUMENT)["data"]
    before = F.lit(0) if page is None else c(page)
    rows = docs.select(before.cast("bigint").alias("page"), F.posexplode(data).alias("pos", "r"))
    return rows.select(
        (F.shiftleft("page", 32) + c("pos") if page else c("pos")).alias("pos"),
        F.get("r", 0).try_cast("bigint").alias("cik"),
        F.get("r", 1).alias("name"),
        F.get("r", 2).alias("ticker"),
        F.get("r", 3).alias("exchange"),
    )


def first_listings(directory: DataFrame) -> DataFrame:
    """One row per company: the first of its listings in the directory's order.

    Share classes are listed under one cik; without this a company would count twice.
    Rows of one directory have distinct positions.
    """
    first = directory.groupBy("cik").agg(F.min("pos").alias("pos"))
    return directory.join(first, ["cik", "pos"], "left_semi")


def unreadable(docs: DataFrame, schema: str, doc: str = "doc") -> DataFrame:
    """Documents that are no JSON object, with all their columns; readers skip these."""
    whole = F.from_json(doc, schema, {"mode": "PERMISSIVE"})
    fields = F.from_json(doc, "map<string,string>")
    return docs.where(F.col(doc).isNull() | whole.isNull() | fields.isNull())


def explode_facts(docs: DataFrame, cik: str = "cik", doc: str = "doc") -> DataFrame:
    """Facts documents to the long fact table.

    ``preferred_unit`` marks the unit the annual panel reads: USD if the list
    exists at all, else shares, else USD/shares.  It is decided on the map, so
    a present but unusable USD list still blocks the fallback.
    """
    facts = F.from_json(doc, schemas.FACTS_DOCUMENT)["facts"]
    namespaces = docs.select(c(cik).alias("cik"), F.explode(facts).alias("namespace", "concepts"))
    concepts = namespaces.select("cik", "namespace", F.explode("concepts").alias("concept", "body"))
    preferred = (
        F.when(F.map_contains_key("body.units", "USD"), "USD")
        .when(F.map_contains_key("body.units", "shares"), "shares")
        .otherwise("USD/shares")
    )
    units = concepts.select(
        "cik", "namespace", "concept", preferred.alias("_preferred"),
        F.explode_outer("body.units").alias("unit", "entries"),
    )
    rows = units.select(
        "cik", "namespace", "concept", "unit",
        F.coalesce(c("unit") == c("_preferred"), F.lit(False)).alias("preferred_unit"),
        F.posexplode_outer("entries").alias("pos", "e"),
    )
    return rows.select(
        "cik", "namespace", "concept", "unit", "preferred_unit",
        c("e.form").alias("form"),
        c("e.fy").alias("fy"),
        F.coalesce(c("e.fp"), F.lit("")).alias("fp"),
        c("e.end").try_cast("date").alias("end"),
        c("e.filed").try_cast("date").alias("filed"),
        c("e.val").try_cast("double").alias("val"),
        c("e.val").alias("val_text"),
        F.coalesce(c("pos"), F.lit(0)).cast("bigint").alias("pos"),
    )


def explode_hits(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Filing-search hits: (cik, name, form, filed); one row per hit."""
    hits = docs.select(
        F.explode(F.from_json(doc, schemas.SEARCH_HITS_DOCUMENT)["hits"]["hits"]).alias("h")
    ).select("h._source.*")
    return hits.select(
        F.replace(F.coalesce(c("entity_id"), F.lit("")), F.lit("CIK"), F.lit("")).alias("cik"),
        F.coalesce(F.get("display_names", 0), F.lit("")).alias("name"),
        F.coalesce(c("file_type"), F.lit("")).alias("form"),
        c("file_date").try_cast("date").alias("filed"),
        "ciks",
    )


def recent_hits(hits: DataFrame, as_of: dt.date, days_back: int = 1) -> DataFrame:
    """Annual and quarterly reports of the last ``days_back`` days."""
    since = as_of - dt.timedelta(days=days_back)
    return hits.where((c("filed") >= F.lit(since)) & c("form").isin("10-K", "10-Q"))


def explode_submissions(docs: DataFrame, cik: str = "cik", doc: str = "doc") -> DataFrame:
    """Parallel arrays to (cik, pos, form, filed, accession).

    Rows beyond the shortest array are dropped, as a zip would.
    """
    recent = F.from_json(doc, schemas.SUBMISSIONS_DOCUMENT)["filings"]["recent"]
    arrays = docs.select(c(cik).alias("cik"), recent.alias("r")).select("cik", "r.*")
    zipped = F.arrays_zip("form", "filingDate", "accessionNumber")
    shortest = F.least(F.size("form"), F.size("filingDate"), F.size("accessionNumber"))
    rows = arrays.select("cik", shortest.alias("_n"), F.posexplode(zipped).alias("pos", "f"))
    return rows.where(c("pos") < c("_n")).select(
        "cik",
        "pos",
        c("f.form").alias("form"),
        c("f.filingDate").try_cast("date").alias("filed"),
        c("f.accessionNumber").alias("accession"),
    )
