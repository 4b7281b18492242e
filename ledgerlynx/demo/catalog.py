"""Every operator as a named query over the driver's tables, with its SQL oracle.

Report, financials and panel are the stored gold tables of the lifecycle:
``report`` and ``historical_panel`` build them from the raw tables, the screens
and statistics read the stored copy, as their users would.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import formats as fmt
from ..functions import rnd
from ..operators import (
    enrich,
    facts as facts_ops,
    features,
    governance,
    insider,
    market,
    model,
    prices,
    scoring,
    screens,
    signals,
    stats,
    value,
)
from ..plans import panel as panel_plan
from ..plans import screening
from ..session import materialise, new_folder
from ..sources import landed, sinks
from ..streaming import refresh
from . import oracle as o
from . import tables as t

c = F.col
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_stored: dict[tuple[str, str, str], DataFrame] = {}


def _gold(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = materialise(build(spark, sf_dir), name)
    return _stored[key]


# -- builders -----------------------------------------------------------------


def build_financials(spark: SparkSession, d: str) -> DataFrame:
    return screening.enriched_financials(t.screen_inputs(spark, d), t.AS_OF)


def build_report(spark: SparkSession, d: str) -> DataFrame:
    return screening.run_screen(t.screen_inputs(spark, d), t.AS_OF)[2]


def build_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel_plan.build_panel(
        t.companies(spark, d), t.facts(spark, d), t.bars(spark, d), t.benchmark(spark, d),
        t.AS_OF, t.YEARS, t.FLOOR,
    )


def financials(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d, "financials", build_financials)


def report(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d, "report", build_report)


def panel(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d, "panel", build_panel)


def annual(spark: SparkSession, d: str) -> DataFrame:
    return facts_ops.annual_values(t.facts(spark, d), t.AS_OF, t.YEARS, t.FLOOR)


def counted(*columns: str) -> list[Column]:
    """Integer columns as BIGINT, the type SQL counts have."""
    return [c(x).cast("bigint").alias(x) for x in columns]


def names(*columns: str) -> str:
    return ", ".join(columns)


def big(*columns: str) -> str:
    return ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in columns)


# == sources and sinks ========================================================


@register(
    "company_directory",
    o.query(
        "SELECT s_suppkey AS cik, s_name AS name, 'T' || s_nationkey AS ticker, n_name AS exchange "
        "FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    ),
)
def _(spark, d):
    nation = t.table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    docs = t.table(spark, d, "supplier").join(nation, "s_nationkey").select(
        F.concat(
            F.lit('{"data":[['), c("s_suppkey").cast("string"), F.lit(',"'), c("s_name"),
            F.lit('","T'), c("s_nationkey").cast("string"), F.lit('","'), c("n_name"), F.lit('"]]}'),
        ).alias("doc")
    )
    return landed.explode_directory(docs).drop("pos")


@register(
    "json_facts",
    o.query(
        "SELECT concept, CASE WHEN pos % 8 % 2 = 0 THEN true ELSE false END AS preferred_unit, form, "
        "count(*) AS facts, CAST(sum(CAST(abs(amount) AS DECIMAL(12,2))) AS DOUBLE) AS total, "
        "max(filed) AS newest FROM fa GROUP BY ALL",
        "fa",
    ),
)
def _(spark, d):
    rows = landed.explode_facts(t.facts_documents(spark, d)).where(c("unit") == "shares")
    return (
        rows.where(c("val").isNotNull())
        .groupBy("concept", "preferred_unit", "form")
        .agg(
            F.count(F.lit(1)).alias("facts"),
            F.sum(c("val").cast("decimal(12,2)")).cast("double").alias("total"),
            F.max("filed").alias("newest"),
        )
    )


@register(
    "hits_recent",
    f"""SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS cik,
  CASE WHEN event_type = 'view' THEN '' ELSE 'User ' || user_id END AS name,
  CASE event_type WHEN 'purchase' THEN '10-K' ELSE '10-Q' END AS form, CAST(ts AS DATE) AS filed
FROM events WHERE event_type IN ('purchase', 'error')
  AND CAST(ts AS DATE) >= DATE '{t.EVENTS_AS_OF}' - 20""",
)
def _(spark, d):
    hits = landed.explode_hits(t.hit_documents(spark, d))
    return landed.recent_hits(hits, t.EVENTS_AS_OF, 20).select("cik", "name", "form", "filed")


@register(
    "submissions_rows",
    f"""SELECT user_id AS cik, {o._ACC} AS accession, CAST(ts AS DATE) AS filed, count(*) AS documents
FROM events WHERE event_type <> 'signup' AND CAST(ts AS DATE) >= DATE '{t.EVENTS_AS_OF}' - 14
GROUP BY ALL""",
)
def _(spark, d):
    rows = landed.explode_submissions(t.submission_documents(spark, d))
    recent = insider.recent_filings(rows, t.EVENTS_AS_OF, days_back=14)
    return recent.groupBy("cik", "accession", "filed").agg(F.count(F.lit(1)).alias("documents"))


@register(
    "price_range",
    o.query(
        "SELECT * FROM ba WHERE date >= DATE '1998-01-01' AND date < DATE '1998-07-01'", "ba"
    ),
)
def _(spark, d):
    return prices.price_range(t.bars(spark, d), dt.date(1998, 1, 1), dt.date(1998, 7, 1))


@register(
    "quote_snapshot",
    o.query(
        "SELECT co.cik, co.ticker, qu.market_cap, qu.beta FROM co LEFT JOIN qu ON co.ticker = qu.ticker",
        "co", "qu",
    ),
)
def _(spark, d):
    q = t.quotes(spark, d).select("ticker", "market_cap", "beta")
    return t.companies(spark, d).drop("market_cap").join(q, "ticker", "left").select(
        "cik", "ticker", "market_cap", "beta"
    )


@register("source_limit", o.query("SELECT * FROM co ORDER BY cik LIMIT 10", "co"))
def _(spark, d):
    return landed.first_rows(t.companies(spark, d), 10, "cik")


@register("json_roundtrip", o.query("SELECT * FROM co", "co"))
def _(spark, d):
    path = new_folder(spark, "companies-json")
    sinks.write_json(t.companies(spark, d), path)
    schema = "cik bigint, name string, ticker string, exchange string, market_cap double"
    return spark.read.schema(schema).json(path)


@register(
    "panel_roundtrip",
    o.query(
        "SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, filed_date, revenue, total_assets "
        "FROM aw WHERE fiscal_year BETWEEN 1997 AND 1999", "aw",
    ),
)
def _(spark, d):
    path = new_folder(spark, "panel-parquet")
    sinks.write_panel(
        facts_ops.annual_financials(annual(spark, d)).select(
            "cik", "fiscal_year", "filed_date", "revenue", "total_assets"
        ),
        path,
    )
    back = landed.read_table(spark, path).where(c("fiscal_year").between(1997, 1999))
    return back.select("cik", *counted("fiscal_year"), "filed_date", "revenue", "total_assets")


@register(
    "schema_aligned",
    o.query(
        "SELECT cik, try_cast(CASE WHEN cik % 2 = 0 THEN name ELSE CAST(cik AS VARCHAR) END AS DOUBLE) "
        "AS market_cap, CAST(NULL AS DOUBLE) AS beta, false AS illiquid_flag FROM co", "co",
    ),
)
def _(spark, d):
    raw = t.companies(spark, d).select(
        "cik",
        F.when(c("cik") % 2 == 0, c("name")).otherwise(c("cik").cast("string")).alias("market_cap"),
    )
    wanted = {k: schemas.REPORT_DEFAULTS[k] for k in ("market_cap", "beta", "illiquid_flag")}
    return schemas.align_schema(raw, wanted)


# == facts ====================================================================


@register(
    "facts_latest_filed",
    o.query("SELECT cik, concept, CAST(fiscal_year AS BIGINT) AS fiscal_year, val, filed FROM an", "an"),
)
def _(spark, d):
    return annual(spark, d).select("cik", "concept", *counted("fiscal_year"), "val", "filed")


@register(
    "facts_alias_resolved",
    o.query(
        "SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, field, val FROM "
        f"(UNPIVOT aw ON {names(*facts_ops.PANEL_FIELDS)} INTO NAME field VALUE val)", "aw",
    ),
)
def _(spark, d):
    wide = facts_ops.annual_financials(annual(spark, d))
    long = wide.unpivot(["cik", "fiscal_year"], facts_ops.PANEL_FIELDS, "field", "val")
    return long.where(c("val").isNotNull()).select("cik", *counted("fiscal_year"), "field", "val")


@register(
    "facts_filed_date",
    o.query("SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, filed_date FROM aw", "aw"),
)
def _(spark, d):
    wide = facts_ops.annual_financials(annual(spark, d))
    return wide.select("cik", *counted("fiscal_year"), "filed_date")


@register(
    "snapshot_wide",
    o.query(
        f"SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, {names(*facts_ops.PANEL_FIELDS)} FROM aw",
        "aw",
    ),
)
def _(spark, d):
    wide = facts_ops.annual_financials(annual(spark, d))
    return wide.select("cik", *counted("fiscal_year"), *facts_ops.PANEL_FIELDS)


@register(
    "latest_value",
    o.query("SELECT cik, concept, unit, val, end_date AS period_end FROM lv", "lv"),
)
def _(spark, d):
    return facts_ops.latest_values(t.facts(spark, d)).withColumnRenamed("end", "period_end")


_SNAP = names("cik", *schemas.SNAPSHOT_FIELDS, "going_concern")


@register(
    "financials_valid",
    o.query(
        f"SELECT {_SNAP} FROM sn WHERE nullif(total_assets, 0) IS NOT NULL "
        "AND nullif(revenue, 0) IS NOT NULL", "sn",
    ),
)
def _(spark, d):
    snap = facts_ops.valid_snapshot(facts_ops.snapshot(t.facts(spark, d)))
    return snap.select("cik", *schemas.SNAPSHOT_FIELDS, "going_concern")


@register("going_concern_keys", o.query("SELECT * FROM gc", "gc"))
def _(spark, d):
    return facts_ops.going_concern_flags(t.facts(spark, d))


@register("auditor_latest", o.query("SELECT * FROM ad", "ad"))
def _(spark, d):
    return facts_ops.latest_auditor(t.auditor_facts(spark, d))


@register(
    "ids_normalised",
    """SELECT event_id, lpad(CAST(user_id AS VARCHAR), 10, '0') AS padded,
  ltrim(lpad(CAST(user_id AS VARCHAR), 10, '0'), '0') AS stripped,
  replace(strftime(ts, '%Y-%m-%d'), '-', '') AS accession FROM events""",
)
def _(spark, d):
    padded = facts_ops.padded_cik(c("user_id"))
    return t.table(spark, d, "events").select(
        "event_id",
        padded.alias("padded"),
        facts_ops.stripped_cik(padded).alias("stripped"),
        facts_ops.plain_accession(F.date_format("ts", "yyyy-MM-dd")).alias("accession"),
    )


@register(
    "fy_window",
    o.query(
        f"SELECT CAST(fy AS BIGINT) AS fy, count(*) AS facts, count(DISTINCT cik) AS companies FROM fa "
        f"WHERE fy BETWEEN {o._LO} AND {t.AS_OF.year + 1} GROUP BY 1", "fa",
    ),
)
def _(spark, d):
    lo, hi = facts_ops.fiscal_year_bounds(t.AS_OF, t.YEARS, t.FLOOR)
    rows = t.facts(spark, d).where(c("fy").between(lo, hi))
    return rows.groupBy(c("fy").cast("bigint").alias("fy")).agg(
        F.count(F.lit(1)).alias("facts"), F.count_distinct("cik").alias("companies")
    )


# == joins and upserts ========================================================


@register(
    "enrich_update",
    o.query(
        """SELECT co.cik, co.ticker, CASE WHEN mk.ticker IS NOT NULL THEN mk.avg_volume_90d
  ELSE co.market_cap END AS avg_volume_90d,
  CASE WHEN mk.ticker IS NOT NULL THEN mk.volatility_90d END AS volatility_90d
FROM co LEFT JOIN mk ON co.ticker = mk.ticker""",
        "co", "mk",
    ),
)
def _(spark, d):
    old = t.companies(spark, d).select("cik", "ticker", c("market_cap").alias("avg_volume_90d"))
    fresh = market.market_signals(t.bars(spark, d), t.AS_OF)
    return enrich.update_columns(old, fresh, "ticker", ["avg_volume_90d", "volatility_90d"])


@register(
    "fill_market_cap",
    o.query(
        "SELECT co.* REPLACE (coalesce(nullif(co.market_cap, 0), nullif(qu.market_cap, 0), "
        "co.market_cap) AS market_cap) FROM co LEFT JOIN qu ON co.ticker = qu.ticker", "co", "qu",
    ),
)
def _(spark, d):
    return enrich.fill_market_cap(t.companies(spark, d), t.quotes(spark, d))


_GC = f"""SELECT DISTINCT ltrim(lpad(CAST(doc_id // 10 AS VARCHAR), 10, '0'), '0') AS cik_text
FROM documents WHERE doc_id % 3 <> 0 AND contains(lower(text), '{t.PHRASE}')
  AND DATE '1998-01-01' + CAST(doc_id % 1000 AS INTEGER) BETWEEN DATE '{t.PHRASE_START}'
  AND DATE '{t.PHRASE_END}'"""


def _phrase(spark, d):
    return governance.phrase_ciks(
        t.filing_texts(spark, d), t.PHRASE, t.PHRASE_START, t.PHRASE_END
    )


@register("phrase_search", _GC)
def _(spark, d):
    return _phrase(spark, d)


@register(
    "going_concern_flag",
    o.query(
        f"""SELECT cik, ltrim(CAST(cik AS VARCHAR), '0') IN (SELECT cik_text FROM ({_GC})) AS going_concern,
  CAST(NULL AS VARCHAR) AS auditor_name, false AS big4_auditor, false AS small_auditor_flag FROM co""",
        "co",
    ),
)
def _(spark, d):
    flagged = governance.flag_going_concern(t.companies(spark, d), _phrase(spark, d))
    return flagged.select("cik", "going_concern", "auditor_name", "big4_auditor", "small_auditor_flag")


@register(
    "needs_enrichment",
    o.query(
        """SELECT cik, coalesce(ticker <> '', false) AND (avg_volume_90d IS NULL OR volatility_90d IS NULL)
    AS needs_market,
  net_insider_shares IS NULL AS needs_insider, nullif(market_cap, 0) IS NULL AS needs_cap FROM fin""",
        "fin",
    ),
)
def _(spark, d):
    return financials(spark, d).select(
        "cik",
        enrich.needs_market().alias("needs_market"),
        enrich.needs_insider().alias("needs_insider"),
        enrich.needs_cap().alias("needs_cap"),
    )


@register(
    "resume_anti",
    o.query(
        "SELECT cik, ticker FROM co WHERE NOT EXISTS (SELECT 1 FROM qu WHERE qu.ticker = co.ticker "
        "AND qu.market_cap IS NOT NULL)", "co", "qu",
    ),
)
def _(spark, d):
    done = t.quotes(spark, d).where(c("market_cap").isNotNull()).select("ticker")
    return enrich.not_done(t.companies(spark, d), done, "ticker").select("cik", "ticker")


def _snap_sql(cond: str) -> str:
    return f"""SELECT cik, coalesce(nullif(r0, 0), r1) AS revenue,
  {names(*facts_ops.SNAPSHOT_CONCEPTS)}, going_concern FROM (
  SELECT cik, max(v) FILTER (concept = '{facts_ops.SNAPSHOT_REVENUE[0]}') AS r0,
    max(v) FILTER (concept = '{facts_ops.SNAPSHOT_REVENUE[1]}') AS r1,
    {", ".join(f"max(v) FILTER (concept = '{k}') AS {f}" for f, k in facts_ops.SNAPSHOT_CONCEPTS.items())},
    bool_or(concept IN ({o.texts(facts_ops.GOING_CONCERN_CONCEPTS)})) AS going_concern
  FROM (SELECT cik, concept, CASE WHEN form = '10-K' AND row_number() OVER (
      PARTITION BY cik, concept, form = '10-K' ORDER BY end_date DESC, pos DESC) = 1 THEN val END AS v
    FROM fa WHERE {cond}) GROUP BY cik)"""


_OLD = _snap_sql("filed < DATE '2000-01-01'")
_NEW = _snap_sql("filed >= DATE '2000-01-01'")


@register(
    "upsert",
    o.query(
        f"""SELECT coalesce(a.cik, b.cik) AS cik, CASE WHEN a.cik IS NULL THEN co.name ELSE a.name END AS name,
  {", ".join(f"CASE WHEN b.cik IS NOT NULL THEN b.{f} ELSE a.{f} END AS {f}"
             for f in [*schemas.SNAPSHOT_FIELDS, "going_concern"])}
FROM (SELECT s.*, co.name FROM ({_OLD}) s JOIN co ON s.cik = co.cik
      WHERE nullif(total_assets, 0) IS NOT NULL AND nullif(revenue, 0) IS NOT NULL) a
FULL JOIN (SELECT * FROM ({_NEW}) WHERE nullif(total_assets, 0) IS NOT NULL) b ON a.cik = b.cik
LEFT JOIN co ON co.cik = coalesce(a.cik, b.cik)""",
        "fa", "co",
    ),
)
def _(spark, d):
    cut = F.lit(dt.date(2000, 1, 1))
    all_facts, companies = t.facts(spark, d), t.companies(spark, d)
    base = screening.base_financials(companies, all_facts.where(c("filed") < cut))
    fresh = facts_ops.valid_snapshot(
        facts_ops.snapshot(all_facts.where(c("filed") >= cut)), need_revenue=False
    )
    merged = enrich.upsert_snapshot(base, fresh, companies)
    return merged.select("cik", "name", *schemas.SNAPSHOT_FIELDS, "going_concern")


@register(
    "defaults",
    o.query(
        """SELECT co.cik, ad.auditor_name, coalesce(gc.going_concern, false) AS going_concern,
  false AS big4_auditor FROM co LEFT JOIN ad ON co.cik = ad.cik LEFT JOIN gc ON gc.cik = co.cik""",
        "co", "ad", "gc",
    ),
)
def _(spark, d):
    found = facts_ops.going_concern_flags(t.facts(spark, d))
    names_ = facts_ops.latest_auditor(t.auditor_facts(spark, d))
    joined = t.companies(spark, d).join(names_, "cik", "left").join(found, "cik", "left")
    filled = enrich.with_defaults(
        joined,
        {
            "going_concern": ("boolean", False),
            "auditor_name": ("string", None),
            "big4_auditor": ("boolean", False),
        },
    )
    return filled.select("cik", "auditor_name", "going_concern", "big4_auditor")


@register(
    "append_union",
    o.query(
        "SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, revenue, "
        "CASE WHEN fiscal_year > 1998 THEN total_assets END AS total_assets FROM aw", "aw",
    ),
)
def _(spark, d):
    wide = facts_ops.annual_financials(annual(spark, d)).select(
        "cik", *counted("fiscal_year"), "revenue", "total_assets"
    )
    old = wide.where(c("fiscal_year") <= 1998).drop("total_assets")
    return enrich.append_rows(old, wide.where(c("fiscal_year") > 1998))


# == prices ===================================================================


def _filings(spark, d):
    wide = facts_ops.annual_financials(annual(spark, d)).select("cik", "fiscal_year", "filed_date")
    listed = t.companies(spark, d).where(c("ticker").isNotNull()).select("cik", "ticker")
    return wide.join(listed, "cik")


@register(
    "asof_price",
    o.query(
        "SELECT fl.cik, CAST(fl.fiscal_year AS BIGINT) AS fiscal_year, fl.filed_date, ex.e0 AS entry "
        "FROM fl LEFT JOIN ex USING (ticker, filed_date)", "fl", "ex",
    ),
)
def _(spark, d):
    joined = prices.asof_join(_filings(spark, d), t.bars(spark, d), "filed_date", "entry")
    return joined.select("cik", *counted("fiscal_year"), "filed_date", "entry")


@register(
    "benchmark_return",
    o.query(
        f"SELECT fd.filed_date, {o.rnd('b12.r', 6)} AS return_12m, {o.rnd('b24.r', 6)} AS return_24m "
        "FROM (SELECT DISTINCT filed_date FROM fd) fd LEFT JOIN b12 USING (filed_date) "
        "LEFT JOIN b24 USING (filed_date)", "fd", "b12", "b24",
    ),
)
def _(spark, d):
    days = prices.benchmark_days(t.benchmark(spark, d)).withColumnRenamed("day", "filed_date")
    asked = _filings(spark, d).select("filed_date").distinct()
    return asked.join(days, "filed_date", "left").select(
        "filed_date",
        rnd("benchmark_12m", 6).alias("return_12m"),
        rnd("benchmark_24m", 6).alias("return_24m"),
    )


def _from_panel(*columns: str) -> Query:
    def run(spark, d):
        return panel(spark, d).select("cik", *counted("fiscal_year"), *columns)

    return run


def _panel_sql(*columns: str, table: str = "pn") -> str:
    return o.query(
        f"SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, {names(*columns)} FROM {table}", table
    )


def _panel_query(name: str, *columns: str, table: str = "pn") -> None:
    register(name, _panel_sql(*columns, table=table))(_from_panel(*columns))


@register("forward_returns", _panel_sql(*prices.RETURN_COLUMNS, table="pr"))
def _(spark, d):
    priced = panel_plan.priced_panel(
        facts_ops.annual_financials(annual(spark, d)), t.companies(spark, d), t.bars(spark, d),
        t.benchmark(spark, d), t.AS_OF,
    )
    return priced.select("cik", *counted("fiscal_year"), *prices.RETURN_COLUMNS)


_panel_query("momentum", *prices.MOMENTUM_BARS, table="pr")
_panel_query("high_52w", "price_to_52w_high", table="pr")
_panel_query("vol_prior", "vol_prior_12m", table="pr")
_panel_query("pit_market_cap", "market_cap", table="pr")


def _market_query(name: str, *columns: str) -> None:
    def run(spark, d):
        return market.market_signals(t.bars(spark, d), t.AS_OF).select("ticker", *columns)

    register(name, o.query(f"SELECT ticker, {names(*columns)} FROM mk", "mk"))(run)


_market_query("market_volume", "avg_volume_90d", "volume_spike_ratio", "illiquid_flag")
_market_query("price_change", "price_change_90d")
_market_query("volatility", "volatility_90d")


@register("pump_dump", o.query(f"SELECT * FROM ({o.market_sql(400, 1.03, 0.2)})", "ba"))
def _(spark, d):
    params = market.MarketParams(window_days=400, spike_above=1.03, pump_above=0.2)
    return market.market_signals(t.bars(spark, d), t.AS_OF, params)


@register("beta", o.query("SELECT ticker, beta FROM qs", "qs"))
def _(spark, d):
    return market.quote_signals(t.quotes(spark, d)).select("ticker", "beta")


@register("spread", o.query("SELECT ticker, bid_ask_spread FROM qs", "qs"))
def _(spark, d):
    return market.quote_signals(t.quotes(spark, d)).select("ticker", "bid_ask_spread")


# == insiders =================================================================


@register("form4_parse", o.query("SELECT cik, accession, code, shares FROM tx", "tx"))
def _(spark, d):
    return insider.parse_transactions(t.form4_documents(spark, d))


@register(
    "form4_filing_sums", o.query("SELECT cik, accession, sales, purchases FROM fs", "fs")
)
def _(spark, d):
    return insider.filing_sums(insider.parse_transactions(t.form4_documents(spark, d)))


@register(
    "form4_top20",
    o.query(
        "SELECT cik, accession, filed FROM (SELECT *, row_number() OVER (PARTITION BY cik "
        "ORDER BY filed DESC) AS rn FROM fs) WHERE rn <= 20", "fs",
    ),
)
def _(spark, d):
    filings = insider.recent_filings(t.submissions(spark, d), t.EVENTS_AS_OF)
    return insider.newest_per_company(filings).select("cik", "accession", "filed")


@register("insider_signals", o.query("SELECT * FROM ins", "ins"))
def _(spark, d):
    return screening.insider_company_signals(
        t.submissions(spark, d), t.form4_documents(spark, d), t.AS_OF
    )


# == signals and value ========================================================


def _signal_query(name: str, *columns: str) -> None:
    wide = [x for x in columns if x != "piotroski_score"]
    ints = [x for x in columns if x == "piotroski_score"]

    def run(spark, d):
        cols = signals.accounting_columns()
        fin = financials(spark, d)
        return fin.select("cik", *[cols[x].alias(x) for x in columns]).select(
            "cik", *wide, *counted(*ints)
        )

    picked = ", ".join([*wide, *([big(*ints)] if ints else [])])
    register(name, o.query(f"SELECT cik, {picked} FROM sg", "sg"))(run)


_signal_query("piotroski", "piotroski_score", "piotroski_weak")
_signal_query("accruals", "accruals_ratio", "accruals_flag")
_signal_query("cfd", "cfd_ratio", "cfd_flag")
_signal_query("altman", "altman_score", "altman_zone", "altman_flag")
_signal_query("revenue_quality", "ar_ratio", "dso", "revenue_quality_flag")
_signal_query("earnings_quality", "non_op_ratio", "earnings_quality_flag")


@register(
    "beneish",
    o.query(
        f"""SELECT sg.cik, beneish_score, beneish_flag,
  {", ".join(f"{o.rnd(x)} AS {k}" for k, (_, x) in o.BENEISH_PARTS.items())}
FROM fin JOIN (SELECT cik, beneish_score, beneish_flag FROM sg) sg ON fin.cik = sg.cik""",
        "fin", "sg",
    ),
)
def _(spark, d):
    cols = signals.beneish()
    scored = financials(spark, d).select("cik", *[e.alias(n) for n, e in cols.items()])
    parts = [c("beneish_components")[k].alias(k) for k in o.BENEISH_PARTS]
    return scored.select("cik", "beneish_score", "beneish_flag", *parts)


@register(
    "auditor_class",
    o.query(
        f"""SELECT cik, auditor_name, big4_auditor, small_auditor_flag,
  CASE WHEN coalesce(auditor_name, '') = '' THEN 'Not available' WHEN big4_auditor THEN 'Big 4'
    WHEN small_auditor_flag THEN 'Small firm' ELSE 'Mid-tier' END AS tier
FROM (SELECT co.cik, ad.auditor_name, {o._BIG4} AS big4_auditor, {o._SMALL} AS small_auditor_flag
  FROM co LEFT JOIN ad ON co.cik = ad.cik)""",
        "co", "ad",
    ),
)
def _(spark, d):
    named = t.companies(spark, d).join(
        facts_ops.latest_auditor(t.auditor_facts(spark, d)), "cik", "left"
    )
    flags = governance.classify_auditor(c("auditor_name"), c("market_cap"))
    tier = governance.auditor_tier(c("auditor_name"), c("big4_auditor"), c("small_auditor_flag"))
    return named.withColumns(flags).select(
        "cik", "auditor_name", "big4_auditor", "small_auditor_flag", tier.alias("tier")
    )


_SIGNAL_FLAT = [x for x in signals.REPORT_PATHS if x != "piotroski_score"]


@register(
    "all_signals",
    o.query(
        f"SELECT cik, {names(*_SIGNAL_FLAT)}, {big('piotroski_score')}, ev, ebitda FROM sg", "sg"
    ),
)
def _(spark, d):
    nested = signals.assemble_signals(financials(spark, d))
    flat = nested.select(
        "cik", *[c(p).alias(n) for n, p in signals.REPORT_PATHS.items()], "value.ev", "value.ebitda"
    )
    return flat.select("cik", *_SIGNAL_FLAT, *counted("piotroski_score"), "ev", "ebitda")


def _value_query(name: str, *columns: str) -> None:
    def run(spark, d):
        cols = value.value_columns()
        return financials(spark, d).select("cik", *[cols[x].alias(x) for x in columns])

    register(name, o.query(f"SELECT cik, {names(*columns)} FROM sg", "sg"))(run)


_value_query("value_price", "pe_ratio", "pb_ratio", "ev", "ebitda", "ev_ebitda", "fcf", "fcf_yield")
_value_query(
    "value_returns", "roe", "roa", "gross_margin", "net_margin", "debt_to_equity", "current_ratio"
)
_value_query(
    "value_magic", "ev_clean", "earnings_yield", "acquirers_multiple", "return_on_capital"
)
_value_query(
    "value_capital", "invested_capital", "croic", "ncav", "ncav_ratio", "net_net_flag",
    "gross_profitability",
)
_value_query("segment", "market_cap_segment")


# == panel ====================================================================


@register(
    "historical_panel",
    o.query(
        f"""SELECT {names(*[x for x in panel_plan.PANEL_COLUMNS if x not in ('fiscal_year', 'piotroski_score')])},
  {big('fiscal_year', 'piotroski_score')} FROM pn""",
        "pn",
    ),
)
def _(spark, d):
    ints = ("fiscal_year", "piotroski_score")
    rest = [x for x in panel_plan.PANEL_COLUMNS if x not in ints]
    return build_panel(spark, d).select(*rest, *counted(*ints))


_panel_query(
    "ext_margins", *features.EXTENDED_COLUMNS[:10],
)
_panel_query("ext_solvency", *features.EXTENDED_COLUMNS[10:19])
_panel_query("ext_capital", *features.EXTENDED_COLUMNS[19:])
_panel_query("ext_flags", *features.FLAG_COLUMNS)


def _yoy_query(name: str, *columns: str) -> None:
    def run(spark, d):
        wide = panel_plan.annual_panel(t.facts(spark, d), t.AS_OF, t.YEARS, t.FLOOR)
        return wide.select("cik", *counted("fiscal_year"), *columns)

    register(name, _panel_sql(*columns, table="yo"))(run)


_yoy_query("yoy_growth", *features.GROWTH_FIELDS)
_yoy_query("yoy_deltas", *features.RATIO_DELTAS)


# == score and report =========================================================


@register("composite", o.query("SELECT cik, fraud_score, risk FROM sc", "sc"))
def _(spark, d):
    scored = scoring.score_signals(signals.assemble_signals(financials(spark, d)))
    return scored.select("cik", "fraud_score", "risk")


@register("red_flags", o.query(f"SELECT cik, {big('red_flags_count')} FROM sc", "sc"))
def _(spark, d):
    scored = scoring.score_signals(signals.assemble_signals(financials(spark, d)))
    return scored.select("cik", *counted("red_flags_count"))


_REPORT_INTS = ("piotroski_score", "red_flags_count")
_REPORT_REST = [x for x in scoring.REPORT_COLUMNS if x not in _REPORT_INTS]


@register(
    "report",
    o.query(f"SELECT cik, {names(*_REPORT_REST)}, {big(*_REPORT_INTS)} FROM rp", "rp"),
)
def _(spark, d):
    return build_report(spark, d).select("cik", *_REPORT_REST, *counted(*_REPORT_INTS))


_TOP = "ORDER BY coalesce(fraud_score, 0) DESC, cik LIMIT 25"


@register(
    "top25",
    o.query(
        f"SELECT cik, ticker, risk, fraud_score, {big('red_flags_count')} FROM rp {_TOP}", "rp"
    ),
)
def _(spark, d):
    top = scoring.top_suspicious(report(spark, d), 25)
    return top.select("cik", "ticker", "risk", "fraud_score", *counted("red_flags_count"))


def _fmt(x: str, digits: int) -> str:
    """Exact decimal text; zero never carries a sign."""
    return f"replace(printf('%.{digits}f', {x}), '-{0:.{digits}f}', '{0:.{digits}f}')"


@register(
    "console_report",
    o.query(
        f"""SELECT cik, rpad(coalesce(ticker, 'N/A'), 8, ' ') || ' ' || rpad(risk, 14, ' ') || ' '
  || lpad(coalesce({_fmt('fraud_score', 1)}, 'N/A'), 6, ' ') || ' '
  || lpad(coalesce({_fmt('beneish_score', 2)}, 'N/A'), 8, ' ') || ' '
  || lpad(coalesce({_fmt('altman_score', 2)}, 'N/A'), 8, ' ') || ' '
  || lpad(CAST(red_flags_count AS VARCHAR), 6, ' ') || '  ' || substr(name, 1, 35) AS line
FROM rp {_TOP.replace('25', '20')}""",
        "rp",
    ),
)
def _(spark, d):
    return scoring.console_lines(report(spark, d), 20)


@register(
    "risk_tally",
    o.query(
        """SELECT count(*) AS companies, count(*) FILTER (risk = 'HIGH RISK') AS high_risk,
  count(*) FILTER (risk = 'MEDIUM RISK') AS medium_risk,
  count(*) FILTER (risk NOT IN ('HIGH RISK', 'MEDIUM RISK')) AS low_risk FROM sc""",
        "sc",
    ),
)
def _(spark, d):
    return scoring.risk_tally(report(spark, d))


@register(
    "magic_rank",
    o.query("SELECT cik, earnings_yield_rank, roc_rank, magic_formula_rank FROM rp", "rp"),
)
def _(spark, d):
    scored = scoring.score_signals(signals.assemble_signals(financials(spark, d)))
    return scoring.magic_ranks(scored).select(
        "cik", "earnings_yield_rank", "roc_rank", "magic_formula_rank"
    )


# == screens ==================================================================


@register(
    "cap_filter",
    o.query(
        """SELECT CASE WHEN coalesce(ticker, '') = '' OR market_cap IS NULL THEN 'no_data'
  WHEN market_cap BETWEEN 150e6 AND 1e9 THEN 'in_range' ELSE 'out_of_range' END AS cap_class,
  count(*) AS companies FROM co GROUP BY 1""",
        "co",
    ),
)
def _(spark, d):
    return screens.cap_tally(t.companies(spark, d))


@register(
    "ui_filter",
    o.query(
        """SELECT cik, ticker, fraud_score FROM rp
WHERE (market_cap IS NULL OR market_cap BETWEEN 0 AND 1e13) AND risk IN ('HIGH RISK', 'MEDIUM RISK', 'LOW RISK')
  AND coalesce(fraud_score, 0) >= 20 AND red_flags_count >= 2
  AND (coalesce(regexp_matches(ticker, 'T0+1'), false) OR coalesce(regexp_matches(name, '(?i)SUPPLIER#0+[0-7]'), false))
  AND altman_flag AND (pe_ratio IS NULL OR pe_ratio <= 400) AND (pb_ratio IS NULL OR pb_ratio <= 900)
  AND roe IS NOT NULL AND roe >= -5.0""",
        "rp",
    ),
)
def _(spark, d):
    params = screens.ScreenParams(
        risks=(scoring.HIGH, scoring.MEDIUM, scoring.LOW), min_score=20, min_flags=2,
        search="t0+1|SUPPLIER#0+[0-7]", flags=("altman_flag",), max_pe=400, max_pb=900,
        min_roe_pct=-500,
    )
    return screens.screen(report(spark, d), params).select("cik", "ticker", "fraud_score")


def _text_pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE {_fmt(f'{x} * 100', 1)} || '%' END AS {x}"


@register(
    "magic_top20",
    o.query(
        f"""SELECT cik, ticker, name, market_cap_segment, fraud_score, risk, magic_formula_rank,
  {_text_pct('earnings_yield')}, {_text_pct('return_on_capital')}, acquirers_multiple,
  {_text_pct('gross_profitability')}
FROM rp WHERE magic_formula_rank IS NOT NULL ORDER BY rp.magic_formula_rank, cik LIMIT 20""",
        "rp",
    ),
)
def _(spark, d):
    return screens.magic_formula_top(report(spark, d))


_ALPHA = """magic_formula_rank <= (SELECT quantile_cont(CAST(magic_formula_rank AS DOUBLE), 0.25) FROM rp)
  AND fraud_score < 45 AND altman_zone IN ('safe', 'grey') AND NOT going_concern_flag"""


@register("alpha", o.query(f"SELECT cik, fraud_score, magic_formula_rank FROM rp WHERE {_ALPHA}", "rp"))
def _(spark, d):
    return screens.alpha_screen(report(spark, d)).select("cik", "fraud_score", "magic_formula_rank")


@register(
    "alpha_plus",
    o.query(
        f"""SELECT cik, fraud_score, magic_formula_rank FROM rp WHERE {_ALPHA}
  AND volatility_90d <= (SELECT quantile_cont(volatility_90d, 0.5) FROM rp)
  AND gross_profitability >= (SELECT quantile_cont(gross_profitability, 0.5) FROM rp)""",
        "rp",
    ),
)
def _(spark, d):
    return screens.alpha_screen_plus(report(spark, d)).select(
        "cik", "fraud_score", "magic_formula_rank"
    )


@register(
    "net_net",
    o.query(f"SELECT cik, {names(*screens.NET_NET_COLUMNS)} FROM rp WHERE net_net_flag", "rp"),
)
def _(spark, d):
    return screens.net_nets(report(spark, d))


@register(
    "net_net_segments",
    o.query(
        "SELECT market_cap_segment, count(*) AS companies FROM rp WHERE net_net_flag GROUP BY 1", "rp"
    ),
)
def _(spark, d):
    return screens.segment_tally(screens.net_nets(report(spark, d)))


_CODES = ", ".join(f"CASE WHEN {col} THEN '{code}' END" for col, code, _ in screens.FLAG_CODES)


@register(
    "flag_codes",
    o.query(f"SELECT cik, coalesce(nullif(concat_ws(' · ', {_CODES}), ''), '—') AS codes FROM rp", "rp"),
)
def _(spark, d):
    return report(spark, d).select("cik", screens.flag_codes().alias("codes"))


def _why(key: str, text: str) -> str:
    cond = "(NOT altman_flag AND altman_zone = 'grey')" if key == "altman_grey" else key
    return f"CASE WHEN {cond} THEN '{text}' END"


@register(
    "explanations",
    o.query(
        f"""SELECT cik, coalesce(nullif(concat_ws(' | ',
  {", ".join(_why(k, v) for k, v in screens.EXPLANATIONS.items())}), ''), '{screens.NO_EXPLANATION}')
  AS explanation FROM rp""",
        "rp",
    ),
)
def _(spark, d):
    return report(spark, d).select(
        "cik", F.array_join(screens.explanations(), " | ").alias("explanation")
    )


def _money(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'N/A' WHEN abs({x}) >= 1e9 THEN '$' || {_fmt(f'{x} / 1e9', 1)} || 'B'
  WHEN abs({x}) >= 1e6 THEN '$' || {_fmt(f'{x} / 1e6', 0)} || 'M' ELSE '$' || {_fmt(f'{x} / 1e3', 0)} || 'K' END"""


@register(
    "formatted",
    o.query(
        f"""SELECT cik, CASE WHEN market_cap IS NULL THEN 'N/A' WHEN market_cap >= 1e9
    THEN '$' || {_fmt('market_cap / 1e9', 1)} || 'B' ELSE '$' || {_fmt('market_cap / 1e6', 0)} || 'M' END AS cap,
  CASE WHEN avg_volume_90d IS NULL THEN 'N/A' WHEN avg_volume_90d >= 1e6
    THEN {_fmt('avg_volume_90d / 1e6', 1)} || 'M' WHEN avg_volume_90d >= 1e3
    THEN {_fmt('avg_volume_90d / 1e3', 0)} || 'K' ELSE CAST(CAST(trunc(avg_volume_90d) AS BIGINT) AS VARCHAR) END
    AS volume,
  coalesce({_fmt('roe * 100', 1)} || '%', 'N/A') AS roe_pct,
  coalesce({_fmt('ev_ebitda', 1)} || 'x', 'N/A') AS ev_multiple,
  coalesce({_fmt('current_ratio', 2)}, 'N/A') AS current, {_money('fcf')} AS fcf_text FROM rp""",
        "rp",
    ),
)
def _(spark, d):
    return report(spark, d).select(
        "cik",
        fmt.market_cap("market_cap").alias("cap"),
        fmt.volume("avg_volume_90d").alias("volume"),
        fmt.percent("roe").alias("roe_pct"),
        fmt.multiple("ev_ebitda").alias("ev_multiple"),
        fmt.ratio("current_ratio").alias("current"),
        fmt.dollars("fcf").alias("fcf_text"),
    )


@register(
    "display_table",
    o.query(
        f"""SELECT cik, ticker AS Ticker, risk AS Risk, {o.rnd('fraud_score', 1)} AS Score,
  CAST(red_flags_count AS BIGINT) AS Flags, coalesce(nullif(concat_ws(' · ', {_CODES}), ''), '—') AS Signals,
  CASE WHEN market_cap IS NULL THEN 'N/A' WHEN market_cap >= 1e9
    THEN '$' || {_fmt('market_cap / 1e9', 1)} || 'B' ELSE '$' || {_fmt('market_cap / 1e6', 0)} || 'M' END AS Mkt_Cap,
  {o.rnd('beneish_score', 2)} AS Beneish, {o.rnd('altman_score', 2)} AS Altman_Z, name AS Company FROM rp""",
        "rp",
    ),
)
def _(spark, d):
    return screens.display_table(report(spark, d)).withColumn("Flags", c("Flags").cast("bigint"))


@register(
    "lookup",
    o.query(
        "SELECT cik, ticker, name, fraud_score FROM rp WHERE ticker = 'T000001' "
        "ORDER BY coalesce(fraud_score, 0) DESC, cik LIMIT 1", "rp",
    ),
)
def _(spark, d):
    return screens.lookup(report(spark, d), "T000001").select("cik", "ticker", "name", "fraud_score")


@register(
    "bands",
    o.query(
        """SELECT cik, CASE WHEN fraud_score >= 70 THEN 'high' WHEN fraud_score >= 45 THEN 'medium' ELSE 'none' END
    AS score_band,
  CASE WHEN altman_score < 1.81 THEN 'high' WHEN altman_score < 2.99 THEN 'medium' ELSE 'none' END AS altman_band,
  CASE risk WHEN 'HIGH RISK' THEN 'high' WHEN 'MEDIUM RISK' THEN 'medium' ELSE 'low' END AS risk_band,
  CASE WHEN pump_dump_flag THEN 'red' WHEN volume_spike_ratio > 2 THEN 'amber' ELSE 'green' END AS spike_band,
  CASE WHEN price_change_90d > 0.5 THEN 'red' ELSE 'green' END AS price_band FROM rp""",
        "rp",
    ),
)
def _(spark, d):
    return report(spark, d).select(
        "cik",
        screens.score_band(c("fraud_score")).alias("score_band"),
        screens.altman_band(c("altman_score")).alias("altman_band"),
        screens.risk_band(c("risk")).alias("risk_band"),
        screens.spike_band().alias("spike_band"),
        screens.price_band().alias("price_band"),
    )


# == statistics ===============================================================

NUMERIC = [
    "fraud_score", "beneish_score", "piotroski_score", "accruals_ratio", "cfd_ratio",
    "altman_score", "ar_ratio", "dso", "non_op_ratio", "avg_volume_90d", "volume_spike_ratio",
    "price_change_90d", "volatility_90d", "beta", "bid_ask_spread", "net_insider_shares",
    "pe_ratio", "pb_ratio", "ev_ebitda", "fcf_yield", "fcf", "roe", "roa", "gross_margin",
    "net_margin", "debt_to_equity", "current_ratio", "earnings_yield", "return_on_capital",
    "acquirers_multiple", "ncav", "ncav_ratio", "gross_profitability", "croic",
    "invested_capital", "market_cap",
]
CORRELATED = [
    "beneish_score", "piotroski_score", "accruals_ratio", "cfd_ratio", "altman_score",
    "ar_ratio", "non_op_ratio", "earnings_yield", "return_on_capital", "acquirers_multiple",
    "gross_profitability", "croic", "roe", "roa", "fcf_yield", "gross_margin", "net_margin",
    "debt_to_equity", "current_ratio", "pe_ratio", "pb_ratio", "ev_ebitda", "ncav_ratio",
]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@register(
    "coverage",
    o.query(
        f"""SELECT *, CASE WHEN coverage_pct >= 70 THEN 'good' WHEN coverage_pct >= 40 THEN 'fair'
    ELSE 'poor' END AS band
FROM ({_union([f"SELECT '{x}' AS metric, count({x}) AS count, "
               + o.rnd(f'count({x}) * 1e2 / count(*)', 1) + " AS coverage_pct FROM rp" for x in NUMERIC])})""",
        "rp",
    ),
)
def _(spark, d):
    return stats.top_coverage(report(spark, d), NUMERIC)


@register(
    "segment_counts",
    o.query(
        f"""SELECT CAST(position AS BIGINT) AS position, market_cap_segment, count,
  {o.rnd('count / nullif(CAST(sum(count) OVER () AS DOUBLE), 0)', 6)} AS share
FROM ({_union([f"SELECT {i} AS position, '{s}' AS market_cap_segment, count(*) FILTER "
               f"(market_cap_segment = '{s}') AS count FROM rp" for i, s in enumerate(value.SEGMENTS, 1)])})""",
        "rp",
    ),
)
def _(spark, d):
    counts = stats.domain_counts(report(spark, d), "market_cap_segment", value.SEGMENTS)
    return counts.select(
        *counted("position"), "market_cap_segment", "count", rnd("share", 6).alias("share")
    )


@register(
    "summary",
    o.query(
        f"""SELECT count(x) AS count, {o.rnd('avg(x)')} AS mean, {o.rnd('stddev_samp(x)')} AS std,
  {o.rnd('avg(CASE WHEN x > 0 THEN 1.0e0 WHEN x <= 0 THEN 0.0e0 END)')} AS share_positive,
  {o.rnd('quantile_cont(x, 0.5)')} AS median FROM (SELECT forward_return_12m AS x FROM pn)""",
        "pn",
    ),
)
def _(spark, d):
    s = stats.summary(panel(spark, d), "forward_return_12m")
    return s.select("count", *[rnd(x).alias(x) for x in ("mean", "std", "share_positive", "median")])


DRIFT = ["beneish_score", "altman_score", "earnings_yield", "gross_profitability", "fcf_yield"]


@register(
    "group_median",
    o.query(
        _union([
            f"SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year, '{x}' AS feature, "
            f"{o.rnd(f'quantile_cont({x}, 0.5)', 5)} AS median FROM pn WHERE {x} IS NOT NULL GROUP BY 1"
            for x in DRIFT
        ]),
        "pn",
    ),
)
def _(spark, d):
    m = stats.group_median(panel(spark, d), "fiscal_year", DRIFT)
    return m.select(*counted("fiscal_year"), "feature", rnd("median", 5).alias("median"))


@register(
    "segment_stats",
    o.query(
        f"""SELECT market_cap_segment, {o.rnd('avg(fraud_score)', 1)} AS mean,
  {o.rnd('quantile_cont(fraud_score, 0.5)', 1)} AS median, {o.rnd('stddev_samp(fraud_score)', 1)} AS std,
  count(fraud_score) AS count FROM rp WHERE market_cap_segment IS NOT NULL GROUP BY 1""",
        "rp",
    ),
)
def _(spark, d):
    s = stats.group_stats(report(spark, d), "market_cap_segment", "fraud_score")
    return s.select(
        "market_cap_segment", *[rnd(x, 1).alias(x) for x in ("mean", "median", "std")], "count"
    )


def _hist_sql(values: str, bins: int, need: str) -> str:
    return o.query(
        f"""SELECT CAST(least(coalesce(floor((v - lo) / nullif((hi - lo) / CAST({bins} AS DOUBLE), 0)), 0), {bins - 1})
  AS BIGINT) AS bin, count(*) AS count
FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM ({values})) GROUP BY 1""",
        need,
    )


@register(
    "histogram",
    _hist_sql(
        "SELECT least(greatest(forward_return_12m, -1.0e0), 3.0e0) AS v FROM pn "
        "WHERE forward_return_12m IS NOT NULL", 80, "pn",
    ),
)
def _(spark, d):
    h = stats.histogram(panel(spark, d), "forward_return_12m", 80, -1, 3)
    return h.select(*counted("bin"), "count")


@register(
    "histogram_winsor",
    _hist_sql(
        "SELECT least(greatest(volatility_90d, (SELECT quantile_cont(volatility_90d, 0.01) FROM rp)), "
        "(SELECT quantile_cont(volatility_90d, 0.99) FROM rp)) AS v FROM rp WHERE volatility_90d IS NOT NULL",
        60, "rp",
    ),
)
def _(spark, d):
    h = stats.histogram(report(spark, d), "volatility_90d", 60)
    return h.select(*counted("bin"), "count")


@register(
    "winsor",
    o.query(
        _union([
            f"SELECT '{x}' AS feature, {o.rnd(f'quantile_cont(CAST({x} AS DOUBLE), 0.01)', 5)} AS lo, "
            f"{o.rnd(f'quantile_cont(CAST({x} AS DOUBLE), 0.99)', 5)} AS hi FROM pn"
            for x in CORRELATED
        ]),
        "pn",
    ),
)
def _(spark, d):
    b = stats.winsor_bounds(panel(spark, d), CORRELATED)
    return b.select("feature", rnd("lo", 5).alias("lo"), rnd("hi", 5).alias("hi"))


def _corr_sql(a: str, b: str) -> str:
    x = f"corr({a}, {b})"
    return o.rnd(f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END", 6)


@register(
    "corr_label",
    o.query(
        "SELECT * FROM ("
        + _union([
            f"SELECT '{x}' AS feature, {_corr_sql(x, 'label')} AS correlation FROM labelled"
            for x in CORRELATED
        ])
        + ") WHERE correlation IS NOT NULL",
        "pn",
    ).replace(
        "\nSELECT * FROM (SELECT", ", labelled AS (SELECT *, least(greatest(forward_return_12m, -1.0e0), "
        "3.0e0) AS label FROM pn WHERE forward_return_12m IS NOT NULL)\nSELECT * FROM (SELECT", 1,
    ),
)
def _(spark, d):
    label = stats.clip(c("forward_return_12m"), -1, 3)
    r = stats.label_correlations(panel(spark, d), CORRELATED, label)
    return r.select("feature", rnd("correlation", 6).alias("correlation"))


@register(
    "corr_pairs",
    o.query(
        "SELECT feature_a, feature_b, "
        + o.rnd("r", 3)
        + " AS correlation FROM ("
        + _union([
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count({a}) AS na, count({b}) AS nb, "
            f"corr({a}, {b}) AS r FROM pn"
            for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]
        ])
        + ") WHERE na > 100 AND nb > 100 AND NOT isnan(r) AND abs(r) > 0.6",
        "pn",
    ),
)
def _(spark, d):
    return stats.redundant_pairs(stats.correlation_matrix(panel(spark, d), CORRELATED))


def _quartile_sql(table: str, score: str, target: str, need: str) -> str:
    return o.query(
        f"""SELECT quartile, {o.rnd('avg(t)')} AS mean, {o.rnd('quantile_cont(t, 0.5)')} AS median, count(*) AS count
FROM (SELECT t, CASE WHEN s <= quantile_cont(s, 0.25) OVER () THEN 'Q1 Low Risk'
    WHEN s <= quantile_cont(s, 0.5) OVER () THEN 'Q2'
    WHEN s <= quantile_cont(s, 0.75) OVER () THEN 'Q3' ELSE 'Q4 High Risk' END AS quartile
  FROM (SELECT CAST({score} AS DOUBLE) AS s, {target} AS t FROM {table}
        WHERE {score} IS NOT NULL AND {target} IS NOT NULL))
GROUP BY 1""",
        need,
    )


@register("quartiles", _quartile_sql("rp", "fraud_score", "price_change_90d", "rp"))
def _(spark, d):
    q = stats.quartile_returns(report(spark, d), "fraud_score", "price_change_90d")
    return q.select("quartile", rnd("mean").alias("mean"), rnd("median").alias("median"), "count")


_APPROX = " + ".join(
    f"{p} * CAST({f} AS INTEGER)" for f, p in stats.APPROX_POINTS.items()
)


@register(
    "approx_score",
    o.query(
        f"SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST({_APPROX} AS BIGINT) AS score FROM pn",
        "pn",
    ),
)
def _(spark, d):
    return panel(spark, d).select(
        "cik", *counted("fiscal_year"), stats.approximate_score().cast("bigint").alias("score")
    )


@register(
    "approx_quartiles",
    _quartile_sql(f"(SELECT {_APPROX} AS s0, forward_return_12m FROM pn)", "s0", "forward_return_12m", "pn"),
)
def _(spark, d):
    scored = panel(spark, d).withColumn("score", stats.approximate_score())
    q = stats.quartile_returns(scored, "score", "forward_return_12m")
    return q.select("quartile", rnd("mean").alias("mean"), rnd("median").alias("median"), "count")


@register(
    "distinct",
    o.query("SELECT count(*) AS rows, count(DISTINCT ticker) AS distinct_values FROM pn", "pn"),
)
def _(spark, d):
    return stats.distinct_count(panel(spark, d), "ticker")


@register(
    "rows_per_year",
    o.query(
        "SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year, count(*) AS rows FROM pn "
        "WHERE fiscal_year BETWEEN 1996 AND 2030 GROUP BY 1", "pn",
    ),
)
def _(spark, d):
    years = stats.yearly_rows(panel(spark, d), low=1996)
    return years.select(*counted("fiscal_year"), "rows").orderBy("fiscal_year")


@register(
    "label_coverage",
    o.query(
        """SELECT count(*) AS rows, count(forward_return_12m) AS labelled_12m,
  count(forward_return_24m) AS labelled_24m, count(beat_sp500) AS beat_labels FROM pn""",
        "pn",
    ),
)
def _(spark, d):
    return stats.label_coverage(panel(spark, d))


@register(
    "flag_tally",
    o.query(
        _union([
            f"SELECT '{f}' AS signal, count(*) FILTER ({f}) AS count, "
            f"{o.rnd(f'count(*) FILTER ({f}) * 1e2 / count(*)', 0)} AS pct FROM rp"
            for f, _, _ in screens.FLAG_CODES
        ]),
        "rp",
    ),
)
def _(spark, d):
    return stats.flag_tally(report(spark, d))


@register(
    "lookahead_audit",
    o.query(
        """SELECT cik, ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, filed_date,
  make_date(CAST(fiscal_year AS BIGINT), 12, 31) AS year_end FROM pn
WHERE forward_return_12m IS NOT NULL AND filed_date < make_date(CAST(fiscal_year AS BIGINT), 12, 31)""",
        "pn",
    ),
)
def _(spark, d):
    early = stats.early_filings(panel(spark, d))
    return early.select("cik", "ticker", *counted("fiscal_year"), "filed_date", "year_end")


# == model ====================================================================

#: Flags are features, too, but are not winsorised.
_FLAGS = {x for x in model.FEATURES if x.endswith("_flag") or x == "piotroski_weak"}


def _clipped(x: str) -> str:
    return (
        f"least(greatest({x}, quantile_cont({x}, 0.01) OVER ()), quantile_cont({x}, 0.99) OVER ())"
    )


def _kept_null(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {o.rnd(_clipped(x), 5)} END AS {x}"


@register(
    "train_prep",
    o.query(
        f"""SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, {", ".join(
            x if x in _FLAGS else _kept_null(x) for x in ["forward_return_12m", *model.FEATURES]
        )} FROM pn WHERE forward_return_12m IS NOT NULL""",
        "pn",
    ),
)
def _(spark, d):
    rows = model.prepare(panel(spark, d), "forward_return_12m")
    numbers = {x: rnd(c(x).cast("double"), 5).alias(x) for x in ("forward_return_12m", *model.FEATURES)}
    return rows.select("cik", *counted("fiscal_year"), *[x if x in _FLAGS else n for x, n in numbers.items()])


@register(
    "label_balance",
    o.query(
        f"""SELECT count(*) AS rows, {o.rnd('avg(CAST(beat_sp500 AS INTEGER))', 6)} AS label_balance,
  CAST({len(model.FEATURES)} AS BIGINT) AS features, CAST(21 AS BIGINT) AS yoy_features,
  CAST(5 AS BIGINT) AS price_features FROM pn WHERE forward_return_12m IS NOT NULL""",
        "pn",
    ),
)
def _(spark, d):
    rows = panel(spark, d).where(c("forward_return_12m").isNotNull())
    b = model.label_balance(rows, "beat_sp500")
    return b.select(
        "rows", rnd("label_balance", 6).alias("label_balance"),
        *counted("features", "yoy_features", "price_features"),
    )


_SPLITS = """SELECT a.fiscal_year AS test_year, (SELECT count(*) FROM pn WHERE forward_return_12m IS NOT NULL
    AND fiscal_year < a.fiscal_year) AS train_rows, count(*) AS test_rows
FROM pn a WHERE forward_return_12m IS NOT NULL GROUP BY 1
HAVING count(*) >= 10 AND train_rows >= 50 AND a.fiscal_year > (SELECT DISTINCT fiscal_year FROM pn
  WHERE forward_return_12m IS NOT NULL ORDER BY 1 LIMIT 1 OFFSET 1)"""


@register(
    "walk_splits",
    o.query(f"SELECT {big('test_year', 'train_rows', 'test_rows')} FROM ({_SPLITS})", "pn"),
)
def _(spark, d):
    rows = panel(spark, d).where(c("forward_return_12m").isNotNull())
    return model.walk_forward_splits(rows).select(*counted("test_year", "train_rows", "test_rows"))


@register(
    "train_medians",
    o.query(
        "SELECT CAST(test_year AS BIGINT) AS test_year, feature, median FROM ("
        + _union([
            f"SELECT test_year, '{x}' AS feature, {o.rnd(f'quantile_cont(CAST({x} AS DOUBLE), 0.5)', 5)} AS median "
            f"FROM ({_SPLITS}) s JOIN pn ON pn.fiscal_year < s.test_year AND forward_return_12m IS NOT NULL "
            f"GROUP BY 1 HAVING count({x}) > 0"
            for x in model.FEATURES
        ])
        + ")",
        "pn",
    ),
)
def _(spark, d):
    rows = panel(spark, d).where(c("forward_return_12m").isNotNull())
    m = model.train_medians(rows, model.test_years(model.walk_forward_splits(rows)), model.FEATURES)
    return m.select(*counted("test_year"), "feature", rnd("median", 5).alias("median"))


@register(
    "auc_mae",
    o.query(
        f"""SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year,
  {o.rnd('CAST(sum(CASE WHEN y = 1 THEN rk END) - p * (p + 1) / 2e0 AS DOUBLE) / nullif(p * (n - p), 0)', 6)} AS auc,
  {o.rnd('max(mae)', 6)} AS mae
FROM (SELECT *, sum(y) OVER (PARTITION BY fiscal_year) AS p, count(*) OVER (PARTITION BY fiscal_year) AS n,
    avg(abs(forward_return_12m - s)) OVER (PARTITION BY fiscal_year) AS mae,
    rank() OVER (PARTITION BY fiscal_year ORDER BY s)
      + (count(*) OVER (PARTITION BY fiscal_year, s) - 1) / 2e0 AS rk
  FROM (SELECT fiscal_year, forward_return_12m, CAST(beat_sp500 AS INTEGER) AS y,
    -beneish_score AS s FROM pn WHERE forward_return_12m IS NOT NULL))
GROUP BY fiscal_year, p, n""",
        "pn",
    ),
)
def _(spark, d):
    # A deterministic score stands in for a model.
    rows = panel(spark, d).where(c("forward_return_12m").isNotNull()).select(
        "fiscal_year", "forward_return_12m", "beat_sp500", (-c("beneish_score")).alias("s")
    )
    joined = model.auc(rows, "beat_sp500", "s", ["fiscal_year"]).join(
        model.mae(rows, "forward_return_12m", "s", ["fiscal_year"]), "fiscal_year"
    )
    return joined.select(*counted("fiscal_year"), rnd("auc", 6).alias("auc"), rnd("mae", 6).alias("mae"))


@register(
    "backtest",
    o.query(
        f"""SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year, {o.rnd('strategy', 5)} AS strategy,
  {o.rnd('benchmark', 5)} AS benchmark, n_stocks,
  {o.rnd('product(1 + strategy) OVER w', 4)} AS cum_strategy,
  {o.rnd('product(1 + coalesce(benchmark, 0)) OVER w', 4)} AS cum_benchmark
FROM (SELECT fiscal_year, avg(forward_return_12m) AS strategy, avg(sp500_return_12m) AS benchmark,
    count(*) AS n_stocks
  FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY -altman_score DESC, cik) AS rn
    FROM pn WHERE forward_return_12m IS NOT NULL AND altman_score IS NOT NULL)
  WHERE rn <= 20 GROUP BY 1)
WINDOW w AS (ORDER BY fiscal_year ROWS UNBOUNDED PRECEDING)""",
        "pn",
    ),
)
def _(spark, d):
    rows = panel(spark, d).where(c("forward_return_12m").isNotNull())
    b = model.backtest(rows.withColumn("s", -c("altman_score")), "s")
    return b.select(
        *counted("fiscal_year"), rnd("strategy", 5).alias("strategy"),
        rnd("benchmark", 5).alias("benchmark"), "n_stocks",
        rnd("cum_strategy", 4).alias("cum_strategy"), rnd("cum_benchmark", 4).alias("cum_benchmark"),
    )


_HORIZONS = {"12m": "beat_sp500", "24m": "beat_sp500_24m"}
_fits: dict[tuple[str, str], model.WalkForward] = {}
_finals: dict[tuple[str, str], model.FinalModel] = {}


def walk_forward_fit(spark: SparkSession, d: str) -> model.WalkForward:
    """The full model on both horizons, grown once per session and data set."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _fits:
        horizons = {}
        for name, beat in _HORIZONS.items():
            label = f"forward_return_{name}"
            rows = model.prepare(panel(spark, d).where(c(label).isNotNull()), label)
            horizons[name] = model.Horizon(rows, label, beat, f"sp500_return_{name}")
        _fits[key] = model.walk_forward_horizons(horizons, params=model.TreeParams())
    return _fits[key]


def final_fit(spark: SparkSession, d: str) -> model.FinalModel:
    """The 12-month classifier on all labelled rows."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _finals:
        rows = model.prepare(panel(spark, d), "forward_return_12m")
        _finals[key] = model.fit_final(rows, "beat_sp500", params=model.TreeParams())
    return _finals[key]


@register("gbt_walk_forward")
def _(spark, d):
    """The model loop with all trees on both horizons; one without a split has no rows."""
    return model.split_metrics(walk_forward_fit(spark, d).predictions)


def _both_horizons(sql: str) -> str:
    """``sql`` written for the 12-month columns, for both horizons."""
    parts = []
    for name, beat in _HORIZONS.items():
        one = sql.replace("forward_return_12m", f"forward_return_{name}").replace("beat_sp500", beat)
        parts.append(one.replace("HORIZON", f"'{name}'"))
    return " UNION ALL ".join(parts)


@register(
    "model_predictions",
    o.query(
        _both_horizons(
            f"""SELECT HORIZON AS horizon, CAST(s.test_year AS BIGINT) AS test_year, count(*) AS rows,
  CAST(sum(CAST(coalesce(beat_sp500, false) AS INTEGER)) AS BIGINT) AS beaten, true AS probable, true AS known
FROM ({_SPLITS}) s JOIN pn ON pn.fiscal_year = s.test_year AND forward_return_12m IS NOT NULL GROUP BY 2"""
        ),
        "pn",
    ),
)
def _(spark, d):
    """Every labelled row of a test year is predicted once by each model of its split."""
    rows = walk_forward_fit(spark, d).predictions
    return rows.groupBy("horizon", *[x.alias("test_year") for x in counted("fiscal_year")]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(c("beat").cast("bigint")).alias("beaten"),
        F.every((c("proba") > 0) & (c("proba") < 1)).alias("probable"),
        F.every(c("predicted_return").isNotNull()).alias("known"),
    )


@register("model_backtest")
def _(spark, d):
    """Top 20 by predicted probability against the benchmark, 12 months."""
    rows = walk_forward_fit(spark, d).predictions.where("horizon = '12m'")
    b = model.backtest_predictions(rows)
    return b.select(
        *counted("fiscal_year"), rnd("strategy", 5).alias("strategy"),
        rnd("benchmark", 5).alias("benchmark"), "n_stocks",
        rnd("cum_strategy", 4).alias("cum_strategy"), rnd("cum_benchmark", 4).alias("cum_benchmark"),
    )


@register("model_importance")
def _(spark, d):
    """The 15 most important features of each horizon."""
    found = walk_forward_fit(spark, d).importances
    return model.importance_by_horizon({h: found.where(c("horizon") == h) for h in _HORIZONS})


@register(
    "model_importance_sums",
    o.query(
        _both_horizons(
            f"""SELECT HORIZON AS horizon, CAST(test_year AS BIGINT) AS test_year,
  CAST({len(model.FEATURES)} AS BIGINT) AS features, 1e0 AS total FROM ({_SPLITS}) s"""
        ),
        "pn",
    ),
)
def _(spark, d):
    found = walk_forward_fit(spark, d).importances
    return found.groupBy("horizon", c("test_year").cast("bigint").alias("test_year")).agg(
        F.count(F.lit(1)).alias("features"), rnd(F.sum("importance"), 6).alias("total")
    )


@register(
    "model_final_scores",
    o.query("SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, true AS probable FROM pn", "pn"),
)
def _(spark, d):
    """The final model scores every company and year of the panel, labelled or not."""
    scored = final_fit(spark, d).score(panel(spark, d))
    sure = (c("proba") > 0) & (c("proba") < 1)
    return scored.select("cik", *counted("fiscal_year"), sure.alias("probable"))


@register(
    "model_attribution",
    o.query(
        "SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, true AS adds_up FROM pn "
        "WHERE cik = (SELECT min(cik) FROM pn)", "pn",
    ),
)
def _(spark, d):
    """For one company: contributions and base sum to the log odds that scoring gives."""
    fit, rows = final_fit(spark, d), panel(spark, d)
    one = rows.join(F.broadcast(rows.agg(F.min("cik").alias("cik"))), "cik", "left_semi")
    parts = fit.explain(one).groupBy("cik", "fiscal_year").agg(
        (F.sum("contribution") + F.first("base")).alias("margin")
    )
    both = parts.join(fit.score(one), ["cik", "fiscal_year"])
    gap = F.abs(c("margin") - F.log(c("proba") / (1 - c("proba"))))
    return both.select("cik", *counted("fiscal_year"), (gap < 1e-9).alias("adds_up"))


@register("model_reasons")
def _(spark, d):
    """The three features that move each company's newest score most."""
    fit, rows = final_fit(spark, d), panel(spark, d)
    newest = rows.groupBy("cik").agg(F.max("fiscal_year").alias("fiscal_year"))
    parts = fit.explain(rows.join(newest, ["cik", "fiscal_year"], "left_semi"))
    most = Window.partitionBy("cik").orderBy(F.abs(c("contribution")).desc(), "feature")
    ranked = parts.withColumn("place", F.row_number().over(most)).where(c("place") <= 3)
    return ranked.select(
        "cik", *counted("fiscal_year", "place"), "feature", rnd("contribution", 6).alias("contribution")
    )


# == streams ==================================================================


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table as a file stream."""
    return spark.readStream.schema(t.TABLE_SCHEMAS[name]).parquet(f"{d}/{name}.parquet*")


def _changes(spark, d):
    """Facts of the companies that filled orders stand for, streamed into a change log."""
    filed = t.table(spark, d, "orders").where(c("o_orderstatus") == "F")
    filed = filed.select(c("o_custkey").alias("cik")).distinct()
    facts = t.facts_of(_stream(spark, d, "lineitem")).join(filed, "cik", "left_semi")
    changes, checkpoint = new_folder(spark, "changes"), new_folder(spark, "stream")
    refresh.start_fact_refresh(facts, changes, checkpoint).awaitTermination()
    return spark.read.parquet(changes)


@register(
    "stream_refresh",
    o.query(
        f"SELECT {_SNAP} FROM sn WHERE nullif(total_assets, 0) IS NOT NULL "
        "AND cik IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "sn",
    ),
)
def _(spark, d):
    applied = refresh.logged_snapshots(_changes(spark, d))
    return applied.select("cik", *schemas.SNAPSHOT_FIELDS, "going_concern")


@register(
    "stream_daily",
    """SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'purchase' THEN '10-K' WHEN 'error' THEN '10-Q'
  ELSE '8-K' END AS form, count(*) AS filings FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    filings = _stream(spark, d, "events").select(
        t.event_form().alias("form"), c("ts").cast("timestamp").alias("filed_ts")
    )
    out, checkpoint = new_folder(spark, "daily"), new_folder(spark, "stream")

    refresh.start_daily(filings, out, checkpoint).awaitTermination()
    return refresh.newest_counts(spark.read.parquet(out))
