"""More registered queries: documents to report, directory, screens and statistics."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import rnd
from ..operators import facts as facts_ops
from ..operators import enrich, prices, scoring, screens, stats
from ..plans import panel as panel_plan
from ..plans import screening
from ..session import materialise, new_folder
from ..sources import landed
from ..sources.versions import KeyedTable
from ..streaming import refresh
from . import catalog as k
from . import oracle as o
from . import tables as t

c = F.col


def company_documents(spark: SparkSession, d: str) -> DataFrame:
    """(cik, doc): one facts document per company with all its facts, as filed."""
    return documents_of(t.all_facts(spark, d).repartition("cik"))


def documents_of(facts: DataFrame) -> DataFrame:
    """(cik, doc) of a long fact table.

    Facts that are partitioned by cik move no more: a document is one row, so all steps to
    it stay with its company.
    """
    entry = F.to_json(
        F.struct(
            "form", "fy", "fp", c("end").cast("string").alias("end"),
            c("filed").cast("string").alias("filed"),
            F.coalesce(c("val_text"), c("val").cast("string")).alias("val"),
        )
    )

    def members(key: str, body: str) -> Column:
        pair = F.concat(F.lit('"'), c(key), F.lit('":'), c(body))
        return F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ","), F.lit("}"))

    listed = F.sort_array(F.collect_list(F.struct("pos", entry.alias("e"))))
    texts = F.array_join(F.transform(listed, lambda x: x["e"]), ",")
    units = facts.groupBy("cik", "namespace", "concept", "unit").agg(
        F.concat(F.lit("["), texts, F.lit("]")).alias("entries")
    )
    concepts = units.groupBy("cik", "namespace", "concept").agg(
        F.concat(F.lit('{"units":'), members("unit", "entries"), F.lit("}")).alias("body")
    )
    spaces = concepts.groupBy("cik", "namespace").agg(members("concept", "body").alias("body"))
    return spaces.groupBy("cik").agg(
        F.concat(F.lit('{"facts":'), members("namespace", "body"), F.lit("}")).alias("doc")
    )


@k.register(
    "report_from_documents",
    o.query("SELECT cik, ticker, fraud_score, risk, going_concern_flag, auditor_name FROM rp", "rp"),
)
def _(spark, d):
    facts = landed.explode_facts(company_documents(spark, d))
    inputs = dataclasses.replace(t.screen_inputs(spark, d), facts=facts)
    report = screening.run_screen(inputs, t.AS_OF)[2]
    return report.select("cik", "ticker", "fraud_score", "risk", "going_concern_flag", "auditor_name")


@k.register(
    "text_search_report",
    o.query(
        f"SELECT cik, ltrim(CAST(cik AS VARCHAR), '0') IN (SELECT cik_text FROM ({k._GC})) AS going_concern_flag, "
        "auditor_name, altman_score FROM rp",
        "rp",
    ),
)
def _(spark, d):
    inputs = dataclasses.replace(
        t.screen_inputs(spark, d),
        filing_texts=t.filing_texts(spark, d),
        phrase=(t.PHRASE, t.PHRASE_START, t.PHRASE_END),
    )
    report = screening.run_screen(inputs, t.AS_OF)[2]
    return report.select("cik", "going_concern_flag", "auditor_name", "altman_score")


def _directory(spark: SparkSession, d: str) -> DataFrame:
    """One directory page per supplier: two share classes of one company; some pages broken."""
    cik = F.floor(c("s_suppkey") / 2).cast("string")
    row = [
        F.concat(F.lit("["), cik, F.lit(',"'), c("s_name"), F.lit(f'","{x}'), c("s_suppkey").cast("string"), F.lit('","N"]'))
        for x in "AB"
    ]
    doc = F.concat(F.lit('{"data":['), row[0], F.lit(","), row[1], F.lit("]}"))
    broken = c("s_suppkey") % 10 == 3
    text = F.when(broken, F.expr("substring(_doc, 1, length(_doc) - 9)")).otherwise(c("_doc"))
    docs = t.table(spark, d, "supplier").withColumn("_doc", doc)
    return docs.select("s_suppkey", text.alias("doc"))


@k.register(
    "directory_first",
    "SELECT s_suppkey // 2 AS cik, s_name AS name, 'A' || s_suppkey AS ticker FROM supplier s "
    "WHERE s_suppkey % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM supplier p WHERE p.s_suppkey // 2 = s.s_suppkey // 2 "
    "AND p.s_suppkey < s.s_suppkey AND p.s_suppkey % 10 <> 3)",
)
def _(spark, d):
    rows = landed.explode_directory(_directory(spark, d), page="s_suppkey")
    first = landed.first_listings(rows)
    return first.select("cik", "name", "ticker")


@k.register("directory_rejects", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3")
def _(spark, d):
    return landed.unreadable(_directory(spark, d), schemas.DIRECTORY_DOCUMENT).select("s_suppkey")


@k.register(
    "facts_rejects",
    "SELECT l_suppkey AS cik, count(*) AS documents FROM lineitem WHERE l_suppkey % 10 = 3 GROUP BY 1",
)
def _(spark, d):
    """Facts documents that cannot be read, for the error list of a fetch."""
    broken = c("cik") % 10 == 3
    cut = F.expr("substring(doc, 1, length(doc) - 9)")
    docs = t.facts_documents(spark, d).withColumn("doc", F.when(broken, cut).otherwise(c("doc")))
    rejects = landed.unreadable(docs, schemas.FACTS_DOCUMENT)
    return rejects.groupBy("cik").agg(F.count(F.lit(1)).alias("documents"))


@k.register("json_table", o.query("SELECT * FROM co", "co"))
def _(spark, d):
    """Files that each hold one JSON array of companies, read as a table."""
    path = new_folder(spark, "company-arrays")
    group = F.floor(c("cik") / 100)  # at most 100 companies an array
    row = F.struct("cik", "name", "ticker", "exchange", "market_cap")
    arrays = t.companies(spark, d).groupBy(group).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    schema = "cik bigint, name string, ticker string, exchange string, market_cap double"
    return landed.read_json_table(spark, path, schema)


@k.register(
    "panel_from_documents",
    o.query(
        f"""SELECT {k.names(*[x for x in panel_plan.PANEL_COLUMNS if x not in ('fiscal_year', 'piotroski_score')])},
  {k.big('fiscal_year', 'piotroski_score')} FROM pn""",
        "pn",
    ),
)
def _(spark, d):
    """The panel from documents where the unit decides: other units carry wrong values."""
    # Every fact moves once, to its company; wrong copies are made there.
    facts = t.all_facts(spark, d).repartition("cik")
    as_filed = F.struct("unit", "val")
    decoy = F.struct(F.lit("shares").alias("unit"), (c("val") * 7).alias("val"))
    late = F.struct(F.lit("USD/shares").alias("unit"), (c("val") * 5).alias("val"))
    copies = (
        F.when((c("unit") == "USD") & (c("cik") % 3 == 0), F.array(as_filed, decoy))
        .when(c("unit").isin("USD", "shares") & (c("cik") % 3 == 1), F.array(as_filed, late))
        .otherwise(F.array(as_filed))
    )
    filed = facts.withColumn("_copy", F.explode(copies))
    docs = documents_of(filed.withColumns({"unit": c("_copy.unit"), "val": c("_copy.val")}).drop("_copy"))
    panel = panel_plan.build_panel(
        t.companies(spark, d), landed.explode_facts(docs), t.bars(spark, d), t.benchmark(spark, d),
        t.AS_OF, t.YEARS, t.FLOOR,
    )
    ints = ("fiscal_year", "piotroski_score")
    rest = [x for x in panel_plan.PANEL_COLUMNS if x not in ints]
    return panel.select(*rest, *k.counted(*ints))


def _numbers(columns: list[str]) -> str:
    """SQL list of the columns that hold numbers, told by name."""
    other = {
        "ticker", "name", "exchange", "risk", "altman_zone", "auditor_name", "market_cap_segment",
        "filed_date", "piotroski_weak", "big4_auditor", "beat_sp500", "beat_sp500_24m",
    }
    return ", ".join(f"'{x}'" for x in columns if x not in other and not x.endswith("_flag"))


@k.register(
    "coverage_by_type",
    " UNION ALL ".join(
        "SELECT * FROM ("
        + o.query(
            f"SELECT '{label}' AS of_table, name AS metric, n AS count, "
            + o.rnd("n * 1e2 / total", 1)
            + " AS coverage_pct FROM (UNPIVOT (SELECT count(*) AS total, "
            f"count(COLUMNS(lambda x: x IN ({columns}))) FROM {view}) "
            "ON COLUMNS(* EXCLUDE (total)) INTO NAME name VALUE n)",
            view,
        )
        + ")"
        for label, view, columns in (
            ("report", "rp", _numbers(["cik", *scoring.REPORT_COLUMNS])),
            ("panel", "pn", _numbers(panel_plan.PANEL_COLUMNS)),
        )
    ),
)
def _(spark, d):
    """Coverage of every column that holds numbers, of the report and of the panel."""
    parts = [
        stats.coverage(df).select(F.lit(label).alias("of_table"), "metric", "count", "coverage_pct")
        for label, df in (("report", k.report(spark, d)), ("panel", k.panel(spark, d)))
    ]
    return parts[0].unionByName(parts[1])


@k.register(
    "versioned_upsert",
    o.query(
        f"""SELECT coalesce(a.cik, b.cik, e.cik) AS cik,
  {", ".join(f"CASE WHEN e.cik IS NOT NULL THEN e.{f} WHEN b.cik IS NOT NULL THEN b.{f} ELSE a.{f} END AS {f}"
             for f in [*schemas.SNAPSHOT_FIELDS, "going_concern"])}
FROM (SELECT s.* FROM ({k._snap_sql("filed < DATE '1999-06-01'")}) s JOIN co ON s.cik = co.cik
      WHERE nullif(total_assets, 0) IS NOT NULL AND nullif(revenue, 0) IS NOT NULL) a
FULL JOIN (SELECT * FROM ({k._snap_sql("filed >= DATE '1999-06-01' AND filed < DATE '2001-01-01' AND cik % 3 = 0")})
      WHERE nullif(total_assets, 0) IS NOT NULL) b ON a.cik = b.cik
FULL JOIN (SELECT * FROM ({k._snap_sql("filed >= DATE '2001-01-01' AND cik % 5 < 2")})
      WHERE nullif(total_assets, 0) IS NOT NULL) e ON coalesce(a.cik, b.cik) = e.cik""",
        "fa", "co",
    ),
)
def _(spark, d):
    """Two rounds of fresh snapshots applied to a versioned company table."""
    facts, companies = t.facts(spark, d), t.companies(spark, d)
    filed = c("filed")
    first, second = F.lit(dt.date(1999, 6, 1)), F.lit(dt.date(2001, 1, 1))
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in schemas.FINANCIALS.items())
    table = KeyedTable(spark, new_folder(spark, "company-versions"), "cik", ddl)
    table.create(screening.base_financials(companies, facts.where(filed < first)))
    for rows in (
        facts.where((filed >= first) & (filed < second) & (c("cik") % 3 == 0)),
        facts.where((filed >= second) & (c("cik") % 5 < 2)),
    ):
        snap = facts_ops.valid_snapshot(facts_ops.snapshot(rows), need_revenue=False)
        fresh = materialise(snap, "fresh-snapshots")
        table.upsert(fresh, lambda old, new: enrich.upsert_snapshot(old, new, companies))
    return table.read().select("cik", *schemas.SNAPSHOT_FIELDS, "going_concern")


@k.register(
    "stream_notices",
    o.query(
        f"SELECT {k._SNAP} FROM sn WHERE nullif(total_assets, 0) IS NOT NULL "
        "AND cik IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "sn",
    ),
)
def _(spark, d):
    """Filled orders announce filings; each batch reads the facts of the companies named."""
    filings = k._stream(spark, d, "orders").where(c("o_orderstatus") == "F").select(
        c("o_custkey").alias("cik"),
        F.lit("10-K").alias("form"),
        c("o_orderdate").cast("timestamp").alias("filed_ts"),
    )
    changes, checkpoint = new_folder(spark, "changes"), new_folder(spark, "stream")
    refresh.start_refresh(filings, lambda s: t.facts(s, d), changes, checkpoint).awaitTermination()
    applied = refresh.newest_changes(spark.read.parquet(changes))
    return applied.select("cik", *schemas.SNAPSHOT_FIELDS, "going_concern")


@k.register(
    "late_dates",
    o.query(
        "SELECT cik, concept, unit, val, end_date AS period_end FROM (SELECT *, row_number() OVER "
        "(PARTITION BY cik, concept, unit ORDER BY end_date DESC, pos DESC) AS rn FROM (SELECT * REPLACE "
        "(CAST(end_date + CASE WHEN pos % 3 = 0 THEN 73000 ELSE 0 END AS DATE) AS end_date) FROM fa) "
        "WHERE form = '10-K') WHERE rn = 1",
        "fa",
    ),
)
def _(spark, d):
    shift = F.when(c("pos") % 3 == 0, 73_000).otherwise(0)
    rows = t.facts(spark, d).withColumn("end", F.date_add("end", shift))
    return facts_ops.latest_values(rows).withColumnRenamed("end", "period_end")


@k.register(
    "screen_flags",
    o.query(
        " UNION ALL ".join(
            f"SELECT '{f}' AS flag, count(*) AS companies, sum(cik) AS ciks FROM rp WHERE {f} "
            "AND (market_cap IS NULL OR market_cap BETWEEN 0 AND 1e13)"
            for f in (
                "beneish_flag", "altman_flag", "going_concern_flag", "revenue_quality_flag",
                "earnings_quality_flag", "pump_dump_flag", "illiquid_flag", "insider_selling_flag",
                "small_auditor_flag",
            )
        ),
        "rp",
    ),
)
def _(spark, d):
    report = k.report(spark, d)
    parts = []
    for f in screens.FLAG_FILTERS:
        found = screens.screen(report, screens.ScreenParams(risks=(), flags=(f,)))
        parts.append(
            found.agg(F.count("*").alias("companies"), F.sum("cik").cast("decimal(38,0)").alias("ciks"))
            .withColumn("flag", F.lit(f))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@k.register(
    "screen_caps",
    o.query(
        " UNION ALL ".join(
            f"SELECT '{name}' AS preset, count(*) AS companies FROM rp WHERE (market_cap IS NULL OR market_cap "
            f"BETWEEN {low}e6 AND {high}e6) AND fcf_yield >= -0.5e0"
            for name, low, high in (
                ("All sizes", 0, 10_000_000), ("Micro (<$300M)", 0, 300), ("Small ($150M-$1B)", 150, 1_000),
                ("Mid ($1B-$10B)", 1_000, 10_000), ("Large (>$10B)", 10_000, 10_000_000),
            )
        ),
        "rp",
    ),
)
def _(spark, d):
    out = None
    for name in screens.CAP_PRESETS_MILLIONS:
        params = screens.ScreenParams.preset(name, risks=(), min_fcf_yield_pct=-50)
        found = screens.screen(k.report(spark, d), params).agg(F.count("*").alias("companies"))
        part = found.withColumn("preset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@k.register(
    "alpha_segments",
    o.query(
        f"SELECT market_cap_segment, count(*) AS companies FROM rp WHERE {k._ALPHA} GROUP BY 1", "rp"
    ),
)
def _(spark, d):
    return screens.segment_tally(screens.alpha_screen(k.report(spark, d)))


@k.register(
    "histogram_segments",
    o.query(
        """SELECT market_cap_segment, CAST(least(coalesce(floor((v - lo) / nullif((hi - lo) / CAST(30 AS DOUBLE), 0)), 0), 29)
  AS BIGINT) AS bin, count(*) AS count
FROM (SELECT *, min(v) OVER (PARTITION BY market_cap_segment) AS lo, max(v) OVER (PARTITION BY market_cap_segment) AS hi
  FROM (SELECT market_cap_segment, fraud_score AS v FROM rp WHERE fraud_score IS NOT NULL)) GROUP BY 1, 2""",
        "rp",
    ),
)
def _(spark, d):
    h = stats.group_histogram(k.report(spark, d), "market_cap_segment", "fraud_score", 30)
    return h.select("market_cap_segment", *k.counted("bin"), "count")


#: The report columns that are correlated with the later price change.
REPORT_FEATURES = [
    "fraud_score", "beneish_score", "piotroski_score", "accruals_ratio", "cfd_ratio", "altman_score",
    "ar_ratio", "dso", "non_op_ratio", "volatility_90d", "beta", "bid_ask_spread", "volume_spike_ratio",
    "pe_ratio", "pb_ratio", "ev_ebitda", "fcf_yield", "roe", "roa", "gross_margin", "net_margin",
    "debt_to_equity", "current_ratio", "earnings_yield", "return_on_capital", "acquirers_multiple",
    "gross_profitability", "croic",
]


@k.register(
    "report_correlations",
    o.query(
        "SELECT * FROM ("
        + k._union([
            f"SELECT '{x}' AS feature, {k._corr_sql(x, 'label')} AS correlation FROM labelled"
            for x in REPORT_FEATURES
        ])
        + ") WHERE correlation IS NOT NULL",
        "rp",
    ).replace(
        "\nSELECT * FROM (SELECT", ", labelled AS (SELECT *, least(greatest(price_change_90d, -0.8e0), "
        "2.0e0) AS label FROM rp WHERE price_change_90d IS NOT NULL)\nSELECT * FROM (SELECT", 1,
    ),
)
def _(spark, d):
    label = stats.clip(c("price_change_90d"), -0.8, 2)
    r = stats.label_correlations(k.report(spark, d), REPORT_FEATURES, label)
    return r.select("feature", rnd("correlation", 6).alias("correlation"))


@k.register(
    "report_corr_matrix",
    o.query(
        "SELECT feature_a, feature_b, "
        + o.rnd("r", 3)
        + " AS correlation FROM ("
        + k._union([
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM rp"
            for i, a in enumerate(REPORT_FEATURES) for b in REPORT_FEATURES[i + 1:]
        ])
        + ") WHERE NOT isnan(r) AND r IS NOT NULL",
        "rp",
    ),
)
def _(spark, d):
    """The upper triangle of the correlation matrix of all 28 report columns."""
    m = stats.correlation_matrix(k.report(spark, d), REPORT_FEATURES, min_values=1)
    known = m.where(c("correlation").isNotNull())
    return known.select("feature_a", "feature_b", rnd("correlation", 3).alias("correlation"))


@k.register(
    "repeated_bars",
    o.query(
        f"SELECT ticker, date AS day, {o.rnd('close', 4)} AS close FROM ba",
        "ba",
    ),
)
def _(spark, d):
    bars = t.bars(spark, d).select("ticker", "date", "close")
    lower = bars.withColumn("close", c("close") - 1)
    missing = bars.withColumn("close", F.lit(None).cast("double"))
    days = prices.one_bar_per_day(bars.unionByName(lower).unionByName(missing))
    return days.select("ticker", c("date").alias("day"), rnd("close", 4).alias("close"))


_REVENUE = "nullif(sn.revenue, 0) IS NOT NULL"


@k.register(
    "refreshed_report",
    o.query("SELECT cik, ticker, market_cap, fraud_score, risk FROM rp", "rp")
    .replace(
        f"AND {_REVENUE}",
        f"AND ({_REVENUE} OR co.cik IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))",
    )
    .replace("co.exchange, co.market_cap,", f"co.exchange, CASE WHEN {_REVENUE} THEN co.market_cap END AS market_cap,"),
)
def _(spark, d):
    """Stream, upsert, and score again: companies that filed enter without revenue, too."""
    inputs = t.screen_inputs(spark, d)
    base = screening.base_financials(inputs.companies, inputs.facts)
    fresh = refresh.logged_snapshots(k._changes(spark, d))
    current = enrich.upsert_snapshot(base, fresh, inputs.companies)
    report = screening.run_screen(inputs, t.AS_OF, current)[2]
    return report.select("cik", "ticker", "market_cap", "fraud_score", "risk")
