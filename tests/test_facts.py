"""Fact extraction: tie rules, units, aliases and nested documents."""

import datetime as dt
import json

import pytest

from conftest import rows_by
from ledgerlynx import schemas
from ledgerlynx.operators import facts as ops
from ledgerlynx.operators import governance, insider
from ledgerlynx.sources import landed
from pyspark.sql import functions as F

AS_OF = dt.date(2024, 6, 1)


def entry(val, form="10-K", fy=2022, fp="FY", end="2022-12-31", filed="2023-02-01"):
    return {"form": form, "fy": fy, "fp": fp, "end": end, "filed": filed, "val": val}


@pytest.fixture(scope="module")
def long(spark):
    docs = {
        1: {"us-gaap": {
            "Assets": {"units": {"USD": [
                entry(10), entry(11), entry(12, form="10-K/A", filed="2023-05-01"),
                entry(13, form="10-K/A", filed="2023-05-01"), entry(99, form="10-Q"),
                entry(14, fy=2021, end="2021-12-31", filed="2024-01-01"),
                entry(5, fp="Q4", filed="2024-02-01"), entry(None, filed="2024-03-01")]}},
            "Revenues": {"units": {"USD": [entry(0)]}},
            "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [
                entry(70, filed="2023-04-01")]}},
            "CommonStockSharesOutstanding": {"units": {"shares": [entry(1000)]}},
            "EarningsPerShareDiluted": {"units": {"USD/shares": [entry(1.5)]}},
            "InventoryNet": {"units": {"USD": [entry(1, form="8-K")], "shares": [entry(3)]}},
            "LongTermDebtNoncurrent": {"units": {"USD": [entry(8)]}},
            "GoingConcernDisclosureTextBlock": {"units": {}},
        }, "dei": {"AuditorName": {"units": {"": [
            entry("Old LLP", end="2021-12-31"), entry("New LLP"), entry("Newer LLP", form="10-K/A"),
            entry("Quarter LLP", form="10-Q", end="2023-03-31")]}}}},
        2: {"us-gaap": {"Assets": {"units": {"USD": [entry(7, end="")]}}}},
    }
    rows = [(k, json.dumps({"facts": v})) for k, v in docs.items()]
    return landed.explode_facts(spark.createDataFrame(rows, "cik bigint, doc string")).cache()


def test_latest_value_takes_last_of_equal_ends(long):
    r = rows_by(ops.latest_values(long, ["Assets"]), "cik")
    assert r[1]["val"] is None  # the last listed 10-K entry of the newest end
    assert r[2]["val"] == 7.0


def test_snapshot(long):
    r = rows_by(ops.snapshot(long), "cik")
    assert r[1]["revenue"] == 70.0  # zero falls through to the alias
    assert r[1]["shares_outstanding"] == 1000.0
    assert r[1]["long_term_debt"] is None  # no alias fallback here
    assert r[1]["going_concern"] and not r[2]["going_concern"]
    assert ops.valid_snapshot(ops.snapshot(long)).count() == 0


def test_annual_values_take_first_of_latest_filed(long):
    r = rows_by(ops.annual_values(long, AS_OF), "cik", "concept", "fiscal_year")
    assert r[1, "Assets", 2022]["val"] == 12.0
    assert r[1, "Assets", 2021]["val"] == 14.0
    assert (1, "InventoryNet", 2022) not in r  # an unusable USD list blocks the shares list
    assert r[1, "EarningsPerShareDiluted", 2022]["val"] == 1.5


def test_annual_financials(long):
    r = rows_by(ops.annual_financials(ops.annual_values(long, AS_OF)), "fiscal_year", "cik")
    assert r[2022, 1]["revenue"] == 0.0  # a value of zero is a value here
    assert r[2022, 1]["long_term_debt"] == 8.0
    # The losing alias still counts for the filing date of its year.
    assert r[2022, 1]["filed_date"] == dt.date(2023, 5, 1)


def test_fiscal_year_window():
    assert ops.fiscal_year_bounds(dt.date(2024, 1, 1)) == (2019, 2025)
    assert ops.fiscal_year_bounds(dt.date(2003, 1, 1)) == (2000, 2004)


def test_latest_auditor(long):
    assert rows_by(ops.latest_auditor(long), "cik")[1]["auditor_name"] == "Newer LLP"


def test_hot_company_reduces_before_the_shuffle(long):
    plan = ops.annual_values(long, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.index("partial_max_by") > 0


def test_submissions_zip_stops_at_shortest(spark):
    doc = json.dumps({"filings": {"recent": {
        "form": ["4", "10-K", "4"], "filingDate": ["2024-05-01", "2024-05-02"],
        "accessionNumber": ["0-1-1", "0-1-2", "0-1-3"]}}})
    rows = landed.explode_submissions(spark.createDataFrame([(7, doc)], "cik bigint, doc string"))
    assert rows.count() == 2
    recent = insider.recent_filings(rows, AS_OF).collect()
    assert [(r["accession"], r["filed"]) for r in recent] == [("011", dt.date(2024, 5, 1))]


def test_directory_and_hits(spark):
    doc = json.dumps({"data": [[320193, "Apple Inc.", "AAPL", "Nasdaq"], [1, "B", None, None]]})
    got = landed.explode_directory(spark.createDataFrame([(doc,)], "doc string")).collect()
    assert [tuple(r) for r in got] == [(0, 320193, "Apple Inc.", "AAPL", "Nasdaq"), (1, 1, "B", None, None)]
    shares = json.dumps({"data": [[7, "C", "C.A", "N"], [7, "C", "C.B", "N"], [8, "D", "D", "N"]]})
    listed = landed.explode_directory(spark.createDataFrame([(shares,)], "doc string"))
    first = sorted((r["cik"], r["ticker"]) for r in landed.first_listings(listed).collect())
    assert first == [(7, "C.A"), (8, "D")]
    broken = spark.createDataFrame([(doc,), ("{not json",), (None,)], "doc string")
    lost = landed.unreadable(broken, schemas.DIRECTORY_DOCUMENT).collect()
    assert [r["doc"] for r in lost] == ["{not json", None]
    hit = json.dumps({"hits": {"hits": [
        {"_source": {"ciks": ["0000000012"], "entity_id": "CIK0012", "display_names": [],
                     "file_type": "10-K", "file_date": "2024-05-31"}},
        {"_source": {"file_type": "8-K", "file_date": "2024-05-31"}}]}})
    hits = landed.explode_hits(spark.createDataFrame([(hit,)], "doc string"))
    assert hits.count() == 2
    kept = landed.recent_hits(hits, AS_OF).collect()
    assert [(r["cik"], r["name"]) for r in kept] == [("0012", "")]


def test_phrase_search_and_flag(spark):
    texts = spark.createDataFrame(
        [(["0000000012", "0000000099"], "10-K", dt.date(2022, 1, 1),
          "x" * 50_000 + " Substantial DOUBT about its ability to continue as"),
         (["0000000013"], "10-Q", dt.date(2022, 1, 1), "substantial doubt about its ability to continue"),
         (["0000000014"], "10-K", dt.date(2019, 1, 1), "substantial doubt about its ability to continue")],
        "ciks array<string>, form string, filed date, text string",
    )
    ciks = governance.phrase_ciks(texts)
    assert {r[0] for r in ciks.collect()} == {"12", "99"}
    companies = spark.createDataFrame([(12, "A"), (13, "B")], "cik bigint, auditor_name string")
    r = rows_by(governance.flag_going_concern(companies, ciks), "cik")
    assert r[12]["going_concern"] and not r[13]["going_concern"]
    assert r[12]["auditor_name"] is None


@pytest.mark.parametrize(
    "name,cap,big4,small",
    [
        ("Deloitte & Touche LLP", 1e9, True, False), ("EY", 1e9, True, False),
        ("E&Y ", 1e9, True, False), ("PwC LLP", 1e9, False, False), ("pwc", 1e9, False, False),
        ("Crowe Horwath", 1e9, False, False), ("Tiny CPA", 1e9, False, True),
        ("Tiny CPA", 5e7, False, False), ("Tiny CPA", None, False, False),
        ("", 1e9, False, False), (None, 1e9, False, False),
    ],
)
def test_auditor_classes(spark, name, cap, big4, small):
    df = spark.createDataFrame([(name, cap)], "n string, c double")
    flags = governance.classify_auditor(F.col("n"), F.col("c"))
    assert tuple(df.select(flags["big4_auditor"], flags["small_auditor_flag"]).first()) == (big4, small)


def test_form4_parsing(spark):
    def block(code, shares):
        return (f"<nonDerivativeTransaction>\n<transactionCode>{code}</transactionCode>\n"
                f"<transactionShares>\n <value>{shares}</value></transactionShares></nonDerivativeTransaction>")  # fmt: skip
    xml = block(" S ", "-100.9") + block("P", "5") + block("A", "7") + block("S", "abc") + (
        "<nonDerivativeTransaction><transactionCode>S</transactionCode></nonDerivativeTransaction>")
    docs = spark.createDataFrame([(1, "a", xml), (1, "b", ""), (1, "c", block("S", "20000"))],
                                 "cik bigint, accession string, xml string")
    tx = insider.parse_transactions(docs)
    assert sorted((r["accession"], r["code"], r["shares"]) for r in tx.collect()) == [
        ("a", "A", 7.0), ("a", "P", 5.0), ("a", "S", 100.9), ("c", "S", 20000.0)]
    sums = insider.filing_sums(tx)
    assert rows_by(sums, "accession")["a"]["sales"] == 100
    filings = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")],
                                    "cik bigint, pos int, accession string")
    r = rows_by(insider.insider_signals(insider.newest_per_company(filings), sums), "cik")
    assert (r[1]["insider_sale_count"], r[1]["insider_buy_count"]) == (2, 1)
    assert r[1]["net_insider_shares"] == 5 - 100 - 20000 and r[1]["insider_selling_flag"]
    assert r[2]["net_insider_shares"] == 0 and not r[2]["insider_selling_flag"]


def test_newest_filings_prune_before_the_shuffle(spark):
    rows = [(1, i, f"a{i:03d}") for i in range(300)] + [(2, 0, "z")]
    filings = spark.createDataFrame(rows, "cik bigint, pos int, accession string")
    newest = insider.newest_per_company(filings)
    assert newest.count() == 21
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_schemas_parse():
    for ddl in (schemas.FACTS_LONG, schemas.PRICES, schemas.QUOTES):
        assert len(schemas.struct_type(ddl)) >= 4


def test_landed_files(spark, tmp_path):
    doc = {"facts": {"us-gaap": {"Assets": {"units": {"USD": [entry(3)]}}}}}
    (tmp_path / "CIK0000000012.json").write_text(json.dumps(doc, indent=2))
    docs = landed.read_documents(spark, str(tmp_path / "CIK*.json"))
    named = docs.select(landed.cik_from_path(F.col("path")).alias("cik"), "doc")
    rows = landed.explode_facts(named).collect()
    assert [(r["cik"], r["concept"], r["val"], r["pos"]) for r in rows] == [(12, "Assets", 3.0, 0)]
    (tmp_path / "table.json").write_text('[{"cik": 1, "v": 2.5},\n {"cik": 2}]')
    back = landed.read_json_table(spark, str(tmp_path / "table.json"), "cik bigint, v double")
    assert sorted(map(tuple, back.collect())) == [(1, 2.5), (2, None)]
    assert landed.first_rows(back, 1, "cik").collect()[0]["cik"] == 1
    assert landed.first_rows(back, None).count() == 2
