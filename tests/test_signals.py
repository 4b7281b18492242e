"""Signals, value metrics and score against hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from conftest import rows_by
from ledgerlynx import schemas
from ledgerlynx.functions import rnd_exact
from ledgerlynx.operators import features, scoring, signals, value
from ledgerlynx.schemas import align_schema

HEALTHY = dict(
    cik=1, name="Healthy", ticker="H", exchange="X", market_cap=2e9,
    revenue=1000.0, net_income=100.0, gross_profit=500.0, operating_income=150.0,
    total_assets=1000.0, current_assets=500.0, current_liabilities=200.0,
    total_liabilities=400.0, long_term_debt=100.0, retained_earnings=300.0,
    receivables=100.0, inventory=50.0, ppe_net=300.0, operating_cash_flow=120.0,
    capex=40.0, depreciation=30.0, going_concern=False,
)
NULLS = dict(cik=2, name="Nulls", ticker="N", exchange="X")
ZEROS = dict(HEALTHY, cik=3, revenue=0.0, total_assets=0.0, net_income=0.0, market_cap=0.0)
LOSS = dict(HEALTHY, cik=4, net_income=-100.0, operating_income=-50.0, operating_cash_flow=-300.0)
# z = 1.2*x1 + 1.4*x2 + 3.3*x3 + x5 without a market cap.
EDGE = dict(
    cik=5, name="Edge", ticker="E", exchange="X", revenue=1.81 * 64, total_assets=64.0,
    retained_earnings=0.0, operating_income=0.0, current_assets=0.0, current_liabilities=0.0,
)
MILLIONS = {k: v * 1e6 for k, v in dict(
    HEALTHY, net_income=400.0, operating_cash_flow=-900.0, gross_profit=50.0,
    current_liabilities=900.0, long_term_debt=800.0, total_liabilities=1900.0,
    retained_earnings=-3000.0, operating_income=-200.0, receivables=900.0, revenue=400.0,
).items() if k in schemas.SNAPSHOT_FIELDS}
RISKY = dict(
    MILLIONS, cik=6, name="Risky", ticker="R", exchange="X", market_cap=60e6,
    going_concern=True, avg_volume_90d=100.0, illiquid_flag=True, volume_spike_ratio=10.0,
    pump_dump_flag=True, net_insider_shares=-50_000, insider_selling_flag=True,
    auditor_name="Tiny CPA", small_auditor_flag=True,
)


@pytest.fixture(scope="module")
def fin(spark):
    types = schemas.FINANCIALS
    ddl = ", ".join(f"`{k}` {v}" for k, v in types.items())
    data = [tuple(r.get(k) for k in types) for r in (HEALTHY, NULLS, ZEROS, LOSS, EDGE, RISKY)]
    return spark.createDataFrame(data, ddl)


@pytest.fixture(scope="module")
def flat(fin):
    return rows_by(scoring.score_signals(signals.assemble_signals(fin)), "cik")


def test_beneish(flat, fin):
    # -4.84 + .92*.1 + .528*.5 + .404*.2 + .892*1 + .115*30/330 + 4.679*-.02 - .327*.3
    expected = -4.84 + 0.092 + 0.264 + 0.0808 + 0.892 + 0.115 / 11 - 0.09358 - 0.0981
    assert flat[1]["beneish_score"] == pytest.approx(expected, abs=5e-5)
    assert flat[2]["beneish_score"] == -4.84
    parts = rows_by(signals.assemble_signals(fin).select("cik", "beneish.components"), "cik")
    assert parts[2]["components"] == {}
    assert parts[1]["components"]["depi"] == 0.0909
    assert "dsri" not in parts[3]["components"]


def test_piotroski_of_missing_data_is_three(flat):
    assert flat[2]["piotroski_score"] == 3
    assert flat[1]["piotroski_score"] == 9
    # Zero assets and revenue count as one dollar: F1 and F5 fail, the rest passes.
    assert flat[3]["piotroski_score"] == 7


def test_null_and_zero_divisors(flat):
    for name in ("accruals_ratio", "altman_score", "ar_ratio", "cfd_ratio", "non_op_ratio"):
        assert flat[2][name] is None
        assert flat[3][name] is None
    assert not any(flat[2][f] for f in scoring.RED_FLAGS)


def test_negative_income_uses_absolute_divisor(flat):
    assert flat[4]["cfd_ratio"] == 2.0 and flat[4]["cfd_flag"]
    assert flat[4]["non_op_ratio"] == -0.5 and not flat[4]["earnings_quality_flag"]


def test_altman_edge_is_distress_but_scores_as_grey(flat):
    row = flat[5]
    assert row["altman_score"] == 1.81
    assert row["altman_zone"] == "distress" and row["altman_flag"]
    # beneish 0/20, piotroski (1 - s/9)*10/10, accruals 0/10, altman grey 10/20, concern 0/10
    points = 10 * (1 - row["piotroski_score"] / 9) + 10
    assert row["fraud_score"] == pytest.approx(points / 70 * 100, abs=0.051)


def test_all_flags_on(flat):
    row = flat[6]
    off = [f for f in scoring.RED_FLAGS if not row[f]]
    assert off in ([], ["piotroski_weak"])
    assert row["risk"] == scoring.HIGH and 70 <= row["fraud_score"] <= 100
    assert row["red_flags_count"] == 12 - len(off)


def test_value_metrics(flat):
    h = flat[1]
    assert h["pe_ratio"] == 2e7
    assert h["roe"] == round(100 / 600, 4)
    assert h["current_ratio"] == 2.5
    assert h["invested_capital"] == 700.0
    assert h["croic"] == round(80 / 700, 4)
    assert h["return_on_capital"] == 0.25
    assert h["ncav"] == 100.0 and not h["net_net_flag"]
    assert h["market_cap_segment"] == "mid"
    # Zero cap: no multiple, but the clean enterprise value still exists.
    zero = flat[3]
    assert zero["pe_ratio"] is None and zero["ev_ebitda"] is None and zero["fcf"] is None
    assert zero["market_cap_segment"] == "micro"
    assert flat[2]["market_cap_segment"] is None and flat[2]["net_net_flag"] is False


def test_zero_cap_keeps_clean_enterprise_value(fin):
    cols = value.value_columns()
    r = rows_by(fin.select("cik", cols["ev"].alias("ev"), cols["ev_clean"].alias("ev_clean"),
                           cols["acquirers_multiple"].alias("am")), "cik")[3]
    assert r["ev"] is None
    assert r["ev_clean"] == 100.0 - 350.0
    assert r["am"] == round(-250 / 150, 2)


def test_report_has_63_columns(fin):
    report = scoring.build_report(signals.assemble_signals(fin))
    assert len(scoring.REPORT_COLUMNS) == 63
    assert report.columns == ["cik", *scoring.REPORT_COLUMNS]
    ranks = [r["earnings_yield_rank"] for r in report.collect() if r["earnings_yield_rank"]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_risk_labels(spark):
    df = spark.createDataFrame([(70.0,), (69.9,), (45.0,), (44.9,), (None,)], "s double")
    got = [r[0] for r in df.select(scoring.risk_label(F.col("s"))).collect()]
    assert got == ["HIGH RISK", "MEDIUM RISK", "MEDIUM RISK", "LOW RISK", "INSUFFICIENT DATA"]


def test_yoy_gap_zero_and_sign(spark):
    fields = sorted({*features.GROWTH_FIELDS.values(), "operating_income"})
    def row(fy, revenue, ni=10.0):
        return (1, fy, *[revenue if f == "revenue" else ni if f == "net_income" else 1.0 for f in fields])
    df = spark.createDataFrame(
        [row(2000, 100.0), row(2001, 150.0), row(2003, 300.0), row(2004, 0.0), row(2005, 5.0, -3.0)],
        "cik bigint, fiscal_year int, " + ", ".join(f"{f} double" for f in fields),
    )
    r = rows_by(features.add_yoy(df), "fiscal_year")
    assert r[2000]["revenue_growth_yoy"] is None
    assert r[2001]["revenue_growth_yoy"] == 0.5
    assert r[2003]["revenue_growth_yoy"] is None and r[2003]["net_margin_change"] is None
    assert r[2004]["revenue_growth_yoy"] == -1.0
    assert r[2005]["revenue_growth_yoy"] is None
    assert r[2005]["net_income_growth_yoy"] == -1.3
    assert r[2001]["net_margin_change"] == round(10 / 150 - 10 / 100, 4)


def test_align_schema(spark):
    df = spark.createDataFrame([("12.5",), ("n/a",), (None,)], "market_cap string")
    out = align_schema(df, {"market_cap": ("double", None), "net_net_flag": ("boolean", False)})
    assert [tuple(r) for r in out.collect()] == [(12.5, False), (None, False), (None, False)]


def test_exact_thresholds_do_not_flag(spark):
    cols = ["cik", *schemas.SNAPSHOT_FIELDS, "market_cap"]
    def row(cik, **kw):
        return tuple({"cik": cik, **kw}.get(x) for x in cols)
    df = spark.createDataFrame(
        [row(1, net_income=5.0, total_assets=100.0), row(2, net_income=4.0, operating_cash_flow=3.0),
         row(3, revenue=365.0, receivables=90.0), row(4, revenue=4.0, receivables=1.0),
         row(5, revenue=2.99 * 64, total_assets=64.0, retained_earnings=0.0, operating_income=0.0),
         row(6, net_income=10.0, operating_income=7.0)],
        "cik bigint, " + ", ".join(f"{x} double" for x in cols[1:]),
    )
    out = signals.accounting_columns()
    r = rows_by(df.select("cik", *[e.alias(n) for n, e in out.items()]), "cik")
    assert r[1]["accruals_ratio"] == 0.05 and not r[1]["accruals_flag"]
    assert r[2]["cfd_ratio"] == 0.25 and not r[2]["cfd_flag"]
    assert r[3]["dso"] == 90.0 and not r[3]["revenue_quality_flag"]
    assert r[4]["ar_ratio"] == 0.25 and r[4]["revenue_quality_flag"]  # 91 days
    assert r[5]["altman_score"] == 2.99 and r[5]["altman_zone"] == "grey"
    assert r[6]["non_op_ratio"] == 0.3 and not r[6]["earnings_quality_flag"]


def test_scores_stay_in_range(spark):
    import __spark_entry__ as entry

    report = entry.queries()["composite"](spark, "/root/testdata/sf0.01")
    low, high, missing = report.selectExpr(
        "min(fraud_score)", "max(fraud_score)", "count_if(fraud_score IS NULL)"
    ).first()
    assert 0 <= low <= high <= 100 and missing == 0


def test_console_lines_pad_but_do_not_cut(spark):
    df = spark.createDataFrame(
        [(1, "LONGTICKER", "INSUFFICIENT DATA", None, None, 2.675, 0, "N" * 50)],
        "cik int, ticker string, risk string, fraud_score double, beneish_score double, "
        "altman_score double, red_flags_count int, name string",
    )
    line = scoring.console_lines(df).first()["line"]
    assert line == f"LONGTICKER INSUFFICIENT DATA {'N/A':>6} {'N/A':>8} {'2.67':>8} {'0':>6}  {'N' * 35}"


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_exact_rounding_equals_decimal_text(spark, digits):
    import random

    rng = random.Random(digits)
    values = [rng.randrange(-10**7, 10**7) / 10 ** (digits + 1) for _ in range(4000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(1000)] + [2.675, 0.125, 1.005, -2.5, 0.0, -0.05, 0.05]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(rnd_exact("v", digits)).collect()]
    assert got == [float(f"{v:.{digits}f}") + 0.0 for v in values]
