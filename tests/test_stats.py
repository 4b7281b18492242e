"""Ordering, statistics, screens and model helpers."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import compare
from conftest import rows_by
from ledgerlynx.operators import model, ordered, screens, stats


def skewed(n=6000, seed=3):
    """A third of all rows share one value, another group has few rows."""
    rng = random.Random(seed)
    return [
        (i, "big" if i % 10 else "small", 0.25 if i % 3 == 0 else round(rng.gauss(0, 2), 2))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "cik bigint, g string, v double").repartition(7)


def test_rank_is_a_permutation_in_order(df, rows):
    got = rows_by(ordered.ordinal_ranks(df, "cik", {"r": "v"}), "cik")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [got[r[0]]["r"] for r in order] == list(range(1, len(rows) + 1))


def test_rank_equals_plain_window(df):
    from pyspark.sql import Window

    w = Window.orderBy(F.col("v").desc(), "cik")
    plain = df.select("cik", F.row_number().over(w).cast("bigint").alias("r"))
    assert ordered.ordinal_ranks(df, "cik", {"r": "v"}).exceptAll(plain).isEmpty()


@pytest.mark.parametrize("p", [0.0, 0.01, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_equal_numpy(df, rows, p):
    got = ordered.exact_quantiles(df, "v", [p]).first()["quantile"]
    assert got == pytest.approx(np.quantile([r[2] for r in rows], p), abs=1e-12)


def test_group_quantiles_equal_pandas(df, rows):
    got = rows_by(ordered.quantile_columns(df, "v", {"a": 0.1, "b": 0.5}, ["g"]), "g")
    pdf = pd.DataFrame(rows, columns=["cik", "g", "v"]).groupby("g")["v"]
    for g in ("big", "small"):
        assert got[g]["a"] == pytest.approx(pdf.quantile(0.1)[g])
        assert got[g]["b"] == pytest.approx(pdf.median()[g])


@pytest.mark.parametrize("ties", [True, False])
def test_quantiles_equal_plain(spark, ties):
    n = 60_000
    v = F.rand(5) * 1000 - 300
    if ties:
        v = F.when(F.col("id") % 3 == 0, 12.5).otherwise(F.round(v, 1))
    g = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, "b").otherwise("c")
    data = [(r["g"], r["v"]) for r in spark.range(n).select(g.alias("g"), v.alias("v")).collect()]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.3333, 0.5, 0.99, 1.0]
    for group in (None, "b", "c"):
        own = [x for g, x in data if g == group]
        got = rows_by(ordered.exact_quantiles(df, "v", probs, ["g"]).where(F.col("g").eqNullSafe(F.lit(group))), "prob")
        assert [got[p]["quantile"] for p in probs] == pytest.approx(list(np.quantile(own, probs)), abs=1e-9)
    want = np.quantile([x for _, x in data], probs)
    got = rows_by(ordered.exact_quantiles(df, "v", probs), "prob")
    assert [got[p]["quantile"] for p in probs] == pytest.approx(list(want), abs=1e-9)


def test_quantile_of_single_and_empty(spark):
    one = spark.createDataFrame([(4.0,)], "v double")
    assert ordered.exact_quantiles(one, "v", [0.3]).first()["quantile"] == 4.0
    assert ordered.exact_quantiles(one.where("v < 0"), "v", [0.3]).count() == 0


def test_auc_equals_pair_count(spark):
    rng = random.Random(1)
    data = [(rng.random() < 0.4, rng.randrange(6) / 2) for _ in range(300)]
    df = spark.createDataFrame(data, "y boolean, s double")
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert model.auc(df, "y", "s").first()["auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(1000, 1, 500)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(0, 0.5, 500), "c": rng.normal(0, 1, 500), "k": 3.0})
    pdf.loc[::7, "b"] = None
    pdf.loc[::3, "c"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, k double")
    want = pdf.corr()
    m = rows_by(stats.correlation_matrix(df, list(pdf.columns)), "feature_a", "feature_b")
    for (x, y), r in m.items():
        if "k" in (x, y):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(want.loc[x, y], abs=1e-9)
    label = rows_by(stats.label_correlations(df, ["b", "c", "k"], F.col("a")), "feature")
    assert label["b"]["correlation"] == pytest.approx(want.loc["a", "b"])
    assert "k" not in label
    few = stats.correlation_matrix(df.limit(90), ["a", "b"])
    assert few.count() == 0


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    h = rows_by(stats.histogram(df, "v", 5, 0, 10), "bin")
    assert {k: r["count"] for k, r in h.items()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    flat = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert [tuple(r) for r in stats.histogram(flat, "v", 5, 0, 10).collect()] == [(0, 3)]


def test_quartiles_keep_ties_together(spark):
    data = [(float(s), float(i)) for i, s in enumerate([1] * 6 + [2, 3, 4, 5])]
    df = spark.createDataFrame(data, "s double, t double")
    q = rows_by(stats.quartile_returns(df, "s", "t"), "quartile")
    # The first two edges collapse at 1: one merged bucket.
    assert {k: r["count"] for k, r in q.items()} == {"Q1 Low Risk": 6, "Q3": 1, "Q4 High Risk": 3}


def test_winsorise_train_only(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)] + [(101, 1e9), (102, None)], "cik int, v double")
    low = rows_by(stats.winsorise(df, ["v"], 0.1, 0.9, reference=df.where("cik <= 100")), "cik")
    assert low[101]["v"] == 90.0 and low[0]["v"] == 10.0 and low[102]["v"] is None


def test_coverage_and_domain(spark):
    df = spark.createDataFrame([("micro", 1.0), ("micro", None), (None, 2.0)], "s string, v double")
    r = stats.coverage(df, ["v"]).first()
    assert (r["count"], r["coverage_pct"], r["band"]) == (2, 66.7, "fair")
    d = rows_by(stats.domain_counts(df, "s", ["micro", "small"]), "s")
    assert d["micro"]["count"] == 2 and d["small"]["count"] == 0 and d["micro"]["share"] == 1.0


def test_screen_filters(spark):
    rows = [
        ("AB", "Alpha Beta", None, "HIGH RISK", 80.0, 3, True, 10.0, 0.2),
        ("CD", "Gamma", 2e9, "LOW RISK", None, 0, False, None, None),
        (None, "abacus", 5e9, "MEDIUM RISK", 50.0, 2, False, 90.0, 0.05),
    ]
    df = spark.createDataFrame(
        rows, "ticker string, name string, market_cap double, risk string, fraud_score double, "
        "red_flags_count int, altman_flag boolean, pe_ratio double, roe double",
    )

    def names(**kw):
        return {r["name"] for r in screens.screen(df, screens.ScreenParams(**kw)).collect()}

    assert names() == {"Alpha Beta", "abacus"}
    assert names(risks=()) == {"Alpha Beta", "Gamma", "abacus"}
    assert names(risks=(), cap_low=3e9) == {"Alpha Beta", "abacus"}  # missing cap passes
    assert names(risks=(), min_score=1) == {"Alpha Beta", "abacus"}
    assert names(risks=(), search="ab") == {"Alpha Beta", "abacus"}
    assert names(risks=(), search="a.b", search_is_pattern=False) == set()
    assert names(risks=(), flags=("altman_flag",)) == {"Alpha Beta"}
    assert names(risks=(), max_pe=50) == {"Alpha Beta", "Gamma"}
    assert names(risks=(), min_roe_pct=10) == {"Alpha Beta"}
    assert screens.ScreenParams.preset("Micro (<$300M)").cap_high == 300e6


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "report")
    spark.range(10).selectExpr(
        "id cik", "'T' ticker", "'N' name", "id * 1e8 market_cap", "'HIGH RISK' risk",
        "50.0D fraud_score", "3 red_flags_count", "true altman_flag", "1.0 other",
    ).write.parquet(path)
    out = screens.screen(spark.read.parquet(path), screens.ScreenParams(flags=("altman_flag",), min_flags=1))
    plan = out.select("cik")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "red_flags_count" in pushed and "altman_flag" in pushed and "risk" in pushed
    assert "other" not in plan[plan.index("ReadSchema"):]


def test_alpha_screen_threshold(spark):
    rows = [(i, i, 10.0, "safe", False) for i in range(1, 9)] + [(9, None, 10.0, "safe", False)]
    df = spark.createDataFrame(
        rows, "cik int, magic_formula_rank bigint, fraud_score double, altman_zone string, going_concern_flag boolean"
    )
    # The 25% point of 1..8 is 2.75.
    assert {r["cik"] for r in screens.alpha_screen(df).collect()} == {1, 2}


def test_walk_forward_end_to_end(spark):
    rng = random.Random(8)
    rows = []
    for year in range(2015, 2020):
        for i in range(40):
            x = rng.gauss(0, 1)
            y = 0.3 * x + rng.gauss(0, 0.1)
            rows.append((i, year, y, y > 0, 0.02, x if rng.random() < 0.9 else None))
    df = spark.createDataFrame(
        rows, "cik bigint, fiscal_year int, forward_return_12m double, beat_sp500 boolean, "
        "sp500_return_12m double, roe double",
    )
    splits = {r["test_year"]: r["train_rows"] for r in model.walk_forward_splits(df).collect()}
    assert splits == {2017: 80, 2018: 120, 2019: 160}
    prepared = model.prepare(df, "forward_return_12m")
    fit = model.walk_forward(prepared, "forward_return_12m", "beat_sp500", params=model.TreeParams(trees=2, depth=2))
    metrics = rows_by(model.split_metrics(fit.predictions), "fiscal_year")
    assert set(metrics) == {2017, 2018, 2019, None}
    assert metrics[None]["auc"] > 0.9 and metrics[None]["mae"] < 0.3
    scored = fit.predictions.join(df, ["cik", "fiscal_year"])
    result = model.backtest(scored, "proba", 5).orderBy("fiscal_year").collect()
    assert [r["n_stocks"] for r in result] == [5, 5, 5]
    assert result[-1]["cum_benchmark"] == pytest.approx(1.02**3)
    final = model.fit_final(prepared, "beat_sp500", params=model.TreeParams(trees=2, depth=2))
    one = final.score(df.where("cik = 3 AND fiscal_year = 2019")).collect()
    assert len(one) == 1 and 0 <= one[0]["proba"] <= 1
    top = model.importance_by_horizon({"12m": fit.importances, "all": final.importances(spark)}, 1)
    assert {(r["horizon"], r["feature"]) for r in top.collect()} == {("12m", "roe"), ("all", "roe")}
    assert len(model.FEATURES) == len(set(model.FEATURES)) == 92


def test_registered_walk_forward_is_the_full_model(spark, monkeypatch):
    import __spark_entry__ as entry

    asked, run = [], model.walk_forward_horizons

    def quick(horizons, features=None, params=None):
        asked.append(({n: (h.label, h.beat) for n, h in horizons.items()}, params))
        return run(horizons, features, model.TreeParams(trees=1, depth=1))

    monkeypatch.setattr(model, "walk_forward_horizons", quick)
    monkeypatch.setattr(entry.catalog, "_fits", {})
    metrics = entry.queries()["gbt_walk_forward"](spark, "/root/testdata/sf0.01")
    full = model.TreeParams()
    assert (full.trees, full.depth, full.step, full.subsample, full.columns) == (200, 4, 0.05, 0.8, 0.8)
    labels = {"12m": ("forward_return_12m", "beat_sp500"), "24m": ("forward_return_24m", "beat_sp500_24m")}
    assert asked == [(labels, full)]
    assert set(rows_by(metrics, "horizon", "fiscal_year")) >= {("12m", None), ("24m", None)}
    # The other queries on the fit equal their SQL whatever the number of trees.
    con = compare.connect("/root/testdata/sf0.01")
    for name in ("model_predictions", "model_importance_sums"):
        assert compare.difference(spark, con, name, "/root/testdata/sf0.01")[0] is None
    tested = entry.queries()["model_backtest"](spark, "/root/testdata/sf0.01").collect()
    assert tested and all(r["n_stocks"] == 20 for r in tested)


def test_registered_predictions_take_few_jobs_for_all_trees(spark, monkeypatch):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    entry.catalog.panel(spark, d)
    monkeypatch.setattr(entry.catalog, "_fits", {})
    spark.sparkContext.setJobGroup("predictions", "all trees")
    try:
        assert compare.difference(spark, compare.connect(d), "model_predictions", d)[0] is None
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("predictions"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    (made,) = entry.catalog._fits.values()
    assert all(t.feature.shape == (200, 15) for t in made.fitted.trees) and jobs < 400


def test_registered_final_model_scores_and_explains(spark, monkeypatch):
    import __spark_entry__ as entry

    run = model.fit_final
    monkeypatch.setattr(
        model, "fit_final",
        lambda rows, beat, features=None, params=None: run(rows, beat, features, model.TreeParams(trees=3)),
    )
    monkeypatch.setattr(entry.catalog, "_finals", {})
    con = compare.connect("/root/testdata/sf0.001")
    for name in ("model_final_scores", "model_attribution"):
        assert compare.difference(spark, con, name, "/root/testdata/sf0.001")[0] is None
    reasons = entry.queries()["model_reasons"](spark, "/root/testdata/sf0.001")
    assert reasons.count() > 0 and reasons.where("place > 3").count() == 0


def test_cumulative_growth_survives_total_loss(spark):
    df = spark.createDataFrame([(2000, 0.5, None), (2001, -1.2, 0.1)], "fiscal_year int, strategy double, benchmark double")
    r = rows_by(model.cumulative_growth(df), "fiscal_year")
    assert r[2001]["cum_strategy"] == pytest.approx(1.5 * -0.2)
    assert r[2001]["cum_benchmark"] == pytest.approx(1.1)
