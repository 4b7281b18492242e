"""Lock-step boosting against brute force, another implementation, and enumerated coalitions."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import rows_by
from ledgerlynx.operators import boost, model

FEATURES = ["a", "b", "e"]


def sample(spark, n=400, seed=3, missing=0.1):
    """Two horizons with a bent signal in ``a`` and ``b``; ``e`` is noise."""
    rng, rows = random.Random(seed), []
    for horizon in ("12m", "24m"):
        for i in range(n):
            a, b, e = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
            y = (abs(a) > 0.7) * (1.0 if b > 0 else -1.0) + rng.gauss(0, 0.2)
            a = None if rng.random() < missing else a
            rows.append((horizon, i, 2000 + i % 5, float(y > 0), y, a, b, e))
    names = "horizon string, cik long, fiscal_year int, beat double, actual double, a double, b double, e double"
    return spark.createDataFrame(rows, names)


def fits():
    medians = {"a": 0.1, "b": 0.0, "e": 0.0}
    return [
        boost.Fit("12m", 2003, "logistic", medians),
        boost.Fit("12m", 2003, "squared", medians),
        boost.Fit("24m", 2004, "logistic", medians),
    ]


def test_split_equals_brute_force():
    rng = np.random.default_rng(1)
    params = boost.TreeParams(bins=8, ridge=1.0, least_hessian=2.0)
    for _ in range(20):
        bins = rng.integers(0, 8, size=(60, 4))
        g, h = rng.normal(size=60), rng.uniform(0.1, 1, size=60)
        fixed = [np.rint(x * (1 << 24)).astype(np.int64) for x in (g, h)]
        sums = np.zeros((2, 4, 8), dtype=np.int64)
        for k in range(2):
            for f in range(4):
                np.add.at(sums[k, f], bins[:, f], fixed[k])
        allowed = np.array([True, True, False, True])
        got = boost.best_split(sums, allowed, params)
        best = (-1.0, None)
        for f, b in itertools.product((0, 1, 3), range(7)):
            left = bins[:, f] <= b
            if h[left].sum() < 2 or h[~left].sum() < 2:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (gain, (f, b)), key=lambda x: x[0])
        assert got[:2] == best[1] and got[2] == pytest.approx(best[0], abs=1e-4)


def grown_alone(rows, fit, p, edges):
    """One tree on all rows of a fit, grown on the driver by trying every split."""
    rows = [r for r in rows if r["horizon"] == fit.horizon and r["fiscal_year"] < fit.before]
    x = np.array([[fit.medians[f] if r[f] is None else r[f] for f in FEATURES] for r in rows])
    bins = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(3)], axis=1)
    y = np.array([r["beat"] for r in rows])
    g, h = np.full(len(y), y.mean()) - y, np.full(len(y), y.mean() * (1 - y.mean()))

    def grow(at, depth):
        own = -p.step * g[at].sum() / (h[at].sum() + p.ridge)
        best = (1e-6, None)
        for f, b in itertools.product(range(3), range(p.bins - 1)):
            left, right = at[bins[at, f] <= b], at[bins[at, f] > b]
            if min(h[left].sum(), h[right].sum()) < p.least_hessian:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + p.ridge) for m in (left, right))
            gain -= g[at].sum() ** 2 / (h[at].sum() + p.ridge)
            if gain > best[0] + 1e-9:
                best = (gain, (f, b))
        if not depth or best[1] is None:
            return own
        f, b = best[1]
        return f, b, grow(at[bins[at, f] <= b], depth - 1), grow(at[bins[at, f] > b], depth - 1)

    return grow(np.arange(len(y)), p.depth)


def as_nested(trees, node=0):
    if node >= trees.feature.shape[1]:
        return trees.value[0, node]
    if trees.feature[0, node] < 0:
        return trees.value[0, node]
    kids = [as_nested(trees, 2 * node + k) for k in (1, 2)]
    return (int(trees.feature[0, node]), int(trees.bin[0, node]), *kids)


def same_tree(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return a == pytest.approx(b, abs=1e-5)
    return a[:2] == b[:2] and same_tree(a[2], b[2]) and same_tree(a[3], b[3])


def test_whole_tree_equals_brute_force(spark):
    rows = sample(spark)
    p = boost.TreeParams(trees=1, depth=3, subsample=1.0, columns=1.0, bins=16)
    made = boost.boost(rows, FEATURES, fits(), p)
    held = rows.collect()
    for k in (0, 2):
        assert same_tree(as_nested(made.trees[k]), grown_alone(held, made.fits[k], p, made.edges))


def test_trees_do_not_depend_on_how_rows_are_dealt(spark):
    rows = sample(spark)
    p = boost.TreeParams(trees=4, depth=3, store_every=2)
    one = boost.boost(rows.coalesce(1), FEATURES, fits(), p)
    many = boost.boost(rows.repartition(7), FEATURES, fits(), p)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all()


def test_stored_margins_equal_scoring(spark):
    rows = sample(spark, 200)
    made = boost.boost(rows, FEATURES, fits(), boost.TreeParams(trees=5, depth=3, store_every=2))
    keys = ["horizon", "cik", "fiscal_year"]
    stored = boost.final_margins(made, keys)
    for k, fit in enumerate(made.fits):
        left = rows_by(stored.where(F.col("fit") == k), "cik")
        right = rows_by(boost.score(made, rows.where(F.col("horizon") == fit.horizon), k), "cik")
        assert left.keys() == right.keys()
        assert all(left[i]["margin"] == pytest.approx(right[i]["margin"]) for i in left)


def test_no_fit_sees_its_test_year_or_later(spark):
    rows = sample(spark, 200)
    p = boost.TreeParams(trees=2, depth=3)
    late = F.col("fiscal_year") >= 2003
    changed = rows.withColumn("actual", F.when(late, 99.0).otherwise(F.col("actual")))
    changed = changed.withColumn("beat", F.when(late, 1 - F.col("beat")).otherwise(F.col("beat")))
    first, second = boost.boost(rows, FEATURES, fits()[:2], p), boost.boost(changed, FEATURES, fits()[:2], p)
    for a, b in zip(first.trees, second.trees, strict=True):
        assert a.base == b.base and (a.value == b.value).all()


def test_one_job_per_level(spark):
    rows = sample(spark, 60)
    sc = spark.sparkContext
    sc.setJobGroup("lock-step", "boost")
    try:
        boost.boost(rows, FEATURES, fits(), boost.TreeParams(trees=6, depth=2, store_every=3))
        jobs = len(sc.statusTracker().getJobIdsForGroup("lock-step"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # Adaptive execution runs the two stages of a level as a job each.
    assert jobs <= 2 * 6 * 2 + 20


def test_a_level_is_one_job(spark):
    rows = sample(spark, 60)
    sc = spark.sparkContext
    sc.setJobGroup("one-job", "boost")
    try:
        boost.boost(rows, FEATURES, fits(), boost.TreeParams(trees=20, depth=2, store_every=10))
        jobs = len(sc.statusTracker().getJobIdsForGroup("one-job"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 20 * 2 + 25


def test_only_the_lighter_child_is_counted():
    """Below a split of 30 and 10 rows, one task sums the ten; the rest comes from the parent."""
    n, p = 40, boost.TreeParams(depth=2, bins=4, subsample=1.0)
    fit = boost.Fit("12m", None, "squared")
    bins = np.where(np.arange(n) < 30, 0, 2).astype(np.uint8)[None]
    block = boost.Block(
        bins, {"12m": (0, n)}, np.full(n, 2000), np.zeros(n), np.arange(n, dtype=float),
        np.arange(n).astype(np.uint64), np.zeros((1, n)),
    )
    inner = np.zeros((1, 3), dtype=np.int64)
    trees = boost.Trees(0.0, inner - 1, inner.copy(), np.zeros((1, 3)), np.zeros((1, 7)), np.zeros((1, 7)))

    def state(level):
        opened = [(trees.feature[0], trees.bin[0])]
        return boost._State(
            [fit], p, np.zeros((1, 1), dtype=int), np.zeros(1), np.ones((1, 1), dtype=bool), 0, level,
            [[]], opened, [boost._lighter(trees, 0, level)],
        )

    ((root, whole),) = boost.histograms(iter([block]), state(0))
    trees.feature[0, 0], trees.bin[0, 0], trees.cover[0, 1:3] = 0, 1, (30.0, 10.0)
    below = state(1)
    ((node, part),) = boost.histograms(iter([block]), below)
    assert root == (0, 0) and node == (0, 1)
    assert part[1].sum() == 10 * (1 << 24)
    both = dict(boost._children(((0, 0), (part, whole)), below))
    assert both[0, 0][1].sum() == 30 * (1 << 24) and both[0, 1][1].sum() == 10 * (1 << 24)
    assert (both[0, 0] + both[0, 1] == whole).all()
    # A node without a split hands all on, and nothing of it is counted again.
    trees.feature[0, 0] = -1
    assert not list(boost.histograms(iter([block]), state(1)))
    assert [k for k, _ in boost._children(((0, 0), (None, whole)), state(1))] == [(0, 0)]


def test_no_block_replays_trees(spark, monkeypatch):
    """Blocks are stored every few trees; a new one adds one tree, whatever came before."""
    calls, stored = [], boost._stored
    monkeypatch.setattr(boost, "_stored", lambda *a: calls.append(1) or stored(*a))
    p = boost.TreeParams(trees=6, depth=2, store_every=2)
    some = boost.boost(sample(spark, 60), FEATURES, fits(), p)
    assert len(calls) == 2
    whole = boost.boost(sample(spark, 60), FEATURES, fits(), boost.TreeParams(trees=6, depth=2))
    for a, b in zip(some.trees, whole.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.value == b.value).all()


def test_whole_fits_equal_lock_step(spark):
    """One task for a small fit gives the very trees of lock-step, also when only some are small."""
    rows, p = sample(spark), boost.TreeParams(trees=5, depth=3)
    rows = rows.where("horizon = '24m' OR cik % 2 = 0")
    together = boost.boost(rows.repartition(5), FEATURES, fits(), p)
    counts = [3 * 120, 3 * 120, 3 * 320]  # cells that train each fit
    for cells in (max(counts), min(counts)):
        whole = boost.boost(rows, FEATURES, fits(), p, cells)
        for a, b in zip(whole.trees, together.trees, strict=True):
            assert a.base == b.base and (a.feature >= 0).any()
            for part in ("feature", "bin", "gain", "value", "cover"):
                assert (getattr(a, part) == getattr(b, part)).all(), part
        left, right = (
            rows_by(boost.final_margins(x, ["horizon", "cik"]), "horizon", "cik", "fit") for x in (whole, together)
        )
        assert left.keys() == right.keys() and all(left[i]["margin"] == right[i]["margin"] for i in left)


def test_small_fits_do_not_take_a_job_for_each_level(spark):
    rows = sample(spark, 100)
    horizons = {h: model.Horizon(rows.where(F.col("horizon") == h), "actual", "beat") for h in ("12m", "24m")}
    sc = spark.sparkContext
    made = []
    for trees in (2, 12):
        sc.setJobGroup(f"whole-{trees}", "boost")
        try:
            fit = model.walk_forward_horizons(horizons, FEATURES, boost.TreeParams(trees=trees, depth=3))
            made.append(len(sc.statusTracker().getJobIdsForGroup(f"whole-{trees}")))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(fit.fitted.trees) == 8 and all((t.feature[:, 0] >= 0).any() for t in fit.fitted.trees)
    assert made[0] == made[1]


def test_batches_are_joined_to_blocks():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], names=["x"]) for n in (3, 0, 4, 5, 1)]
    assert [b.num_rows for b in boost._joined(iter(batches), 6)] == [7, 6]
    assert not list(boost._joined(iter(batches[1:2]), 6))


def test_no_worse_than_another_implementation(spark):
    rng, rows = random.Random(5), []
    for i in range(4_000):
        a, b, e = (rng.gauss(0, 1) for _ in range(3))
        y = (b if abs(a) > 0.7 else -b) + rng.gauss(0, 0.1)
        rows.append(("12m", i, 2000 + i % 5, float(y > 0), y, a, b, e))
    rows = spark.createDataFrame(rows, sample(spark, 1).schema)
    train, test = rows.where("fiscal_year < 2004"), rows.where("fiscal_year = 2004")
    p = boost.TreeParams(trees=30, depth=3, step=0.1, subsample=1.0, columns=1.0)
    fit = boost.Fit("12m", 2004, "logistic", {})
    made = boost.boost(rows, FEATURES, [fit], p)
    own = boost.score(made, test).select("beat", F.col("margin").alias("s"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    other = GBTClassifier(labelCol="beat", maxIter=30, maxDepth=3, stepSize=0.1, seed=1)
    scored = other.fit(vectors.transform(train)).transform(vectors.transform(test))
    scored = scored.select("beat", vector_to_array("probability")[1].alias("s"))
    ours, theirs = (model.auc(x, "beat", "s").first()["auc"] for x in (own, scored))
    assert ours > 0.95 and ours >= theirs - 0.01, theirs


def expected_value(trees, bins, known, i, node=0):
    """Mean of a tree where only the features in ``known`` decide."""
    if node >= trees.feature.shape[1]:
        return trees.value[i, node]
    f = trees.feature[i, node]
    if f < 0:
        return expected_value(trees, bins, known, i, 2 * node + 1)
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return expected_value(trees, bins, known, i, left if bins[f] <= trees.bin[i, node] else right)
    w = trees.cover[i, left] / trees.cover[i, node]
    parts = [expected_value(trees, bins, known, i, n) for n in (left, right)]
    return w * parts[0] + (1 - w) * parts[1]


def test_attributions_equal_enumerated_coalitions(spark):
    rows = sample(spark, 120)
    made = boost.boost(rows, FEATURES, fits()[:1], boost.TreeParams(trees=3, depth=4))
    some = rows.where("horizon = '12m' AND cik < 12").select("cik", *FEATURES)
    got = {}
    for r in boost.attributions(made, some).collect():
        got.setdefault(r["cik"], {})[r["feature"]] = r["contribution"]
        assert math.isfinite(r["margin"])
    trees, fill = made.trees[0], made.fits[0].medians
    for r in some.collect():
        values = [fill[f] if r[f] is None else r[f] for f in FEATURES]
        bins = [int(np.searchsorted(e, v, side="left")) for e, v in zip(made.edges, values, strict=True)]
        for f, name in enumerate(FEATURES):
            others, phi = [x for x in range(3) if x != f], 0.0
            for size in range(3):
                weight = math.factorial(size) * math.factorial(2 - size) / 6
                for held in itertools.combinations(others, size):
                    for i in range(3):
                        with_f = expected_value(trees, bins, {*held, f}, i)
                        phi += weight * (with_f - expected_value(trees, bins, set(held), i))
            assert got[r["cik"]].get(name, 0.0) == pytest.approx(phi, abs=1e-9)


def test_attributions_sum_to_the_margin(spark):
    rows = sample(spark, 200)
    made = boost.boost(rows, FEATURES, fits()[:1], boost.TreeParams(trees=8, depth=4))
    asked = rows.where("horizon = '12m'").select("cik", *FEATURES)
    parts = boost.attributions(made, asked).groupBy("cik").agg(
        F.sum("contribution").alias("moved"), F.first("base").alias("base"), F.first("margin").alias("m")
    )
    scored = rows_by(boost.score(made, asked), "cik")
    found = rows_by(parts, "cik")
    assert found.keys() == scored.keys()
    for i, r in found.items():
        assert r["moved"] + r["base"] == pytest.approx(scored[i]["margin"])
        assert r["m"] == pytest.approx(scored[i]["margin"])
