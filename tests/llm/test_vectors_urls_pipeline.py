"""Vector operators, url verdicts, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlynx.llm import clusters, queries, urls, vector_graph, vector_search
from ledgerlynx.llm.common import share_of, table

SF = "/root/testdata/sf0.01"


def _vectors(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids or range(len(x)), x, strict=True)]
    odd = [
        (9_001, None), (9_002, []), (9_003, [0.0] * x.shape[1]), (9_004, [float("nan")] * x.shape[1]),
        (9_005, [None] * x.shape[1]), (9_006, [float("inf")] * x.shape[1]), (None, [1.0] * x.shape[1]),
    ]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


def test_nearest_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (1_500, 16)), np.repeat(rng.normal(0, 1, (1, 16)), 40, axis=0)])
    params = vector_search.SearchParams(list_rows=64, chunk=20)
    got = {}
    frame = vector_search.nearest_neighbours(_vectors(spark, x), F.col("_id") % 100 == 0, params)
    for r in frame.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    hits = 0
    for q in range(0, len(x), 100):
        gap = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        gap[q] = np.inf
        best = np.lexsort((np.arange(len(x)), gap))[:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert got[q] == {k + 1: v for k, v in enumerate(sorted(got[q].values()))}
        for score, i in got[q].values():
            assert score == pytest.approx(gap[i], abs=1e-12)
        hits += len({i for _, i in got[q].values()} & set(best.tolist()))
    assert hits / (10 * len(got)) >= 0.9
    assert sorted(i for _, i in got[1_500].values()) == list(range(1_501, 1_511))


def test_few_repeated_and_no_vectors(spark):
    x = np.array([[1.0, 0], [0, 1], [1, 0], [1, 1]])
    frame = _vectors(spark, x, ids=[0, 1, 0, 3])
    got = vector_search.nearest_neighbours(frame, F.col("_id") == 0).collect()
    assert len(got) == 6
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 0), (1, 0), (2, 3), (2, 3), (3, 1), (3, 1)]
    empty = frame.limit(0)
    assert vector_search.nearest_neighbours(empty, F.col("_id") == 0).count() == 0
    assert vector_graph.near_duplicate_vectors(empty).count() == 0


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(1)
    x, q = rng.normal(0, 1, (4_000, 64)), rng.normal(0, 1, 64)
    gap = np.sqrt(((x - q) ** 2).sum(axis=1))
    bound = np.sort(gap)[20]
    left = vector_search.scan(x, q, bound, vector_search.SearchParams())
    assert set(np.flatnonzero(gap <= bound)) <= set(left.tolist()) and len(left) < 60


def _plain_links(x, at):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= at
    np.fill_diagonal(link, False)
    return link


def test_vector_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (60, 24))
    x = np.vstack([rng.normal(0, 1, (900, 24))] + [c + rng.normal(0, 0.12, (rng.integers(2, 25), 24)) for c in centres])
    x = np.vstack([x, x[:30], 3 * x[30:50]])
    params = vector_graph.GraphParams(shard=128)
    got = {r["vec_id"]: r for r in vector_graph.near_duplicate_vectors(_vectors(spark, x), params).collect()}
    link = _plain_links(x, 0.95)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == root.tolist()
    assert all(got[i]["kept"] == (root[i] == i) for i in range(len(x)))
    assert got[9_003]["n_links"] == 0 and got[9_003]["kept"] and got[9_001]["component_id"] == 9_001
    assert got[None]["component_id"] is None


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = clusters.components(spark.createDataFrame(links, "a long, b long"))
    found = {r["node"]: r["component"] for r in got.collect()}
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(3)
    x = vector_graph._unit(np.vstack([rng.normal(0, 1, (300, 16)), rng.normal(0, 0.1, (80, 16)) + 1]))
    params = vector_graph.GraphParams()
    lists = vector_graph.build_graph(x, params)
    adj = vector_graph._united(len(x), [r[r >= 0] for r in lists], {i: i for i in range(len(x))})
    sim = vector_graph.range_search(x, adj, vector_graph.medoids(x, 8, 0), x, params)
    true = x @ x.T >= 0.95
    assert ((sim >= 0.95) & true).sum() / true.sum() > 0.99
    assert np.isinf(sim).any()  # and does not visit everything


# -- urls ---------------------------------------------------------------------

URLS = {
    "http://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://m.www.example.com/en/x": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://example.com/de": ("example.com", "/de", "com/", "allow"),
    "http://a.net/es/1://b.com/": ("a.net", "/es/1://b.com/", "net/es/", "block"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "x://h?q/en/": ("h", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_url_rules(spark):
    rows = [(i, u, "score", "host") for i, u in enumerate(URLS)] + [(None, "http://a.net/fr/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, score string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, queries.URL_RULES).collect()}
    for i, want in enumerate(URLS.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want
    assert got[None]["verdict"] == "block"
    assert urls.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_model_learns_from_labels(spark):
    labelled = urls.seed_urls(spark)
    hosts = ["big-casino.net", "pills-online.org", "xxx-adult.net", "city-library.net", "physics.school.org"]
    pages = spark.createDataFrame([(i, f"http://{h}/en/7") for i, h in enumerate(hosts)], "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, (), labelled).collect()}
    assert [got[i] for i in range(5)] == ["block", "block", "block", "allow", "allow"]
    one = labelled.where("verdict = 'block'")
    assert {r["verdict"] for r in urls.judge_urls(pages, (), one).collect()} == {"block"}
    assert {r["verdict"] for r in urls.judge_urls(pages, (), one.limit(0)).collect()} == {"allow"}


def test_paths_of_a_neutral_host_decide(spark):
    paths = {
        "/xxx/adult/pills": "block",
        "/viagra-online.html": "block",
        "/casino": "block",
        "/free-poker/win": "block",
        "/": "allow",
        "/en/77": "allow",
        "/science/library.html": "allow",
        "/poems/soup": "allow",
    }
    hosts = ("smith-family.org", "pages.port.net")
    urls_of = [(i, f"https://{h}{p}?q=1") for h in hosts for i, p in enumerate(paths)]
    pages = spark.createDataFrame(urls_of, "page_id int, url string")
    got = {(r["host"], r["path"]): r["verdict"] for r in urls.judge_urls(pages, ()).collect()}
    assert got == {(h, p): v for h in hosts for p, v in paths.items()}


def test_a_very_long_url_is_judged(spark):
    url = "http://" + "a" * 70_000 + ".com/" + "b" * 70_000
    row = urls.judge_urls(spark.createDataFrame([(1, url)], "page_id int, url string"), ()).first()
    assert (len(row["host"]), len(row["path"])) == (70_004, 70_001) and row["verdict"] in ("allow", "block")


def test_url_plan_has_no_python(spark):
    pages = table(spark, SF, "pages")
    plan = urls.judge_urls(pages, queries.URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    seen = [docs]
    for name, stage in p.STAGES[:-1]:
        seen.append(share_of(stage(spark, seen[-1], SF), name))
        assert seen[-1].columns == docs.columns
    good, unique, cut, mixed = seen[1:]
    quality = good.join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in quality}
    assert kept[1] >= 0.97 * labels.join(docs, "doc_id").where("quality = 1").count()
    assert kept.get(0, 0) <= 0.1 * labels.join(docs, "doc_id").where("quality = 0").count()
    assert unique.select("doc_id").distinct().count() == unique.count() < good.count()
    assert unique.select("text").distinct().count() == unique.count()
    assert cut.count() == unique.count()
    assert cut.agg(F.sum("n_chars")).first()[0] < unique.agg(F.sum("n_chars")).first()[0]
    assert mixed.join(cut, "doc_id", "left_anti").count() == 0
    packed = p.STAGES[-1][1](spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("score", F.lit("x"))
    for df in (docs, docs.limit(0)):
        for _, stage in p.STAGES:
            assert stage(spark, df, SF).count() >= 0
