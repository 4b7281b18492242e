"""Nearest neighbours by an adaptive dimension scan of inverted lists.

Equal vectors are one class with its least ids.  Vectors are rotated and dealt to the
list of their nearest centroid.  A query visits the lists nearest to it; within a list,
the rotated dimensions are read in column blocks, and after each block a hypothesis test
abandons the candidates whose partial distance shows that the whole one would exceed the
query's bound.  Survivors get exact distances of the original vectors in double precision.

The first bound of a query is its k-th distance to rows of a bounded sample in the lists it
visits, an upper bound of the one the visit can find.  A query that still ends with fewer
rows than it should visits every list without tests.  How many lists are visited follows from the same sample: the
lists that hold its true neighbours, measured by brute force, at the wanted recall.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite number, or
one without an id, is neither query nor candidate; repeated rows are candidates of each
other; with fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import bounded_sample, fit_centroids, matrix, nearest
from .common import finite, share_of


@dataclass(frozen=True)
class SearchParams:
    """``sample`` bounds the vectors that fit the index, ``tuning`` the queries that tune it."""

    k: int = 10
    sample: int = 16_384
    tuning: int = 256
    recall: float = 0.98
    list_rows: int = 256
    chunk: int = 2_048
    block: int = 16
    doubt: float = 3.0
    seed: int = 23


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    sample: np.ndarray  # rotated
    lists: np.ndarray  # of the sample
    probes: int


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_index(sample: np.ndarray, n: int, params: SearchParams) -> Index:
    """Rotation, centroids, and as many probes as the wanted recall takes on the sample."""
    turn = rotation(sample.shape[1], params.seed)
    x = sample @ turn
    k = int(max(1, min(-(-n // params.list_rows), len(x) // 8)))
    centroids = fit_centroids(x, k, params.seed)
    k = len(centroids)
    own = nearest(x, centroids, 1)[:, 0]
    asked = x[: params.tuning]
    order = nearest(asked, centroids, k)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(k)[None, :], 1)
    gap = (x**2).sum(axis=1) - 2 * asked @ x.T
    gap[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    m = min(params.k, len(x) - 1)
    if m < 1:
        return Index(turn, centroids, x, own, k)
    best = np.argpartition(gap, m - 1, axis=1)[:, :m]
    needed = np.sort(place[np.arange(len(asked))[:, None], own[best]].ravel())
    probes = int(needed[int(np.ceil(params.recall * len(needed))) - 1]) + 1
    return Index(turn, centroids, x, own, probes)


def scan(x: np.ndarray, query: np.ndarray, bound: float, params: SearchParams) -> np.ndarray:
    """Rows of rotated ``x`` that survive every column block for a query and its bound.

    After t of d dimensions, a row is abandoned if its squared distance so far exceeds
    ``bound**2 * t / d * (1 + doubt / sqrt(t))**2``.
    """
    d = x.shape[1]
    left = np.arange(len(x))
    part = np.zeros(len(x))
    for low in range(0, d, params.block):
        high = min(d, low + params.block)
        gap = x[left, low:high] - query[low:high]
        part = part + np.einsum("ij,ij->i", gap, gap)
        slack = (1 + params.doubt / np.sqrt(high)) if high < d else 1 + 1e-9
        limit = bound * bound * (high / d) * slack * slack
        good = part <= limit + 1e-12
        left, part = left[good], part[good]
        if not len(left):
            break
    return left


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(cls, ids, vec): distinct vectors with their ``keep`` least ids."""
    first = Window.partitionBy("vec").orderBy("id")
    return (
        rows.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= keep)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("cls"), "ids", "vec")
    )


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    params: SearchParams = SearchParams(),
    key: str = "vec_id",
    vec: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every query row.

    ``is_query`` is a condition on ``_id``.  Reads key and vector only.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")
    ).where(F.col("id").isNotNull() & finite(F.col("vec")))
    classes = share_of(_classes(rows, params.k + 1), "vector-classes")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = classes.count()
    if not n:
        return empty
    index = fit_index(bounded_sample(classes, params.sample, params.seed), n, params)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def own_list(v: pd.Series) -> pd.Series:
        x = shared.value
        return pd.Series(nearest(matrix(v) @ x.rotation, x.centroids, 1)[:, 0])

    @F.pandas_udf("struct<lists:array<int>,bound:double>")
    def visits(v: pd.Series) -> pd.DataFrame:
        x, q = shared.value, matrix(v)
        turned = q @ x.rotation
        lists = nearest(turned, x.centroids, x.probes)
        gap = (turned**2).sum(axis=1)[:, None] + (x.sample**2).sum(axis=1) - 2 * turned @ x.sample.T
        seen = np.zeros((len(q), len(x.centroids)), dtype=bool)
        np.put_along_axis(seen, lists, True, 1)
        gap[~seen[:, x.lists]] = np.inf
        # The query's own class may be in the sample and offer no other row.
        m = params.k + 1
        bound = np.full(len(q), np.inf)
        if len(x.sample) >= m:
            bound = np.sqrt(np.maximum(0, np.partition(gap, m - 1, axis=1)[:, m - 1])) + 1e-6
        return pd.DataFrame({"lists": list(lists), "bound": bound})

    base = classes.select("cls", "ids", "vec", own_list("vec").alias("list"))
    base = share_of(base, "vector-lists")
    # One row for each of at most sample / 8 lists.
    sizes = base.groupBy("list").count().select(
        "list", F.ceil(F.col("count") / params.chunk).cast("int").alias("parts")
    )
    asked_rows = share_of(
        rows.withColumn("_id", F.col("id")).where(is_query).select("id", "vec"), "vector-queries"
    )
    asked = asked_rows.select("vec").distinct()
    asked = asked.join(classes.select("vec", "cls"), "vec")
    asked = share_of(asked.select("cls", "vec"), "vector-asked")
    visiting = asked.repartition("cls").select("cls", "vec", visits("vec").alias("v"))
    visiting = visiting.select("cls", "vec", "v.bound", F.explode("v.lists").alias("list"))
    everywhere = F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))
    base = base.join(F.broadcast(sizes), "list").withColumn(
        "part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    )

    def compare(key: tuple, group: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        cls, ids, score = [], [], []
        if len(group) and len(queries):
            group = group.sort_values("cls")
            x, q = matrix(group["vec"]), matrix(queries["vec"])
            turn = shared.value.rotation
            turned, turned_q = x @ turn, q @ turn
            names = group["ids"].tolist()
            for i, (own, bound) in enumerate(zip(queries["cls"], queries["bound"], strict=True)):
                left = scan(turned, turned_q[i], bound, params)
                if not len(left):
                    continue
                exact = np.sqrt(((x[left] - q[i]) ** 2).sum(axis=1))
                best = np.argsort(exact, kind="stable")
                # Ties at the last place all stay; each class has at least one id.
                best = best[exact[best] <= exact[best[min(params.k, len(best) - 1)]]]
                for j in best:
                    cls.append(own)
                    ids.append(names[left[j]])
                    score.append(exact[j])
        out = pd.DataFrame({"cls": np.array(cls, dtype=np.int64), "score": np.array(score, dtype=float)})
        out.insert(1, "ids", pd.Series(ids, dtype=object))
        return out

    # A row repeated with its id stands as often in its class; both stay apart here.
    copies = Window.partitionBy("cls", "vec_id").orderBy("score")
    order = Window.partitionBy("cls").orderBy("score", "vec_id", "_copy")

    def visit(who: DataFrame) -> DataFrame:
        dealt = who.join(F.broadcast(sizes), "list").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        )
        found = (
            base.select("cls", "ids", "vec", "list", "part")
            .groupBy("list", "part")
            .cogroup(dealt.select("cls", "vec", "bound", "list", "part").groupBy("list", "part"))
            .applyInPandas(compare, "cls long, ids array<long>, score double")
            .select("cls", "score", F.explode("ids").alias("vec_id"))
        )
        best = (
            found.withColumn("_copy", F.row_number().over(copies))
            .withColumn("_n", F.row_number().over(order))
            .where(F.col("_n") <= params.k + 1)
        )
        return best.groupBy("cls").agg(
            F.sort_array(F.collect_list(F.struct("score", "vec_id", "_copy"))).alias("found")
        )

    lists = share_of(visit(visiting), "vector-found")
    full = lists.where(F.size("found") > params.k)
    short = asked.join(full, "cls", "left_anti")
    again = short.select(
        "cls", "vec", F.lit(float("inf")).alias("bound"), F.explode(everywhere).alias("list")
    )
    lists = full.unionByName(visit(again))
    # One copy of the query's own row goes; if it is not among them, the last one does.
    named = asked_rows.join(classes.select("vec", "cls"), "vec").join(lists, "cls")
    own = F.array_position(F.transform("found", lambda f: f["vec_id"]), F.col("id"))
    kept = F.filter("found", lambda f, i: (F.col("_own") == 0) | (i != F.col("_own") - 1))
    return (
        named.withColumn("_own", own)
        .select("id", F.posexplode(F.slice(kept, 1, params.k)).alias("pos", "f"))
        .select(
            F.col("id").alias("query_id"),
            (F.col("pos") + 1).cast("int").alias("rank"),
            F.col("f.vec_id").alias("vec_id"),
            F.col("f.score").alias("score"),
        )
    )
