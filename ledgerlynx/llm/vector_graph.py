"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node.  Nodes are dealt to overlapping cluster shards: each goes to
its nearest centroids, which a bounded sample fits.  Each shard builds a graph whose
neighbour lists are pruned robustly; the lists of a node from all its shards are united.
A greedy search from the shard's medoids widens over every node in range, finds each node's
links, and exact cosines in double precision confirm them.  Found links connect components;
within a component all cosines are counted, so a link the search missed still counts.

A stated audit set is compared with all nodes; while too few of its true links lie within
one component, the shards' overlap grows and the search is run again.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite number, or
one without an id, links with nothing; repeated rows are copies of each other; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import bounded_sample, components, fit_centroids, matrix, nearest
from .common import finite, share_of


@dataclass(frozen=True)
class GraphParams:
    """``sample`` bounds the vectors that fit centroids, ``audit`` those of the audit set."""

    cosine: float = 0.95
    overlap: int = 3
    shard: int = 1_024
    sample: int = 16_384
    degree: int = 24
    far: int = 8
    alpha: float = 1.2
    beam: int = 16
    medoids: int = 8
    audit: int = 256
    recall: float = 0.999
    seed: int = 11


def build_graph(x: np.ndarray, params: GraphParams) -> np.ndarray:
    """Neighbour lists (rows of node numbers, -1 for none) of unit vectors, pruned robustly."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    rng = np.random.default_rng(params.seed)
    near = min(n - 1, 2 * params.degree)
    close = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near > 0 else np.zeros((n, 0), int)
    strange = rng.integers(0, n, (n, 2 * params.far))
    return np.hstack([_prune(sims, close, params.degree, params.alpha), _prune(sims, strange, params.far, params.alpha)])


def _prune(sims: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Nearest candidates first; a kept one drops those it is clearly nearer to than the node."""
    n = len(sims)
    rows = np.arange(n)[:, None]
    own = np.take_along_axis(sims, found, 1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(own), own, -1)))
    live = np.isfinite(own)
    out = np.full((n, degree), -1)
    for k in range(degree):
        score = np.where(live, own, -np.inf)
        if not score.size or not live.any():
            break
        at = score.argmax(axis=1)
        good = live[rows[:, 0], at]
        pick = found[rows[:, 0], at]
        out[good, k] = pick[good]
        between = np.where(found == pick[:, None], 1.0, sims[pick[:, None], found])
        apart = np.sqrt(np.maximum(0, 2 - 2 * between))
        live &= ~((alpha * apart <= gap) & good[:, None])
        live[rows[:, 0], at] = False
    return out


def medoids(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Rows nearest to the means of ``n`` parts of the shard."""
    means = fit_centroids(x, n, seed, rounds=3)
    return np.unique(np.argmax(means @ x.T, axis=1))


def range_search(x, links, starts, queries, params: GraphParams) -> np.ndarray:
    """Similarity of every query to the nodes it visits; -inf where the search never came.

    A query expands its best ``beam`` nodes until none is new, and every node in range.
    """
    sim = np.full((len(queries), len(x)), -np.inf)
    done = np.zeros(sim.shape, dtype=bool)

    def visit(mask: np.ndarray) -> None:
        r, c = np.nonzero(mask & np.isinf(sim))
        for i in range(0, len(r), 1 << 16):
            a, b = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
            sim[a, b] = np.einsum("ij,ij->i", queries[a], x[b])

    first = np.zeros(sim.shape, dtype=bool)
    first[:, starts] = True
    visit(first)
    beam = min(params.beam, len(x))
    while True:
        least = -np.partition(-sim, beam - 1, axis=1)[:, beam - 1 : beam]
        front = ~done & (sim > -np.inf) & ((sim >= least) | (sim >= params.cosine - 0.02))
        if not front.any():
            return sim
        done |= front
        visit(front.astype(np.float32) @ links > 0)


def _united(n: int, lists: list[np.ndarray], index: dict[int, int]) -> np.ndarray:
    """Adjacency of the shard's nodes from their united lists, both ways."""
    out = np.zeros((n, n), dtype=np.float32)
    for i, ids in enumerate(lists):
        at = [index[j] for j in ids if j in index]
        out[i, at] = 1
        out[at, i] = 1
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node number of each node's component within a shard."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _nodes(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(node, copies, vec): distinct usable vectors under their least id."""
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")
    )
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("vec")))
    return rows.groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _search_links(nodes: DataFrame, n: int, params: GraphParams) -> DataFrame:
    """(a, b): each node and the least node its shard's links connect it with."""
    spark = nodes.sparkSession
    sample = _unit(bounded_sample(nodes, params.sample, params.seed))
    k = int(min(-(-n * params.overlap // params.shard), max(1, len(sample) // 8)))
    centroids = fit_centroids(sample, k, params.seed)
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def shards(vec: pd.Series) -> pd.Series:
        return pd.Series(list(nearest(_unit(matrix(vec)), shared.value, params.overlap)))

    members = share_of(
        nodes.select("node", "vec", F.explode(shards("vec")).alias("shard")), "shard-members"
    )
    # A shard far above its size is built in parts; each part is searched by all its members.
    # One row for each of at most sample / 8 shards.
    sizes = members.groupBy("shard").count().select(
        "shard", F.ceil(F.col("count") / (2 * params.shard)).cast("int").alias("parts")
    )
    members = members.join(F.broadcast(sizes), "shard")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    base = members.select("node", "vec", "shard", part.alias("part"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(matrix(group["vec"])), group["node"].to_numpy()
        lists = build_graph(x, params)
        near = [ids[row[row >= 0]] for row in lists]
        return pd.DataFrame({"node": ids, "near": near})

    lists = base.groupBy("shard", "part").applyInPandas(build, "node long, near array<long>")
    united = lists.groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")
    )
    graph = share_of(base.join(united, "node"), "shard-graph")
    asked = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(key: tuple, group: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(queries):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        group = group.sort_values("node")
        x, ids = _unit(matrix(group["vec"])), group["node"].to_numpy()
        links = _united(len(ids), group["near"].tolist(), {j: i for i, j in enumerate(ids.tolist())})
        starts = medoids(x, params.medoids, params.seed)
        names = np.concatenate([ids, queries["node"].to_numpy()])
        names, place = np.unique(names, return_inverse=True)
        here, there = place[: len(ids)], place[len(ids) :]
        a, b = [], []
        for low in range(0, len(queries), 256):
            q = _unit(matrix(queries["vec"].iloc[low : low + 256]))
            r, c = np.nonzero(range_search(x, links, starts, q, params) >= params.cosine)
            a.append(there[low + r])
            b.append(here[c])
        root = _roots(len(names), np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": names, "b": names[root]})[root != np.arange(len(names))]

    return (
        graph.groupBy("shard", "part")
        .cogroup(asked.select("node", "vec", "shard", "part").groupBy("shard", "part"))
        .applyInPandas(search, "a long, b long")
    )


def audit_recall(labelled: DataFrame, params: GraphParams) -> float:
    """Share of the true links of the audit nodes that lie within one component."""
    order = F.xxhash64(F.lit(params.seed + 1), "node")
    asked = labelled.orderBy(order).limit(params.audit).toPandas()  # bounded by ``audit``
    q, own = matrix(asked["vec"]), asked["component"].to_numpy()
    names = asked["node"].to_numpy()
    if not len(q):
        return 1.0

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            link = _unit(matrix(b["vec"])) @ _unit(q).T >= params.cosine
            link &= b["node"].to_numpy()[:, None] != names
            same = b["component"].to_numpy()[:, None] == own
            yield pd.DataFrame({"links": [link.sum()], "found": [(link & same).sum()]})

    got = (
        labelled.select("node", "vec", "component")
        .mapInPandas(compare, "links long, found long")
        .agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
        .first()
    )
    return got["found"] / got["links"] if got["links"] else 1.0


def _count_links(groups: DataFrame, params: GraphParams) -> DataFrame:
    """(node, others): copies of other nodes in range, by blocks of a component's nodes."""
    size = groups.groupBy("component").agg(F.count("*").alias("n"))
    # Blocks of 512 nodes at most; from 64 nodes on, several blocks share the work.
    parts = F.greatest(F.ceil(F.col("n") / 512), F.least(F.lit(8), F.ceil(F.col("n") / 64)))
    dealt = groups.join(size, "component").withColumn("parts", parts.cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.withColumn("other", other)
    # New names, as both sides come from one table.
    right = left.select(
        F.col("component").alias("c"),
        F.col("other").alias("row"),
        F.col("own").alias("column"),
        F.col("node").alias("mate"),
        F.col("copies").alias("copies"),
        F.col("vec").alias("mate_vec"),
    )
    left = left.select("component", "own", "other", "node", "vec")

    def count(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"node": a["node"], "others": np.zeros(len(a), dtype=np.int64)})
        link = _unit(matrix(a["vec"])) @ _unit(matrix(b["mate_vec"])).T >= params.cosine
        link &= a["node"].to_numpy()[:, None] != b["mate"].to_numpy()
        return pd.DataFrame({"node": a["node"], "others": link @ b["copies"].to_numpy()})

    counted = (
        left.groupBy("component", "own", "other")
        .cogroup(right.groupBy("c", "row", "column"))
        .applyInPandas(count, "node long, others long")
    )
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def near_duplicate_vectors(
    vectors: DataFrame,
    params: GraphParams = GraphParams(),
    key: str = "vec_id",
    vec: str = "embedding",
) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.  Reads key and vector only."""
    nodes = share_of(_nodes(vectors, key, vec), "vector-nodes")
    n = nodes.count()
    ids = "node long, component long"
    reached = vectors.sparkSession.createDataFrame([], ids)
    while n:
        links = _search_links(nodes, n, params)
        reached = share_of(components(links), "vector-components")
        labelled = nodes.join(reached, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        if audit_recall(labelled, params) >= params.recall or params.overlap >= 24:
            break
        params = replace(params, overlap=2 * params.overlap)
    groups = nodes.join(reached, "node")
    counts = _count_links(groups, params)
    known = (
        nodes.join(reached, "node", "left")
        .join(counts, "node", "left")
        .select(
            "vec",
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            F.coalesce("component", "node").alias("_component"),
        )
    )
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")
    )
    usable = F.col("vec_id").isNotNull() & finite(F.col("vec"))
    joined = rows.where(usable).join(known, "vec", "left").drop("vec")
    # Rows that link with nothing stay out of the join, where they would share one key.
    alone = rows.where(~usable).select(
        "vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_component")
    )
    return joined.unionByName(alone).select(
        "vec_id",
        F.col("_links").alias("n_links"),
        F.col("_component").alias("component_id"),
        (F.col("_component") == F.col("vec_id")).alias("kept"),
    )
