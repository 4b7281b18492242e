"""Gradient-boosted trees for many fits at once, grown in lock-step.

Walk-forward evaluation fits one classifier and one regressor for every test year and
horizon.  All of them share one table of binned features, and every level of every tree is
one Spark job for all fits together: tasks send each of their rows down the open tree,
sum gradients and hessians by (fit, node, feature, bin), and a second stage adds the sums of
all tasks and picks the best split of each node.  The driver sees one row per node and holds
the trees; both are bounded by fits, trees and depth.

Sums are 64-bit integers of fixed-point gradients, so trees are the same however rows are
dealt to tasks and in whatever order tasks are added up.  Rows are held in blocks of one
few batches, feature by feature, with their margins, in an RDD that Spark keeps in memory or
on disk; after each tree a new one adds that tree's leaves.  Every ``store_every`` trees the
blocks are stored, so a lost executor repeats at most that many steps.  Of the two children of
a split only the lighter one is counted, the other has what is left of its parent.

A job for every level costs more than it counts while a fit is small.  A fit whose training
rows fill at most one ordinary partition can therefore be grown by one task, with the same
sums and splits; all of those are one job with a task for each fit.  Larger ones grow as above.

Missing values take the median of the training rows of their fit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

MISSING = 255
BLOCK_ROWS = 1 << 15  # a block takes whole Arrow batches until it has as many
BLOCK_COLUMNS = ["horizon", "fiscal_year", "beat", "actual", "row_key", "bins"]
WHOLE_CELLS = 1 << 27  # rows x features of a fit that one task may grow: 128 MB of bins
_SCALE = float(1 << 24)  # fixed point of gradients; sums of a batch stay exact in a double
_STEP, _M1 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class TreeParams:
    trees: int = 200
    depth: int = 4
    step: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    ridge: float = 1.0
    least_hessian: float = 1.0
    bins: int = 64
    store_every: int = 20
    seed: int = 42


@dataclass(frozen=True)
class Fit:
    """One model: rows of ``horizon`` before ``before`` (all, if None) train it.

    ``kind`` is ``logistic`` (column ``beat``) or ``squared`` (column ``actual``).
    """

    horizon: str
    before: int | None
    kind: str
    medians: dict[str, float] = field(default_factory=dict, hash=False)


@dataclass
class Trees:
    """The trees of one fit as arrays: node ``i`` has the children ``2i+1`` and ``2i+2``.

    ``feature`` is -1 where a node does not split; its values are those of its parent then.
    """

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    bin: np.ndarray
    gain: np.ndarray
    value: np.ndarray  # (trees, all nodes), step included
    cover: np.ndarray  # (trees, all nodes), sum of hessians


# -- binning ------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of at most ``bins`` bins per feature, from one aggregate of sketches."""
    if bins >= MISSING:
        raise ValueError(f"at most {MISSING - 1} bins")
    probs = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    cells = [F.percentile_approx(F.col(f).cast("double"), probs, 10_000).alias(f) for f in features]
    row = rows.agg(*cells).first()
    return [np.unique(np.array(row[f] or [], dtype=float)) for f in features]


def _bin_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of edges below each value; a value on an edge belongs to the lower bin."""
    at = np.searchsorted(edges, values, side="left").astype(np.uint8)
    at[np.isnan(values)] = MISSING
    return at


def binned_rows(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """``rows`` with the columns ``features`` replaced by ``bins``, one byte per feature."""
    keep = [c for c in rows.columns if c not in set(features)]
    n = len(features)

    def bin_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.empty((batch.num_rows, n), dtype=np.uint8)
            for k, name in enumerate(features):
                column = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
                cells[:, k] = _bin_of(column, edges[k])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], _cells(cells)], names=[*keep, "bins"]
            )

    doubles = rows.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return doubles.mapInArrow(bin_them, f"{kept}, bins binary")


def _cells(rows: np.ndarray) -> pa.Array:
    """A matrix as one binary value per row."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    ends = pa.py_buffer((np.arange(len(data) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(data.tobytes())])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


# -- what a task does ---------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(keys: np.ndarray, tag: int, share: float) -> np.ndarray:
    """A seeded choice of about ``share`` of the keys."""
    if share >= 1:
        return np.ones(len(keys), dtype=bool)
    return _mix(keys ^ np.uint64(tag * _STEP & _MASK)) < np.uint64(int(share * _MASK))


def leaf_of(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: int) -> np.ndarray:
    """Node that each row reaches after ``depth`` levels of one tree."""
    node = np.zeros(len(bins), dtype=np.int64)
    at = np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        right = (f >= 0) & (bins[at, np.maximum(f, 0)] > split[node])
        node = 2 * node + 1 + right
    return node


@dataclass(frozen=True)
class _State:
    """What a job needs besides the blocks: the trees to add to margins, and the open one."""

    fits: Sequence[Fit]
    params: TreeParams
    median_bins: np.ndarray  # (fits, features)
    bases: np.ndarray  # (fits,)
    columns: np.ndarray  # (fits, features): drawn for the open tree
    tree: int
    level: int
    done: Sequence[list[tuple]]  # per fit: (feature, bin, value) of trees not yet in margins
    open: Sequence[tuple]  # per fit: (feature, bin) of the open tree
    counted: Sequence[np.ndarray]  # per fit: the nodes of the level whose rows are summed
    numbers: Sequence[int] = ()  # per fit: its number among all fits, which its draws depend on


@dataclass
class Block:
    """The rows of a few batches, ordered by horizon and fiscal year, one line per feature.

    A missing value has the bin after the last one.  ``spans`` holds the rows of a horizon.
    """

    bins: np.ndarray  # (features, rows)
    spans: dict[str, tuple[int, int]]
    year: np.ndarray
    beat: np.ndarray
    actual: np.ndarray
    keys: np.ndarray
    margins: np.ndarray  # (fits, rows); those of another horizon stay at the base

    def training(self, fit: Fit) -> slice:
        """The rows that train ``fit``: neighbours, as rows are ordered."""
        low, high = self.spans.get(fit.horizon, (0, 0))
        if fit.before is not None:
            high = low + int(np.searchsorted(self.year[low:high], fit.before))
        return slice(low, high)


def _walk(
    bins: np.ndarray, tree: tuple, fill: np.ndarray, missing: int, depth: int, at: np.ndarray | None = None
) -> np.ndarray:
    """:func:`leaf_of` for the rows ``at`` (all, if None) of ``bins`` by feature, where a
    missing value has the bin ``fill``."""
    feature, split = tree
    line, at = np.maximum(feature, 0), np.arange(bins.shape[1]) if at is None else at
    # A node without a split sends all left; a missing value goes where the median goes.
    split = np.where(feature >= 0, split, MISSING)
    missing_right = fill[line] > split
    node = np.zeros(len(at), dtype=np.int64)
    for _ in range(depth):
        value = bins[line[node], at]
        right = np.where(value == missing, missing_right[node], value > split[node])
        node = 2 * node + 1 + right
    return node


def _add_trees(block: Block, state: _State) -> Block:
    """The block with the trees ``state.done`` in its margins."""
    margins, p = block.margins.copy(), state.params
    for k, fit in enumerate(state.fits):
        low, high = block.spans.get(fit.horizon, (0, 0))
        if low < high:
            bins = block.bins[:, low:high]
            for feature, split, value in state.done[k]:
                leaf = _walk(bins, (feature, split), state.median_bins[k], p.bins, p.depth)
                margins[k, low:high] += value[leaf]
    return replace(block, margins=margins)


def _block_of(batch: pa.RecordBatch, state: _State) -> Block:
    year = batch.column("fiscal_year").to_numpy(zero_copy_only=False)
    horizon = np.array(batch.column("horizon").to_pylist(), dtype=str)
    order = np.lexsort((year, horizon))
    horizon = horizon[order]
    names, first = np.unique(horizon, return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    bins = _matrix(batch.column("bins"), np.uint8, state.median_bins.shape[1])[order]
    bins = np.where(bins == MISSING, np.uint8(state.params.bins), bins)
    beat, actual, keys = (
        batch.column(x).to_numpy(zero_copy_only=False)[order] for x in ("beat", "actual", "row_key")
    )
    return Block(
        np.ascontiguousarray(bins.T),
        {str(n): (int(a), int(b)) for n, a, b in zip(names, first, ends, strict=True)},
        year[order], beat, actual, keys.view(np.uint64),
        np.repeat(state.bases[:, None], len(order), axis=1),
    )


def _blocks(table: DataFrame, state: _State) -> RDD:
    """The stored table as blocks, margins at the base."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, BLOCK_ROWS):
            data = pickle.dumps(_block_of(batch, state), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["block"])

    needed = table.select(*BLOCK_COLUMNS)
    return needed.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, until it has ``rows`` rows; none is empty."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _stored(blocks: RDD, spark: SparkSession) -> RDD:
    """The blocks, written to the shared folder and read back."""
    packed = blocks.map(lambda b: (pickle.dumps(b, protocol=5),))
    table = materialise(spark.createDataFrame(packed, "block binary"), "blocks")
    return table.rdd.map(lambda r: pickle.loads(r["block"]))


def _gradients(kind: str, margin: np.ndarray, target: np.ndarray):
    if kind == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - target, np.maximum(p * (1 - p), 1e-16)
    return margin - target, np.ones(len(margin))


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _SCALE)


def histograms(blocks: Iterator[Block], state: _State) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((fit, node), sums): gradient and hessian sums of one task by feature and bin.

    Only the nodes in ``state.counted`` are summed.  Features that are not drawn for the open
    tree stay zero, the first one excepted: it carries the totals.
    """
    p, nodes, nf = state.params, 1 << state.level, state.median_bins.shape[1]
    first, wide = nodes - 1, p.bins + 1
    sums: dict[int, np.ndarray] = {}
    met: dict[int, np.ndarray] = {}
    for block in blocks:
        for k, fit in enumerate(state.fits):
            rows = block.training(fit)
            number = state.numbers[k] if state.numbers else k
            drawn = _drawn(block.keys[rows], (p.seed << 32) + state.tree * 131 + number, p.subsample)
            at = rows.start + np.flatnonzero(drawn)
            node = _walk(block.bins, state.open[k], state.median_bins[k], p.bins, state.level, at) - first
            kept = state.counted[k][node]
            at, node = at[kept], node[kept]
            if not len(at):
                continue
            target = (block.beat if fit.kind == "logistic" else block.actual)[at]
            g, h = (_fixed(x) for x in _gradients(fit.kind, block.margins[k, at], target))
            if k not in sums:
                sums[k] = np.zeros((2, nf, nodes * wide), dtype=np.int64)
                met[k] = np.zeros(nodes, dtype=bool)
            met[k][node] = True
            offset, size = node * wide, nodes * wide
            for f in range(nf):
                if f == 0 or state.columns[k, f]:
                    cell = block.bins[f].take(at) + offset
                    sums[k][0, f] += np.bincount(cell, g, size).astype(np.int64)
                    if fit.kind == "squared":  # every hessian is one
                        sums[k][1, f] += np.bincount(cell, minlength=size) * int(_SCALE)
                    else:
                        sums[k][1, f] += np.bincount(cell, h, size).astype(np.int64)
    for k, found in sums.items():
        cells = found.reshape(2, nf, nodes, wide)
        # Missing values count in the bin of the median.
        cells[:, np.arange(nf), :, state.median_bins[k]] += cells[..., p.bins].transpose(1, 0, 2)
        for n in np.flatnonzero(met[k]):
            yield (k, int(n)), np.ascontiguousarray(cells[:, :, n, : p.bins])


def best_split(sums: np.ndarray, allowed: np.ndarray, params: TreeParams) -> tuple:
    """(feature, bin, gain, gradient, hessian, left gradient, left hessian) of one node.

    ``sums``: integer gradient and hessian by feature and bin.  The first of equal gains
    wins, by feature and then by bin; feature -1 if no split gains.
    """
    g, h = sums[0].astype(float) / _SCALE, sums[1].astype(float) / _SCALE
    total_g, total_h = float(g[0].sum()), float(h[0].sum())
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h

    def strength(a, b):
        return a * a / (b + params.ridge)

    gain = strength(left_g, left_h) + strength(right_g, right_h) - strength(total_g, total_h)
    good = (left_h >= params.least_hessian) & (right_h >= params.least_hessian) & allowed[:, None]
    gain = np.where(good, gain, -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    if not gain[f, b] > 1e-6:
        return -1, 0, 0.0, total_g, total_h, 0.0, 0.0
    return f, b, float(gain[f, b]), total_g, total_h, float(left_g[f, b]), float(left_h[f, b])


# -- growing ------------------------------------------------------------------


@dataclass
class Boosted:
    """All fits: their trees, and the stored rows with one final margin per fit."""

    fits: list[Fit]
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Trees]
    rows: DataFrame


def _trains(fit: Fit) -> Column:
    """Whether a row trains ``fit``."""
    mine = F.col("horizon") == fit.horizon
    return mine if fit.before is None else mine & (F.col("fiscal_year") < fit.before)


def _bases(table: DataFrame, fits: Sequence[Fit]) -> tuple[np.ndarray, list[int]]:
    """Where margins start: log odds of the training mean, or the mean itself; and how many
    rows train each fit.

    Summed in fixed point as well, so the mean does not depend on the order of rows.
    """
    cells = []
    for k, fit in enumerate(fits):
        target = F.col("beat" if fit.kind == "logistic" else "actual")
        fixed = F.rint(F.when(_trains(fit), target) * _SCALE).cast("decimal(28,0)")
        mean = F.sum(fixed).cast("double") / F.nullif(F.count(fixed), F.lit(0)) / _SCALE
        cells += [mean.alias(f"m{k}"), F.count(F.when(_trains(fit), 1)).alias(f"n{k}")]
    row = table.agg(*cells).first()
    out = []
    for k, fit in enumerate(fits):
        mean = row[f"m{k}"] or 0.0
        if fit.kind == "logistic":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            mean = float(np.log(mean / (1 - mean)))
        out.append(mean)
    return np.array(out), [row[f"n{k}"] for k in range(len(fits))]


def _with_margins(table: DataFrame, state: _State) -> DataFrame:
    """The stored table with the margins of all trees."""
    keep, nf, n = table.columns, state.median_bins.shape[1], len(state.fits)
    kept = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.ascontiguousarray(_matrix(batch.column("bins"), np.uint8, nf).T)
            horizon = np.array(batch.column("horizon").to_pylist(), dtype=object)
            margins = np.repeat(state.bases[None], batch.num_rows, axis=0)
            for k in range(n):
                at = np.flatnonzero(horizon == state.fits[k].horizon)
                own = bins[:, at]
                for feature, split, value in state.done[k] if len(at) else ():
                    leaf = _walk(own, (feature, split), state.median_bins[k], MISSING, state.params.depth)
                    margins[at, k] += value[leaf]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _cells(margins.astype("<f8"))], names=[*keep, "margins"]
            )

    return materialise(table.mapInArrow(add, f"{kept}, margins binary"), "margins")


@dataclass(frozen=True)
class _Group:
    """Fits that grow together: their numbers among all fits, and their trees so far."""

    numbers: list[int]
    fits: list[Fit]
    median_bins: np.ndarray  # (fits, features)
    trees: list[Trees]
    params: TreeParams

    def state(self, tree: int, level: int, since: int) -> _State:
        """For a level of ``tree``; the trees from ``since`` on are not yet in the margins."""
        p, (nk, nf) = self.params, self.median_bins.shape
        ids = np.arange(nf, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(1)
        drawn = [_drawn(_mix(ids), (p.seed << 33) + tree * 137 + k, p.columns) for k in self.numbers]
        done = [[(t.feature[i], t.bin[i], t.value[i]) for i in range(since, tree)] for t in self.trees]
        now = [(t.feature[tree], t.bin[tree]) for t in self.trees] if tree < p.trees else []
        counted = [_lighter(t, tree, level) for t in self.trees] if tree < p.trees else []
        columns = np.array([d if d.any() else ~d for d in drawn]).reshape(nk, nf)
        bases = np.array([t.base for t in self.trees])
        return _State(
            self.fits, p, self.median_bins, bases, columns, tree, level, done, now, counted, self.numbers
        )


def _no_trees(base: float, params: TreeParams) -> Trees:
    inner = (1 << params.depth) - 1
    return Trees(
        float(base),
        np.full((params.trees, inner), -1),
        np.zeros((params.trees, inner), dtype=np.int64),
        np.zeros((params.trees, inner)),
        np.zeros((params.trees, 2 * inner + 1)),
        np.zeros((params.trees, 2 * inner + 1)),
    )


def boost(
    rows: DataFrame,
    features: Sequence[str],
    fits: Sequence[Fit],
    params: TreeParams = TreeParams(),
    whole_cells: int = 0,
) -> Boosted:
    """Grow all trees of all fits.

    ``rows``: horizon, fiscal_year, beat and actual (doubles without nulls), the features,
    and any key columns, which are kept.  A fit with at most ``whole_cells`` cells (training
    rows x features) is grown by one task, the others together in lock-step; the trees are
    the same either way.
    """
    p, features, fits = params, list(features), list(fits)
    edges = bin_edges(rows, features, p.bins)
    keys = [c for c in rows.columns if c not in set(features)]
    table = rows.withColumn("row_key", F.xxhash64(*[k for k in keys if k not in ("beat", "actual")]))
    # A task keeps one block at a time and one set of sums, so there are as many tasks as
    # cores; what they shuffle does not grow with the rows.
    tasks = table.sparkSession.sparkContext.defaultParallelism
    table = materialise(binned_rows(table, features, edges).repartition(tasks), "binned")
    medians = np.array([[fit.medians.get(f, 0.0) for f in features] for fit in fits]).T
    median_bins = np.stack([_bin_of(m, e) for m, e in zip(medians, edges, strict=True)], axis=1)
    bases, counts = _bases(table, fits)
    trees = [_no_trees(b, p) for b in bases]

    def group(numbers: list[int]) -> _Group:
        own = [fits[k] for k in numbers], median_bins[numbers], [trees[k] for k in numbers]
        return _Group(numbers, *own, p)

    whole = [k for k, n in enumerate(counts) if n * len(features) <= whole_cells]
    # The largest first, as they take longest.
    whole.sort(key=lambda k: -counts[k])
    for k, grown in _grow_whole(table, [fits[k] for k in whole], whole, median_bins[whole], bases[whole], p):
        trees[k] = grown
    rest = sorted(set(range(len(fits))) - set(whole))
    if rest:
        _grow_together(table, group(rest), tasks)
    every = group(list(range(len(fits))))
    return Boosted(fits, features, edges, trees, _with_margins(table, every.state(p.trees, 0, 0)))


def _grow_together(table: DataFrame, group: _Group, tasks: int) -> None:
    """All trees of a group in lock-step, one job a level."""
    spark, p = table.sparkSession, group.params
    width = min(len(group.fits), tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = None
    for tree in range(p.trees):
        before, newest = held, group.state(tree, 0, tree - 1)
        if before is None:
            held = _blocks(table, group.state(0, 0, 0))
        else:
            held = before.map(lambda b, s=newest: _add_trees(b, s))
            if tree % p.store_every == 0:
                held = _stored(held, spark)
        held.persist(StorageLevel.MEMORY_AND_DISK)
        above = None
        for level in range(p.depth):
            sums = _grow_level(held, group.state(tree, level, tree), group.trees, width, above)
            if above is not None:
                above.unpersist()
            above = sums
            if before is not None and level == 0:
                before.unpersist()
        if above is not None:
            above.unpersist()
    if held is not None:
        held.unpersist()


def _grow_whole(
    table: DataFrame,
    fits: list[Fit],
    numbers: list[int],
    median_bins: np.ndarray,
    bases: np.ndarray,
    params: TreeParams,
) -> Iterator[tuple[int, Trees]]:
    """(number, trees) of small fits, from one job with a task for each fit."""
    if not fits:
        return
    places = [F.when(_trains(fit), F.lit(i)) for i, fit in enumerate(fits)]
    place = F.explode(F.array_compact(F.array(*places))).alias("place")
    dealt = table.select(*BLOCK_COLUMNS, place).repartitionById(len(fits), F.col("place"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, group, i = [], None, 0
        for batch in _joined(batches, BLOCK_ROWS):
            if group is None:
                i = batch.column("place")[0].as_py()
                own = [fits[i]], median_bins[i : i + 1], [_no_trees(bases[i], params)]
                group = _Group([numbers[i]], *own, params)
            blocks.append(_block_of(batch, group.state(0, 0, 0)))
        if group is not None:
            _grow_in_task(blocks, group)
            cells = [pa.array([numbers[i]], pa.int32()), pa.array([pickle.dumps(group.trees[0])], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["number", "trees"])

    # Bounded by fits, trees and depth.
    for r in dealt.mapInArrow(grow, "number int, trees binary").collect():
        yield r["number"], pickle.loads(r["trees"])


def _grow_in_task(blocks: list[Block], group: _Group) -> None:
    """All trees of a group on blocks that are all its rows, level by level as in lock-step."""
    p = group.params
    for tree in range(p.trees):
        above: dict[tuple[int, int], np.ndarray] = {}
        for level in range(p.depth):
            now = group.state(tree, level, tree)
            met = {(k, n >> 1): (sums, None) for (k, n), sums in histograms(iter(blocks), now)}
            for cell, sums in above.items():
                met[cell] = _both(met.get(cell, (None, None)), (None, sums))
            above = dict(found for cell in met.items() for found in _children(cell, now))
            for (k, node), sums in above.items():
                _put(group.trees[k], now, node, *best_split(sums, now.columns[k], p))
        newest = group.state(tree + 1, 0, tree)
        blocks = [_add_trees(b, newest) for b in blocks]


def _lighter(trees: Trees, tree: int, level: int) -> np.ndarray:
    """Which nodes of a level to count: the root, or of every split above the child of less
    weight, the left one of equals."""
    counted = np.ones(1 << level, dtype=bool)
    if level:
        first = (1 << level) - 1
        left, right = trees.cover[tree, first : 2 * first + 1].reshape(-1, 2).T
        split = trees.feature[tree, first // 2 : first] >= 0
        counted = np.stack([split & (left <= right), split & (left > right)], axis=1).ravel()
    return counted


def _both(a: tuple, b: tuple) -> tuple:
    """Sums of pairs in which either part may be None."""
    return tuple(y if x is None else x if y is None else x + y for x, y in zip(a, b, strict=True))


def _children(cell: tuple, now: _State) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((fit, node), sums) of the nodes of a level below one node, from what was counted of
    them and the sums of the node itself; of a node without a split all is left."""
    (fit, parent), (part, whole) = cell
    if whole is None:
        yield (fit, 0), part
    elif part is None:
        yield (fit, 2 * parent), whole
    else:
        left = bool(now.counted[fit][2 * parent])
        yield (fit, 2 * parent + 1 - left), part
        yield (fit, 2 * parent + left), whole - part


def _grow_level(blocks: RDD, now: _State, trees: list[Trees], width: int, above: RDD | None) -> RDD:
    """One job: histograms of all open nodes of all fits, and their best splits.

    ``above`` holds the histograms of the level before; those of this one are returned.
    """

    def split(cell: tuple) -> tuple:
        (fit, node), sums = cell
        return fit, node, *best_split(sums, now.columns[fit], now.params)

    # A node is met under its parent: one child counted there, and the parent's own sums.
    parts = blocks.mapPartitions(
        lambda b: (((k, n >> 1), (sums, None)) for (k, n), sums in histograms(b, now))
    )
    if above is not None:
        parts = parts.union(above.map(lambda cell: (cell[0], (None, cell[1]))))
    # As many partitions as fits at most: what they hold is bounded by nodes, not by rows.
    sums = parts.reduceByKey(_both, width).flatMap(lambda cell: _children(cell, now))
    sums.persist(StorageLevel.MEMORY_AND_DISK)
    for fit, node, feature, at, gain, g, h, lg, lh in sums.map(split).collect():  # one row per node
        _put(trees[fit], now, node, feature, at, gain, g, h, lg, lh)
    return sums


def _put(
    t: Trees, now: _State, node: int, feature: int, at: int, gain: float, g: float, h: float, lg: float, lh: float
) -> None:
    """Enter the best split of a node of the open level."""
    i, node = now.tree, (1 << now.level) - 1 + node
    if now.level == 0:
        t.cover[i, 0] = h
        t.value[i, 0] = _value(g, h, now.params)
    t.feature[i, node], t.bin[i, node], t.gain[i, node] = feature, at, gain
    left, right = 2 * node + 1, 2 * node + 2
    if feature < 0:  # rows all go left
        t.value[i, [left, right]] = t.value[i, node]
        t.cover[i, left], t.cover[i, right] = h, 0.0
        return
    t.cover[i, left], t.cover[i, right] = lh, h - lh
    t.value[i, left] = _value(lg, lh, now.params)
    t.value[i, right] = _value(g - lg, h - lh, now.params)


def _value(g: float, h: float, params: TreeParams) -> float:
    return -params.step * g / (h + params.ridge)


# -- results ------------------------------------------------------------------


def importances(trees: Trees, features: Sequence[str]) -> dict[str, float]:
    """Mean gain of the splits on a feature, scaled to a sum of 1."""
    real = trees.feature >= 0
    at = trees.feature[real]
    gain = np.bincount(at, trees.gain[real], len(features))
    count = np.bincount(at, minlength=len(features))
    mean = gain / np.maximum(count, 1)
    total = mean.sum()
    return {f: float(v / total) if total else 0.0 for f, v in zip(features, mean, strict=True)}


def final_margins(model: Boosted, columns: Sequence[str]) -> DataFrame:
    """One row per stored row and fit of its horizon: ``columns``, fit, before, kind, margin."""
    fits, n, schema = model.fits, len(model.fits), model.rows.schema
    kept = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in columns)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = _matrix(batch.column("margins"), "<f8", n)
            horizon = np.array(batch.column("horizon").to_pylist(), dtype=object)
            for k, fit in enumerate(fits):
                at = np.flatnonzero(horizon == fit.horizon)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(take) for c in columns],
                        pa.array([k] * len(at), pa.int32()),
                        pa.array([fit.before] * len(at), pa.int32()),
                        pa.array([fit.kind] * len(at), pa.string()),
                        pa.array(margins[at, k]),
                    ],
                    names=[*columns, "fit", "before", "kind", "margin"],
                )

    stored = model.rows.select(*{*columns, "horizon", "margins"})
    return stored.mapInArrow(spread, f"{kept}, fit int, before int, kind string, margin double")


def score(model: Boosted, rows: DataFrame, k: int = 0) -> DataFrame:
    """``rows`` with ``margin`` of fit ``k`` for any rows that hold the features."""
    fit, trees, depth, nf = model.fits[k], model.trees[k], _depth(model.trees[k]), len(model.features)
    medians = [fit.medians.get(f, 0.0) for f in model.features]
    keep = [c for c in rows.columns if c not in set(model.features)]
    fill = np.array(
        [_bin_of(np.array([m]), e)[0] for m, e in zip(medians, model.edges, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch.column("bins"), np.uint8, nf)
            bins = np.where(bins == MISSING, fill, bins)
            margin = np.full(len(bins), trees.base)
            for f, b, v in zip(trees.feature, trees.bin, trees.value, strict=True):
                margin += v[leaf_of(bins, f, b, depth)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(margin)], names=[*keep, "margin"]
            )

    binned = binned_rows(rows.select(*keep, *model.features), model.features, model.edges)
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return binned.mapInArrow(run, f"{kept}, margin double")


# -- what moved a prediction --------------------------------------------------


@dataclass(frozen=True)
class _Path:
    """One leaf: its value, and for each feature on the way the bins that lead to it and
    the share of training weight that follows."""

    value: float
    features: list[int]
    low: list[int]  # bins above ``low`` and up to ``high`` pass
    high: list[int]
    share: list[float]


def _paths(feature: np.ndarray, split: np.ndarray, value: np.ndarray, cover: np.ndarray) -> list[_Path]:
    out, inner = [], len(feature)

    def walk(node: int, bounds: dict[int, tuple[int, int, float]]) -> None:
        if node >= inner:
            cells = [(f, *b) for f, b in bounds.items()]
            out.append(_Path(float(value[node]), *[[c[i] for c in cells] for i in range(4)]))
            return
        f = int(feature[node])
        if f < 0:  # rows all go left
            walk(2 * node + 1, bounds)
            return
        low, high, share = bounds.get(f, (-1, MISSING, 1.0))
        for child, span in (
            (2 * node + 1, (low, min(high, int(split[node])))),
            (2 * node + 2, (max(low, int(split[node])), high)),
        ):
            walk(child, {**bounds, f: (*span, share * float(cover[child] / cover[node]))})

    walk(0, {})
    return out


def _tree_shares(bins: np.ndarray, paths: list[_Path], out: np.ndarray) -> float:
    """Add one tree's contribution of every feature to ``out``; returns its mean value.

    A feature's share of a leaf weighs every set of the other features on the path.  Sets of
    one size weigh alike, so their products are the coefficients of one polynomial.
    """
    mean = 0.0
    for path in paths:
        m = len(path.features)
        mean += path.value * float(np.prod(path.share))
        if not m:
            continue
        spans = zip(path.features, path.low, path.high, strict=True)
        passes = [((bins[:, f] > a) & (bins[:, f] <= b)).astype(float) for f, a, b in spans]
        weight = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
        for i, f in enumerate(path.features):
            poly = [np.ones(len(bins))]
            for j in range(m):
                if j != i:
                    more = [passes[j] * c for c in poly]
                    less = [path.share[j] * c for c in poly]
                    poly = [
                        (less[k] if k < len(less) else 0) + (more[k - 1] if k else 0)
                        for k in range(len(poly) + 1)
                    ]
            total = sum(w * c for w, c in zip(weight, poly, strict=True))
            out[:, f] += (passes[i] - path.share[i]) * total * path.value
    return mean


def attributions(model: Boosted, rows: DataFrame, k: int = 0) -> DataFrame:
    """What each feature adds to the margin of fit ``k``: one row per row and moved feature.

    Columns: those of ``rows`` besides the features, margin, base (the mean margin by training
    weight), feature, contribution.  Contributions and base sum to the margin.  A row that no
    feature moves keeps one line with a null feature.
    """
    fit, trees, features = model.fits[k], model.trees[k], list(model.features)
    keep = [c for c in rows.columns if c not in set(features)]
    fill = np.array(
        [_bin_of(np.array([fit.medians.get(f, 0.0)]), e)[0] for f, e in zip(features, model.edges, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [
            _paths(*t) for t in zip(trees.feature, trees.bin, trees.value, trees.cover, strict=True)
        ]
        for batch in batches:
            bins = _matrix(batch.column("bins"), np.uint8, len(features))
            bins = np.where(bins == MISSING, fill, bins)
            out = np.zeros((len(bins), len(features)))
            base = trees.base + sum(_tree_shares(bins, paths, out) for paths in ways)
            at, f = np.nonzero(out)
            still = np.setdiff1d(np.arange(len(bins)), at)
            take = pa.array(np.concatenate([at, still]))
            names = [features[i] for i in f] + [None] * len(still)
            moved = np.concatenate([out[at, f], np.zeros(len(still))])
            margin = base + out.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(take) for c in keep],
                    pa.array(margin).take(take),
                    pa.array(np.full(len(take), base)),
                    pa.array(names, pa.string()),
                    pa.array(moved),
                ],
                names=[*keep, "margin", "base", "feature", "contribution"],
            )

    binned = binned_rows(rows.select(*keep, *features), features, model.edges)
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    more = "margin double, base double, feature string, contribution double"
    return binned.mapInArrow(run, f"{kept}, {more}")


def _depth(trees: Trees) -> int:
    return (trees.feature.shape[1] + 1).bit_length() - 1
