"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source has a target in words.  Its documents are dealt by a seeded hash into
permuted blocks; whole passes over the source and the blocks of a partial pass make
an exact block quota.  A binary tree splits all quotas among the output shards: each
node draws the blocks of its left half from those of the node without replacement,
so every shard holds each source in proportion, and the shards' block sets are
disjoint.  Each shard then shuffles its documents locally.

The permuted blocks of a source are ranked; a partial pass takes the first ones up to
the target.  The one document at a source's target is cut there, so the words taken
equal the target to less than one word; all other draws are whole documents.

Defined cases: a null or empty text has no words and is never drawn for words (``taken``
0); a null source is a source of its own, after all others; repeated rows are drawn as
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, one_of_each, share_of


@dataclass(frozen=True)
class MixParams:
    """``max_sources`` bounds the table of sources, which the driver holds.

    More sources raise an error: weights are a configuration, not data.  There are at least
    ``shards`` shards, and more where one would get over ``shard_words`` words.
    """

    weights: Sequence[float] = (5.0, 2.0, 1.0)
    total: float = 1.5
    passes: float = 2.0
    block_rows: int = 256
    max_blocks: int = 16_384
    shards: int = 16
    shard_words: int = 20_000_000
    seed: int = 17
    max_sources: int = 100_000


def shared_targets(sizes: Sequence[int], weights: Sequence[float], total: float, passes: float):
    """Targets by weight, none above ``passes`` times its size; the excess is reshared."""
    size, weight = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    cap, goal = passes * size, total * size.sum()
    target, full = np.zeros(len(size)), np.zeros(len(size), dtype=bool)
    while not full.all():
        left = goal - cap[full].sum()
        target = np.where(full, cap, left * weight / weight[~full].sum())
        over = ~full & (target > cap)
        if not over.any():
            break
        full |= over
    return np.minimum(target, cap)


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: a tree of multivariate-hypergeometric draws."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def deal(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        share = total * (middle - low) // (high - low)
        left = np.zeros_like(counts)
        rng = np.random.default_rng([seed, low, high])
        need, rest = share, total
        for i, c in enumerate(counts):  # one conditional draw after another
            rest -= int(c)
            left[i] = rng.hypergeometric(int(c), rest, need) if need and c + rest else 0
            need -= int(left[i])
        deal(left, low, middle)
        deal(counts - left, middle, high)

    deal(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def row_hash(docs: DataFrame, params: MixParams) -> Column:
    """Seeded hash of all columns of a row, by which it is dealt, drawn and shuffled."""
    return F.xxhash64(F.lit(params.seed), *[F.col(f"`{c}`") for c in docs.columns])


@dataclass(frozen=True)
class Mix:
    """``rows``: one row per document; ``draws``: one row per drawn document and pass."""

    rows: DataFrame
    draws: DataFrame
    shards: int

    def documents(self) -> DataFrame:
        """``rows`` with ``taken``, the words that the draws of a document sum to."""
        taken = self.draws.groupBy("row").agg(F.sum("words").alias("taken"))
        return self.rows.join(taken, "row", "left").withColumn(
            "taken", F.coalesce("taken", F.lit(0).cast("long"))
        )


def mix_sources(docs: DataFrame, params: MixParams = MixParams()) -> Mix:
    """Draw documents so that each source's words meet its target.

    Reads ``doc_id``, ``text`` and ``source``; other columns only tell rows apart.
    ``rows``: row, doc_id, source, row_hash, size, source_size, target.
    ``draws``: row, doc_id, source, row_hash, pass, words, shard, position (order within its
    shard).
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = share_of(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            row_hash(docs, params).alias("row_hash"),
            size.alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-rows",
    )
    found = (
        rows.groupBy("source")
        .agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        .orderBy(F.col("source").asc_nulls_last())
        .limit(params.max_sources + 1)
        .collect()
    )
    if len(found) > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources")
    weights = [params.weights[i % len(params.weights)] for i in range(len(found))]
    targets = shared_targets([r["size"] for r in found], weights, params.total, params.passes)
    source_rows = []
    for i, (r, target) in enumerate(zip(found, targets, strict=True)):
        blocks = min(params.max_blocks, -(-r["n"] // params.block_rows))
        words = int(round(target))
        whole = words // r["size"] if r["size"] else 0
        source_rows.append(
            (i, r["source"], blocks, r["size"], float(target), whole, words - whole * r["size"])
        )
    sources = spark.createDataFrame(
        source_rows,
        "source_no int, source string, blocks int, source_size long, target double,"
        " whole long, part long",
    )
    # A null source is a key like any other; the table of sources is bounded.
    placed = (
        rows.alias("r")
        .join(F.broadcast(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select(
            "row",
            "doc_id",
            "r.source",
            "row_hash",
            "size",
            "source_no",
            "source_size",
            "target",
            "whole",
            "part",
            F.pmod(F.xxhash64(F.lit(params.seed + 1), "row_hash"), F.col("blocks"))
            .cast("int")
            .alias("block"),
        )
    )
    # Blocks are already permuted, as a hash deals them: their number is their rank.
    ahead = Window.partitionBy("source_no").orderBy("block")
    blocks = placed.groupBy("source_no", "block").agg(
        F.sum("size").alias("block_size"), F.first("part").alias("part")
    )
    blocks = (
        blocks.withColumn("block_rank", F.row_number().over(ahead) - 1)
        .withColumn("before", F.sum("block_size").over(ahead) - F.col("block_size"))
        .withColumn("room", F.col("part") - F.col("before"))
        .select("source_no", "block", "block_rank", "block_size", "room")
    )
    blocks = share_of(blocks, "mix-blocks")
    # Only the one block of a source that meets its target needs an order of rows.
    edge = blocks.where((F.col("room") > 0) & (F.col("room") < F.col("block_size")))
    in_block = (
        Window.partitionBy("source_no", "block")
        .orderBy("row_hash", "doc_id", "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    all_blocks = placed.join(blocks, ["source_no", "block"])
    within = F.col("room") >= F.col("block_size")
    inside = all_blocks.where(within | (F.col("room") <= 0)).withColumn(
        "part_words", F.when(within, F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    cut = (
        placed.join(edge, ["source_no", "block"])
        .withColumn("_before", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
        .withColumn(
            "part_words",
            F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("_before"))).cast("long"),
        )
        .drop("_before")
    )
    taken = inside.unionByName(cut)
    words = int(sum(targets))
    shards = max(params.shards, -(-words // params.shard_words))
    draws = _draws(spark, taken, blocks, source_rows, params, shards)
    rows = placed.select("row", "doc_id", "source", "row_hash", "size", "source_size", "target")
    return Mix(rows, draws, shards)


def _draws(
    spark, taken: DataFrame, blocks: DataFrame, source_rows, params: MixParams, n_shards: int
) -> DataFrame:
    """Send every drawn block to a shard by the tree, and shuffle each shard locally."""
    counted = {
        r["source_no"]: (r["n"], r["used"])
        for r in blocks.groupBy("source_no")
        .agg(F.count("*").alias("n"), F.sum((F.col("room") > 0).cast("long")).alias("used"))
        .collect()
    }
    quotas = np.array(
        [
            r[5] * counted.get(r[0], (0, 0))[0] + (counted.get(r[0], (0, 0))[1] if r[6] else 0)
            for r in source_rows
        ],
        dtype=np.int64,
    )
    shares = split_quotas(quotas, n_shards, params.seed) if len(quotas) else np.zeros((0, 0))
    ends = np.cumsum(shares, axis=0)
    bounds = [
        (i, [int(x) for x in ends[:, i]], counted.get(i, (0, 0))[0]) for i in range(len(quotas))
    ]
    table = spark.createDataFrame(bounds, "source_no int, ends array<long>, n_blocks long")
    passes = F.sequence(F.lit(0).cast("long"), F.col("whole"))
    draw = taken.where("size > 0").withColumn("pass", F.explode(passes))
    words = F.when(F.col("pass") < F.col("whole"), F.col("size")).otherwise(F.col("part_words"))
    draw = draw.withColumn("words", words).where("words > 0")
    # The place of a block among its source's draws: pass by pass, by rank.
    spot = F.col("pass") * F.col("n_blocks") + F.col("block_rank")
    draw = draw.join(F.broadcast(table), "source_no").withColumn("_spot", spot)
    draw = draw.withColumn(
        "shard", F.size(F.filter("ends", lambda e: e <= F.col("_spot"))).cast("int")
    )
    return draw.select(
        "row",
        "doc_id",
        "source",
        "row_hash",
        "pass",
        "words",
        "shard",
        F.xxhash64(F.lit(params.seed + 2), "row_hash", "pass").alias("position"),
    )


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The drawn documents themselves, every column of ``docs``, in the order of the shards.

    A document appears once for every pass that draws it; the one cut at its source's
    target has its first words only, joined by blanks.
    """
    names = ("row_hash", "words", "shard", "position")
    mix = mix_sources(docs, params)
    draws = mix.draws.select(*[F.col(n).alias(f"_mix_{n}") for n in names])
    # Rows of one hash are equal in every column: one stands for all, their draws stay apart.
    keyed = one_of_each(docs.withColumn("_mix_row_hash", row_hash(docs, params)), "_mix_row_hash")
    drawn = keyed.join(share_of(draws, "draws"), "_mix_row_hash")
    found = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.slice(found, F.lit(1), F.col("_mix_words").cast("int")), " ")
    whole = F.regexp_count("text", F.lit(WORD)) == F.col("_mix_words")
    drawn = drawn.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    # One task per shard, whatever their numbers hash to.
    ordered = drawn.repartitionById(mix.shards, F.col("_mix_shard")).sortWithinPartitions(
        "_mix_shard", "_mix_position"
    )
    return ordered.select(*docs.columns)
