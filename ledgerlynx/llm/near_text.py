"""Near-duplicate documents by Order MinHash with banded alignment.

A document is its sequence of five-word shingles, each labelled with how often it occurred
before.  Every band of a sketch takes the few shingles that a hash function puts first and
keeps them in the order of the text, so a band matches only if content and order do.
Documents that agree in a band meet in a bucket; candidates are verified by aligning their
words within the band of diagonals that the wanted similarity leaves.  Similarity is one
minus the word edits over the words of the longer text.  Texts link at 0.8 or more, and a
class is what links connect.

Equal texts are collapsed first: a node is a text, whatever rows and ids carry it.  In a
bucket, the member that shares most buckets is compared with all others, which settles a
group of copies of one text.  Where members of several classes are left, all those outside
the largest class are compared with the whole bucket, block by block: what their word counts
allow is aligned.  So every pair of a bucket is compared or
already in one class, and none is lost to a cap.

Defined cases: words are runs without ASCII white space, lower-cased; a text of one to four
words is one shingle; a null text, or one without words, links with nothing, and so does a
row without an id; rows that share an id share a class, though their texts stay nodes of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import components
from .common import WORD, one_of_each, share_of

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_KNOWN = 500_000
_CELLS = 1 << 20
_BINS = 128


@dataclass(frozen=True)
class NearParams:
    """``chunk`` members of a leader, or ``block`` of a bucket, meet in one task at a time."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    minima: int = 3
    chunk: int = 64
    block: int = 256
    seed: int = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Hashes of the words of a text, in order, and the same as a set with repeats told apart."""

    codes: np.ndarray
    bag: np.ndarray


class WordCoder:
    """Word hashes of whole texts; remembers those of words."""

    def __init__(self):
        self.known = {}

    def codes(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "replace").split()
        known = self.known
        if len(known) > _KNOWN:
            known.clear()
        codes = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            codes[i] = h
        return codes

    def __call__(self, text: str) -> Words:
        codes = self.codes(text)
        return Words(codes, labelled(codes, 1))


def labelled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word codes with its number among equal runs."""
    n = len(codes)
    if not n:
        return codes
    width = min(size, n)
    h = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        h = h * _STEP + codes[k : n - width + 1 + k]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(fresh)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    label = np.empty(len(h), dtype=np.uint64)
    label[order] = nth.astype(np.uint64)
    return _mix(h + label * _STEP)


def order_sketch(x: np.ndarray, params: NearParams) -> np.ndarray:
    """One signature for each band: the least labelled shingles, in text order."""
    take = min(params.minima, len(x))
    seeds = [(b + 1 + params.seed) * int(_STEP) & _MASK for b in range(params.bands)]
    seeds = np.array(seeds, dtype=np.uint64)
    out = np.zeros(params.bands, dtype=np.uint64)
    wide = max(1, _CELLS // max(1, len(x)))  # bands at a time; long texts take few
    for low in range(0, params.bands, wide):
        mixed = _mix(x ^ seeds[low : low + wide, None])
        at = np.argpartition(mixed, take - 1, axis=1)[:, :take] if take else mixed
        chosen = x[np.sort(at, axis=1)] if take else mixed
        sig = out[low : low + wide]
        for k in range(take):
            sig = _mix(sig + _STEP + chosen[:, k])
        out[low : low + wide] = sig
    return out


def _counts(codes: np.ndarray) -> np.ndarray:
    """Words by hashed bins."""
    return np.bincount((codes % np.uint64(_BINS)).astype(np.int64), minlength=_BINS)


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether at most ``limit`` word insertions, deletions and changes turn ``a`` into ``b``.

    A bit-parallel alignment: bit ``k`` of a column's numbers is the diagonal ``k - limit``
    away, and the numbers hold the band alone.  Ends that agree are left out first.
    """
    shared = min(len(a), len(b))
    differ = np.flatnonzero(a[:shared] != b[:shared])
    start = int(differ[0]) if len(differ) else shared
    a, b = a[start:], b[start:]
    shared = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:shared] != b[::-1][:shared])
    end = int(differ[0]) if len(differ) else shared
    a, b = a[: len(a) - end], b[: len(b) - end]
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False
    if not n or not m:
        return True
    limit = min(limit, max(n, m))
    width = 2 * limit + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    at: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        at[word] = at.get(word, 0) | (1 << i)
    up, down = mask & ~((1 << limit) - 1), 0
    score = min(limit, n)  # at the lower edge of the band, then in the last row
    for j, word in enumerate(b.tolist(), 1):
        same, shift = at.get(word, 0), j - limit - 1
        same = (same >> shift if shift >= 0 else same << -shift) & mask
        level = ((((same & up) + up) ^ up) | same | down) & mask
        right, left = (down | ~(level | up)) & mask, level & up
        if j <= n - limit:
            score += not level & top
        else:
            row = n - j + limit
            score += (right >> row & 1) - (left >> row & 1)
        # Each further column takes at most one edit off.
        if score - (m - j) > limit + max(0, n - j - limit):
            return False
        half = level >> 1
        up, down = (left | ~(half | right)) & mask, half & right
    return score <= limit


def compare(a: Words, b: Words, similarity: float) -> bool:
    """Whether the edit similarity of two texts is at least ``similarity``.

    Words that one text has more of than the other each need an edit, which settles most
    pairs before any alignment.
    """
    longer = max(len(a.codes), len(b.codes))
    limit = int(longer * (1 - similarity) + 1e-9)
    if abs(len(a.codes) - len(b.codes)) > limit:
        return False
    common = len(np.intersect1d(a.bag, b.bag, assume_unique=True))
    return longer - common <= limit and edits_within(a.codes, b.codes, limit)


def _sketches(nodes: DataFrame, params: NearParams) -> DataFrame:
    """(node, band, sig) of every distinct text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCoder()
        for batch in batches:
            codes = [words.codes(t) for t in batch.column("text").to_pylist()]
            rows = [order_sketch(labelled(c, params.words), params) for c in codes]
            sig = np.array(rows, dtype=np.uint64).reshape(-1).view(np.int64)
            at = np.repeat(np.arange(batch.num_rows), params.bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(at)),
                    pa.array(np.tile(np.arange(params.bands, dtype=np.int32), batch.num_rows)),
                    pa.array(sig),
                ],
                names=["node", "band", "sig"],
            )

    return nodes.mapInArrow(sketch, "node long, band int, sig long")


def _verify(pairs: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """(a, b) of the pairs that link; a leader meets its members by chunks."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = sizes.select("a", F.ceil(F.col("n") / params.chunk).cast("int").alias("parts"))
    parts = share_of(parts, "leaders")
    dealt = pairs.join(parts, "a").select(
        "a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")
    )
    members = dealt.join(texts, "node").select("a", "part", "node", "text")
    leaders = parts.withColumnRenamed("a", "node").join(texts, "node").select(
        F.col("node").alias("leader"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"),
        F.col("text").alias("leader_text"),
    )

    def align(key: tuple, group: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(group) and len(lead):
            words = WordCoder()
            own = words(lead["leader_text"].iloc[0])
            for node, text in zip(group["node"], group["text"], strict=True):
                if compare(own, words(text), params.similarity):
                    rows.append((key[0], node))
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return (
        members.groupBy("a", "part")
        .cogroup(leaders.groupBy("leader", "chunk"))
        .applyInPandas(align, "a long, b long")
    )


@dataclass(frozen=True)
class TextClasses:
    """``keyed``: doc_id, hash (null without words or id) of every row; ``nodes``: hash, first
    (least id of the text), node; ``links``: (a, b) of nodes."""

    keyed: DataFrame
    nodes: DataFrame
    links: DataFrame


def text_links(docs: DataFrame, params: NearParams = NearParams()) -> TextClasses:
    """Texts as nodes, and the links that connect all that any links connect."""
    has = F.col("doc_id").isNotNull() & F.coalesce(F.regexp_count("text", F.lit(WORD)) > 0, F.lit(False))
    hash_of = F.when(has, F.sha2("text", 256)).alias("hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = share_of(rows.select("doc_id", hash_of), "text-hashes")
    # Equal texts become one node: one grouping, combined early.
    nodes = keyed.where("hash is not null").groupBy("hash").agg(F.min("doc_id").alias("first"))
    nodes = share_of(nodes.withColumn("node", F.monotonically_increasing_id()), "text-nodes")
    # The rows of a text that carry its least id; more than one only where rows repeat.
    texts = rows.select("doc_id", "text", hash_of).where("hash is not null")
    texts = texts.join(nodes.withColumnRenamed("first", "doc_id"), ["doc_id", "hash"]).select("node", "text")
    sketches = share_of(_sketches(texts, params).distinct(), "sketches")
    buckets = sketches.groupBy("band", "sig").agg(F.count("*").alias("n")).where("n > 1")
    shared = share_of(
        sketches.join(share_of(buckets, "buckets"), ["band", "sig"]), "shared-buckets"
    )
    asked = shared.select("node").distinct()
    texts = share_of(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]), "shared-texts")
    return TextClasses(keyed, nodes, share_of(_all_links(shared, texts, params), "text-links"))


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One row per input row: doc_id, component_id (least id of its class), kept.

    Reads ``doc_id`` and ``text``.
    """
    found = text_links(docs, params)
    # From texts to ids: a text stands for its least id, and rows of one id meet there.
    first = found.nodes.select("node", "first")
    links = (
        found.links.join(first.toDF("a", "first_a"), "a")
        .join(first.toDF("b", "first_b"), "b")
        .select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    )
    same_text = found.keyed.join(found.nodes, "hash").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    ends = links.unionByName(same_text).where("a <> b")
    reached = share_of(components(ends), "text-components")
    rows = found.keyed.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return rows.select("doc_id", own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))


def without_near_copies(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``docs`` with one row of every class of near-equal texts: the one of the least id.

    Classes are those of texts: different texts under one id both stay.  Rows without words,
    or without an id, all stay.  Of rows equal in id and text one stays.
    """
    found = text_links(docs, params)
    classes = components(found.links).withColumnRenamed("component", "class")
    of_class = found.nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    best = of_class.groupBy("class").agg(F.min(F.struct("first", "hash")).alias("best"))
    best = share_of(best.select("best.first", "best.hash"), "kept-texts").toDF("_first", "_hash")
    has = F.col("doc_id").isNotNull() & F.coalesce(F.regexp_count("text", F.lit(WORD)) > 0, F.lit(False))
    keyed = docs.withColumn("_hash", F.when(has, F.sha2("text", 256)))
    texts = keyed.where("_hash is not null").join(best, "_hash").where(F.col("doc_id") == F.col("_first"))
    one = one_of_each(texts.drop("_first"), "_hash")
    return one.unionByName(keyed.where("_hash is null")).select(*docs.columns)


def _all_links(shared: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """(a, b) links that connect all that any links within the buckets connect.

    ``shared``: node, band, sig, n (rows of the bucket).
    """
    key = ["band", "sig"]
    # The member of most and largest buckets is nearest to the others, as an original is.
    reach = share_of(shared.groupBy("node").agg(F.sum("n").alias("reach")), "reach")
    ranked = shared.join(reach, "node")
    leaders = ranked.groupBy(*key).agg(F.max(F.struct("reach", -F.col("node"))).alias("top"))
    leaders = share_of(leaders.select(*key, (-F.col("top.col2")).alias("leader")), "bucket-leaders")
    led = share_of(shared.join(leaders, key).where("node <> leader"), "led")
    pairs = led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = share_of(_verify(pairs, texts, params), "verified")
    classes = share_of(components(links), "classes").withColumnRenamed("component", "class")
    rest = led.where("n > 2").select("node", *key).join(classes, "node", "left")
    rest = share_of(rest.withColumn("class", F.coalesce("class", "node")), "rest")
    return links.unionByName(_compare_rest(rest, texts, params))


def _compare_rest(rest: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """(a, b) links between classes of one bucket: members outside the largest with all."""
    key = ["band", "sig"]
    sizes = rest.groupBy(*key, "class").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy(*key).agg(
        F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("k")
    )
    mixed = mixed.where("k > 1").select(
        *key,
        F.col("main.class").alias("main"),
        F.ceil(F.col("all") / params.block).cast("int").alias("columns"),
        F.ceil((F.col("all") - F.col("main.n")) / params.block).cast("int").alias("rows"),
    )
    rows = share_of(rest.join(share_of(mixed, "mixed"), key), "mixed-rows")
    spot = F.xxhash64("node")
    every = rows.select(
        *[F.col(c).alias(f"{c}_b") for c in key],
        F.col("class").alias("class_b"),
        F.col("node").alias("mate"),
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row_b"),
        F.pmod(spot, "columns").cast("int").alias("column_b"),
    )
    some = rows.where("class <> main").select(
        *key,
        "class",
        "node",
        F.pmod(spot, "rows").cast("int").alias("row"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"),
    )

    def block(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            words = WordCoder()
            left = [words(t) for t in a["text"]]
            right = [words(t) for t in b["mate_text"]]
            size = np.array([len(x.codes) for x in right])
            counts = np.stack([_counts(x.codes) for x in right])
            class_b, node_b = b["class_b"].to_numpy(), b["mate"].to_numpy()
            joined: dict = {}

            def root(c):
                while joined.get(c, c) != c:
                    c = joined[c]
                return c

            for x, own, node in zip(left, a["class"], a["node"], strict=True):
                # Each edit takes away and adds at most one word, so at most one of a bin.
                more = np.maximum(counts - _counts(x.codes), 0).sum(axis=1)
                apart = np.maximum(more, more + len(x.codes) - size)
                longer = np.maximum(size, len(x.codes))
                good = (apart <= longer * (1 - params.similarity) + 1e-9) & (class_b != own)
                for j in np.flatnonzero(good):
                    if root(own) != root(class_b[j]) and compare(x, right[j], params.similarity):
                        joined[root(own)] = root(class_b[j])
                        out.append((node, node_b[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    some = some.join(texts, "node")
    mates = texts.select(F.col("node").alias("mate"), F.col("text").alias("mate_text"))
    every = every.join(mates, "mate")
    return (
        some.groupBy(*key, "row", "column")
        .cogroup(every.groupBy("band_b", "sig_b", "row_b", "column_b"))
        .applyInPandas(block, "a long, b long")
    )
