"""Ranked lexical search over bit-sliced Bloom signatures, exact to the last place.

The index holds documents in blocks.  A document enters (term, occurrence level) pairs into
a Bloom signature, and a block stores signatures by slices: one bitmap of its documents for
each signature bit.  The AND of the slices of a pair overestimates which documents hold it,
so slices weighted by what each level adds to a score sum to an upper bound for every
document of the block at once.  Documents with similar numbers of pairs share blocks and a
signature width, so long documents do not saturate it.

A search bounds all documents, scores the highest bounds exactly, takes the last wanted place
among these as a threshold, and then scores every document whose bound reaches it.  Only
documents that provably score less are left out.  All scores are 64-bit integers.

Defined cases: a null text, or one without terms, scores nothing and is not indexed; a null
id ranks after all others at equal scores; repeated rows and ids rank as rows of their own;
items that share an id are one item, which holds the terms of all their texts, and so are
items without an id; an item without terms, or empty tables, give no rows.  Other columns
play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import share_of
from .frames import pack, unpack

# The characters between terms; A-Z count as a-z.
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
_STEP, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_CELLS = 1 << 20  # weights of one product
_FLUSH = 1 << 20  # terms counted before a task hands them on

INDEX = (
    "kind string, part int, block int, width int, n_docs int, n_terms long, top_tf int,"
    " doc_ids array<long>, lengths array<long>, slices binary, texts array<binary>,"
    " term string, df long"
)


@dataclass(frozen=True)
class SliceParams:
    """``rows`` documents, or ``block_bytes`` of slices, make a block; ``items`` queries a pass.

    ``bits`` signature bits for each pair, set by ``hashes`` functions; ``top`` places.
    """

    rows: int = 512
    block_bytes: int = 4 << 20
    bits: int = 12
    hashes: int = 4
    items: int = 256
    top: int = 50


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, with repeats."""
    return data.translate(_FOLD).split()


def levels_upto(tf: int) -> list[int]:
    """Occurrence levels 1, 2, 3, 4, 6, 8, 12, 16, ... that ``tf`` occurrences reach."""
    out, step = [1, 2, 3], 4
    while out[-1] < tf:
        out += [step, step + step // 2]
        step *= 2
    return [x for x in out if x <= tf]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _places(codes: np.ndarray, level: int, width: int, params: SliceParams) -> np.ndarray:
    """Signature bits of (term, level) pairs: one row per pair, one column per function."""
    base = np.array([level], dtype=np.uint64) * _M1  # arrays wrap around silently
    seeds = np.arange(1, params.hashes + 1, dtype=np.uint64) * _STEP + base
    return (_mix(codes[:, None] ^ seeds) % np.uint64(width)).astype(np.int64)


def gain(tf, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document."""
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


# -- index --------------------------------------------------------------------


class _Hashes(dict):
    """Term to its hash."""

    def __missing__(self, term: bytes) -> int:
        self[term] = code = xxhash.xxh64_intdigest(term)
        return code


@dataclass
class _Pending:
    """Documents of one signature width that wait for a block."""

    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    codes: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def block(self, width: int, params: SliceParams) -> dict:
        n = len(self.ids)
        row = np.repeat(np.arange(n), [len(x) for x in self.codes])
        codes, tf = np.concatenate(self.codes), np.concatenate(self.counts)
        top = int(tf.max())
        bits = np.zeros((width, -(-n // 8) * 8), dtype=np.uint8)
        for level in levels_upto(top):
            held = tf >= level
            codes, tf, row = codes[held], tf[held], row[held]
            bits[_places(codes, level, width, params), row[:, None]] = 1
        return {
            "width": width,
            "n_docs": n,
            "n_terms": int(sum(self.lengths)),
            "top_tf": top,
            "doc_ids": self.ids,
            "lengths": self.lengths,
            "slices": np.packbits(bits, axis=1).tobytes(),
            "texts": self.texts,
        }


_TYPES = {
    "kind": pa.string(),
    "part": pa.int32(),
    "block": pa.int32(),
    "width": pa.int32(),
    "n_docs": pa.int32(),
    "n_terms": pa.int64(),
    "top_tf": pa.int32(),
    "doc_ids": pa.list_(pa.int64()),
    "lengths": pa.list_(pa.int64()),
    "slices": pa.binary(),
    "texts": pa.list_(pa.binary()),
    "term": pa.string(),
    "df": pa.int64(),
}


def _index_batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r.get(c) for r in rows], t) for c, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(_TYPES))


def index_documents(docs: DataFrame, params: SliceParams = SliceParams()) -> DataFrame:
    """Store the index; rows of kind ``block`` hold slices and texts, of kind ``term`` the
    documents of one task that hold a term.  Reads ``doc_id`` and ``text``.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        pending: dict[int, _Pending] = {}
        hashes = _Hashes()
        df: Counter = Counter()

        def block(size: int) -> pa.RecordBatch:
            nonlocal number
            made = pending.pop(size).block(params.bits << size, params)
            number += 1
            return _index_batch([{"kind": "block", "part": part, "block": number, **made}])

        def counted() -> Iterator[pa.RecordBatch]:
            items = list(df.items())
            df.clear()
            hashes.clear()
            for low in range(0, len(items), 10_000):
                few = [(t.decode(), n) for t, n in items[low : low + 10_000]]
                yield _index_batch([{"kind": "term", "part": part, "term": t, "df": n} for t, n in few])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for key, cell in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                data = cell.as_py() or b""
                counts = Counter(terms_of(data))
                if not counts:
                    continue
                df.update(counts.keys())
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                pairs = sum(int((tf >= x).sum()) for x in levels_upto(int(tf.max())))
                size = max(4, (pairs - 1).bit_length())
                held = pending.setdefault(size, _Pending())
                held.ids.append(key)
                held.lengths.append(int(tf.sum()))
                held.texts.append(pack(data, 1))
                held.codes.append(np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts)))
                held.counts.append(tf)
                room = max(8, min(params.rows, 8 * params.block_bytes // (params.bits << size)))
                if len(held.ids) >= room:
                    yield block(size)
                if len(df) > _FLUSH:
                    yield from counted()
        for size in list(pending):
            yield block(size)
        yield from counted()

    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "lexical-index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, INDEX)
    # Rows hold up to some megabytes; small row groups keep what a reader holds small.
    rows.write.partitionBy("kind").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


# -- queries ------------------------------------------------------------------


@dataclass(frozen=True)
class Asked:
    """The items of one pass: distinct terms, and for each item its terms and their weights."""

    items: list
    terms: list[bytes]
    starts: np.ndarray  # where each item begins in ``index``
    owner: np.ndarray  # item of each place
    index: np.ndarray  # places in ``terms``, item by item
    weights: np.ndarray
    mean: tuple[int, int]  # N and L

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with ``n`` terms."""
        return 50 + (50 * n * self.mean[0]) // self.mean[1]


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, once each."""
    folded = F.translate(F.col("text"), _UPPER, _UPPER.lower())
    found = F.regexp_extract_all(folded, F.lit(f"([^{GAP}]+)"), F.lit(1))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _asked(rows: list, n: int, total: int) -> Asked:
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append((r["term"].encode(), weight(n, r["df"])))
    terms = sorted({t for pairs in by_item.values() for t, _ in pairs})
    at = {t: i for i, t in enumerate(terms)}
    flat = [(at[t], w) for pairs in by_item.values() for t, w in pairs]
    sizes = [len(p) for p in by_item.values()]
    starts, owner = np.cumsum([0, *sizes])[:-1], np.repeat(np.arange(len(sizes)), sizes)
    index, weights = np.array(flat, dtype=np.int64).reshape(-1, 2).T
    return Asked(list(by_item), terms, starts, owner, index, weights, (n, total))


def _bounds(row: dict, asked: Asked, codes: np.ndarray, params: SliceParams) -> np.ndarray:
    """Upper bound of the score of every document of a block for every item."""
    n, width = row["n_docs"], row["width"]
    slices = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
    m = asked.lengths(np.array(row["lengths"], dtype=np.int64))
    out = np.zeros((len(asked.items), n), dtype=np.int64)
    before, levels = np.zeros(n, dtype=np.int64), levels_upto(row["top_tf"])
    live = np.arange(len(asked.terms))
    for level, after in zip(levels, [*levels[1:], row["top_tf"] + 1], strict=True):
        held = np.bitwise_and.reduce(slices[_places(codes[live], level, width, params)], axis=1)
        some = held.any(axis=1)
        live = live[some]
        if not len(live):
            break
        bits = np.unpackbits(held[some], axis=1)[:, :n]
        most = gain(np.int64(after - 1), m)
        out += _per_item(bits, live, asked) * (most - before)
        before = most
    return out


def _per_item(bits: np.ndarray, live: np.ndarray, asked: Asked) -> np.ndarray:
    """Weighted sums of the rows of ``live`` terms for every item, some items at a time.

    Weights are whole and their sums below 2^53, so products of doubles are exact.
    """
    column = np.full(len(asked.terms), -1)
    column[live] = np.arange(len(live))
    at = column[asked.index]
    real, held = at >= 0, bits.astype(np.float64)
    step = max(1, _CELLS // len(live))
    parts = []
    for low in range(0, len(asked.items), step):
        high = min(len(asked.items), low + step)
        some = real & (asked.owner >= low) & (asked.owner < high)
        weights = np.zeros((high - low, len(live)))
        weights[asked.owner[some] - low, at[some]] = asked.weights[some]
        parts.append(weights @ held)
    return np.concatenate(parts).astype(np.int64)


class _Scorer:
    """Exact scores of single documents for single items."""

    def __init__(self, asked: Asked):
        self.asked, self.at = asked, {t: i for i, t in enumerate(asked.terms)}
        self.ends = np.append(asked.starts[1:], len(asked.index))

    def __call__(self, frame: bytes, n: int, items: np.ndarray) -> np.ndarray:
        a = self.asked
        counts = Counter(terms_of(unpack(frame)))
        held = [(self.at[t], tf) for t, tf in counts.items() if t in self.at]
        gains = np.zeros(len(a.terms), dtype=np.int64)
        if held:
            places, tf = np.array(held, dtype=np.int64).T
            gains[places] = gain(tf, a.lengths(np.int64(n)))
        spans = [slice(a.starts[i], self.ends[i]) for i in items]
        return np.array([int(a.weights[s] @ gains[a.index[s]]) for s in spans], dtype=np.int64)


def _codes(asked: Asked) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in asked.terms], dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _seeds(blocks: DataFrame, asked: Asked, params: SliceParams) -> DataFrame:
    """The highest bounds of every item: (item, bound, part, block, row), ``top`` each."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(asked)
        best = [np.zeros((0, 4), dtype=np.int64) for _ in asked.items]
        for r in _blocks(batches):
            bounds = _bounds(r, asked, codes, params)
            for i, row in enumerate(bounds):
                least = best[i][-1, 0] if len(best[i]) >= params.top else 0
                good = np.flatnonzero(row > least)
                if not len(good):
                    continue
                fresh = np.stack(
                    [row[good], np.full(len(good), r["part"]), np.full(len(good), r["block"]), good], axis=1
                )
                both = np.concatenate([best[i], fresh])
                best[i] = both[np.argsort(-both[:, 0], kind="stable")[: params.top]]
        item = np.repeat(np.arange(len(best)), [len(b) for b in best])
        rows = np.concatenate([np.zeros((0, 4), dtype=np.int64), *best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), *[pa.array(rows[:, k]) for k in range(4)]],
            names=["item", "bound", "part", "block", "row"],
        )

    found = blocks.drop("texts", "doc_ids").mapInArrow(
        seeds, "item long, bound long, part long, block long, row long"
    )
    first = Window.partitionBy("item").orderBy(F.col("bound").desc(), "part", "block", "row")
    return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= params.top)


def _thresholds(blocks: DataFrame, asked: Asked, params: SliceParams) -> np.ndarray:
    """A score that at least ``top`` documents reach, for every item; 1 where fewer score."""
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in _seeds(blocks, asked, params).collect():  # top rows for each item of the pass
        wanted.setdefault((r["part"], r["block"]), []).append((r["row"], r["item"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, out = _Scorer(asked), []
        for r in _blocks(batches):
            for row, item in wanted.get((r["part"], r["block"]), ()):
                value = scorer(r["texts"][row], r["lengths"][row], np.array([item]))
                out.append((item, int(value[0])))
        items, scores = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(scores, pa.int64())], names=["item", "score"]
        )

    held = F.broadcast(
        blocks.sparkSession.createDataFrame(list(wanted) or [(-1, -1)], "part int, block int")
    )
    near = blocks.join(held, ["part", "block"], "left_semi").drop("slices", "doc_ids")
    scored = near.mapInArrow(score, "item long, score long").where("score > 0")
    least = scored.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    out = np.ones(len(asked.items), dtype=np.int64)
    for r in least.where(F.col("n") >= params.top).collect():
        out[r["item"]] = r["least"]
    return out


def _answers(blocks: DataFrame, asked: Asked, params: SliceParams) -> DataFrame:
    """(item, doc_id, score): the best of every task among all documents not excluded."""
    least = _thresholds(blocks, asked, params)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, scorer, floor = _codes(asked), _Scorer(asked), least.copy()
        best: list[list] = [[] for _ in asked.items]
        for r in _blocks(batches):
            open_pairs = _bounds(r, asked, codes, params) >= floor[:, None]
            for row in np.flatnonzero(open_pairs.any(axis=0)):
                items = np.flatnonzero(open_pairs[:, row])
                scores = scorer(r["texts"][row], r["lengths"][row], items)
                for i, s in zip(items.tolist(), scores.tolist(), strict=True):
                    if s < floor[i]:
                        continue
                    best[i].append((s, r["doc_ids"][row]))
                    if len(best[i]) >= 2 * params.top:
                        best[i] = sorted(best[i], key=_rank)[: params.top]
                        floor[i] = max(floor[i], best[i][-1][0])
        rows = [(i, d, s) for i, b in enumerate(best) for s, d in sorted(b, key=_rank)[: params.top]]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (item, doc, score)], names=["item", "doc_id", "score"]
        )

    found = blocks.mapInArrow(answer, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.top)
    return ranked


def _rank(pair: tuple) -> tuple:
    score, doc_id = pair
    return -score, doc_id is None, doc_id or 0


def search(index: DataFrame, items: DataFrame, params: SliceParams = SliceParams()) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item.

    Items pass in groups of about ``params.items``; a group's terms and weights are all
    that the driver and the tasks hold of it.
    """
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    blocks = index.where("kind = 'block'").drop("kind", "term", "df")
    size = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    asked = query_terms(items)
    held = index.where("kind = 'term'").select("term", "df")
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    passes = -(-asked.select("item_id").distinct().count() // params.items)
    group = F.pmod(F.xxhash64("item_id"), F.lit(max(1, passes))).alias("_pass")
    weighed = share_of(asked.join(df, "term").select(group, "item_id", "term", "df"), "query-terms")
    answers = None
    for k in range(passes):
        rows = weighed.where(F.col("_pass") == k).select("item_id", "term", "df").collect()
        if not rows:
            continue
        batch = _asked(sorted(rows, key=lambda r: (str(r["item_id"]), r["term"])), size["n"], size["total"])
        names = spark.createDataFrame(list(enumerate(batch.items)), f"item long, item_id {kind}")
        ranked = _answers(blocks, batch, params).join(F.broadcast(names), "item")
        part = share_of(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
        answers = part if answers is None else answers.unionByName(part)
    return spark.createDataFrame([], schema) if answers is None else answers
