"""Best-fit packing with patterns from a non-negative least-squares fit.

Lengths are counted in a histogram of at most ``capacity`` entries.  Patterns of a few
coarse lengths that nearly fill a sequence are enumerated, their repeat counts are fitted
to the histogram by non-negative least squares, rounded, and filled as far as pieces last.  What
the patterns leave goes, longest first, into the sequence with the least room that takes
it, again by counts: the plan's size depends on ``capacity`` alone.  Documents then get a
rank among those of their length, and the plan turns (length, rank) into a place.

Defined cases: a null text counts as empty; an empty text is the end id alone; documents
longer than the capacity are cut into whole pieces and a rest; repeated rows and ids are
packed as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import share_of
from .tokens import word_ids

_TEXTS = 512  # texts a worker holds as Python strings at a time


@dataclass(frozen=True)
class PackParams:
    """``words``: a worker remembers the ids of at most twice as many words; fewer take less
    memory and more time, the ids are the same."""

    capacity: int = 4096
    bins: int = 64
    pattern_docs: int = 3
    least_fill: float = 0.93
    tokenizer: str = "word_bpe_49k.json"
    end_id: int = 1
    words: int = 300_000


def token_pieces(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, cut at the capacity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size, name, words = params.capacity, params.tokenizer, params.words
    end = int(params.end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = word_ids(public_tokenizers.path(name), words)
        for batch in (b.slice(low, _TEXTS) for b in batches for low in range(0, b.num_rows, _TEXTS)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(coder.encode(texts)):
                data = memoryview(ids + end)
                for k, low in enumerate(range(0, len(data), 4 * size)):
                    part = data[low : low + 4 * size]
                    at.append(i)
                    piece.append(k)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def fit_counts(a: np.ndarray, b: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """Non-negative least squares by an active set."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, dtype=bool)
    pull = a.T @ b
    least = 1e-9 * max(1.0, float(np.abs(pull).max(initial=0)))
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[on] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= least:
            break
        on[best] = True
        while True:
            z = np.zeros(n)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            bad = on & (z <= 0)
            if not bad.any():
                x = z
                break
            gap = x[bad] / np.maximum(x[bad] - z[bad], 1e-300)
            x = x + max(0.0, float(gap.min())) * (z - x)
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                break
    return x


def length_patterns(params: PackParams) -> list[tuple[int, ...]]:
    """Non-increasing tuples of coarse lengths that nearly fill a sequence."""
    out: list[tuple[int, ...]] = []
    low = int(np.ceil(params.least_fill * params.bins))

    def extend(head: tuple[int, ...], total: int) -> None:
        if total >= low:
            out.append(head)
        if len(head) < params.pattern_docs:
            for b in range(min(head[-1] if head else params.bins, params.bins - total), 0, -1):
                extend((*head, b), total + b)

    extend((), 0)
    return out


@dataclass
class Plan:
    """Entries: ``count`` ranks of a length from ``rank`` on, ``each`` to a sequence."""

    capacity: int
    sequences: int = 0
    entries: dict[int, list[tuple[int, int, int, int, int]]] = field(
        default_factory=lambda: defaultdict(list)
    )
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    room: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def open(self, n: int) -> int:
        base, self.sequences = self.sequences, self.sequences + n
        return base

    def put(self, length: int, count: int, base: int, each: int, offset: int) -> None:
        self.entries[length].append((self.used[length], count, base, each, offset))
        self.used[length] += count

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` pieces of a length, each where the least room takes it."""
        rooms = sorted(r for r, g in self.room.items() if g and r >= length)
        while count:
            while rooms and not self.room[rooms[0]]:
                rooms.pop(0)
            if rooms:
                left = rooms[0]
                base, n = self.room[left].pop()
            else:
                left = self.capacity
                n = -(-count // (left // length))
                base = self.open(n)
            each = left // length
            full = min(n, count // each)
            if full:
                self.put(length, full * each, base, each, self.capacity - left)
                self.room[left - each * length].append((base, full))
                count -= full * each
                if n > full:
                    self.room[left].append((base + full, n - full))
                    if left not in rooms:
                        rooms.insert(0, left)
            else:
                self.put(length, count, base, count, self.capacity - left)
                self.room[left - count * length].append((base, 1))
                if n > 1:
                    self.room[left].append((base + 1, n - 1))
                count = 0


class _Stock:
    """Pieces left of each length; finds the longest one up to a room."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = [histogram.get(n, 0) for n in range(capacity + 1)]
        self.below = [n if c else n - 1 for n, c in enumerate(self.left)]
        self.below[0] = 0

    def longest(self, room: int) -> int:
        """The longest length in stock that is at most ``room``, else 0."""
        found = room
        while found and not self.left[found]:
            found = self.below[found] if self.below[found] < found else found - 1
        while room > found:  # shorten the way for the next search
            room, self.below[room] = self.below[room] if self.below[room] < room else room - 1, found
        return found


def plan_packing(histogram: dict[int, int], params: PackParams = PackParams()) -> Plan:
    """Places for all pieces of a histogram of lengths (1 to ``capacity``)."""
    plan, width = Plan(params.capacity), -(-params.capacity // params.bins)
    stock = _Stock(histogram, params.capacity)
    have = np.zeros(params.bins + 1)
    for length, count in histogram.items():
        have[-(-length // width)] += count
    patterns = [p for p in length_patterns(params) if all(have[b] >= p.count(b) for b in p)]
    if patterns:
        shape = np.zeros((params.bins + 1, len(patterns)))
        for j, p in enumerate(patterns):
            for b in p:
                shape[b, j] += 1
        scale = have.max()
        fitted = np.rint(fit_counts(shape, have / scale) * scale).astype(np.int64)
        # Patterns of long pieces first: what they lack, shorter ones can still fill.
        for j in sorted(np.flatnonzero(fitted > 0), key=lambda j: patterns[j], reverse=True):
            _repeat(plan, stock, patterns[j], int(fitted[j]), width)
    for length in range(params.capacity, 0, -1):
        if stock.left[length]:
            plan.best_fit(length, stock.left[length])
    return plan


def _repeat(plan: Plan, stock: _Stock, pattern: tuple[int, ...], times: int, width: int) -> None:
    """Fill a pattern with the longest pieces of its bins; the last takes what fits best.

    Stops early when a bin has run out; the pieces that are left are packed later.
    """
    while times > 0:
        room, lengths = plan.capacity, []
        for k, b in enumerate(pattern):
            limit = room if k == len(pattern) - 1 else min(room, b * width)
            length = stock.longest(limit)
            while length and lengths.count(length) >= stock.left[length]:
                length = stock.longest(length - 1)
            if length <= (b - 1) * width:
                return
            lengths.append(length)
            room -= length
        now = min(times, *[stock.left[n] // lengths.count(n) for n in lengths])
        base, offset = plan.open(now), 0
        for n in lengths:
            plan.put(n, now, base, 1, offset)
            stock.left[n] -= now
            offset += n
        plan.room[room].append((base, now))
        times -= now


def place_ranks(pieces: DataFrame, histogram: dict[int, int], keys: list[str]) -> DataFrame:
    """Add ``rank``: 0-based position among the pieces of the same length.

    A length is dealt into about as many parts as a part has rows, so neither a frequent
    length nor the list of its parts grows large in one task.
    """
    spark = pieces.sparkSession
    parts = spark.createDataFrame(
        [(k, int(np.ceil(np.sqrt(v)))) for k, v in histogram.items()], "length long, parts int"
    )
    salted = pieces.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64(*keys), F.col("parts")).cast("int")
    )
    counts = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = counts.select(
        "length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    own = Window.partitionBy("length", "_part").orderBy(*keys)
    ranked = salted.withColumn("_row", F.row_number().over(own) - 1)
    placed = ranked.join(bases, ["length", "_part"])
    return placed.withColumn("rank", F.col("_row") + F.col("_base")).drop("_row", "_base", "_part", "parts")


def pack_documents(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = share_of(token_pieces(docs, params), "pieces")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packing(histogram, params)
    arrays = {k: np.array(v, dtype=np.int64) for k, v in plan.entries.items()}
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, pos = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for at in np.split(order, cuts) if len(order) else ():
            e = shared.value[int(size[at[0]])]
            row = e[np.searchsorted(e[:, 0], pos[at], side="right") - 1]
            k = pos[at] - row[:, 0]
            seq[at] = row[:, 2] + k // row[:, 3]
            off[at] = row[:, 4] + (k % row[:, 3]) * size[at]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = place_ranks(pieces, histogram, ["doc_id", "piece", "start", "ids_crc32"])
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", place("length", "rank").alias("_at")
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.*")
