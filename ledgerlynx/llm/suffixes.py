"""Repeated byte strings: every byte covered by a long string that starts anywhere else.

A window is a string of ``length`` bytes.  Each window has an anchor, the first least of
its hashed grams, so equal windows have equal anchors at equal places.  Windows are dealt
to units by anchor and by part of the range of places; all windows of a unit share a core
of bytes, and windows can only be equal if their cores are.  Contexts (the bytes that the
windows of a unit cover) that occur twice are repeated throughout.  Where contexts of one
core differ, their suffixes are sorted: the core is one symbol, the bytes around it are
symbols of their own, and windows are equal if neighbours in the suffix array agree for a
window's length.

The suffix array is built in linear time by grouping: suffixes are grouped by their Lyndon
prefix, groups are processed in descending order by pointers to the previous suffix of a
smaller group, and a second pass emits the order within each group; nothing is renamed or
sorted again.  A core with very many contexts is resolved window by window instead.

Defined cases: a null text is empty and has nothing to remove; a text shorter than the
length keeps all bytes; repeated rows are repeats of each other; an empty table gives an
empty result; matches never cross texts, and overlapping matches within one text count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share_of

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PLACE_BITS = 26  # bytes handled at a time: windows of longer texts start in the next piece
_PIECE = 1 << 21


@dataclass(frozen=True)
class RepeatParams:
    """``contexts`` is how many different contexts of one core are sorted together."""

    length: int = 400
    gram: int = 32
    parts: int = 8
    contexts: int = 512

    @property
    def places(self) -> int:
        return self.length - self.gram + 1

    @property
    def width(self) -> int:
        return -(-self.places // self.parts)


def group_suffixes(text: list[int]) -> list[int]:
    """Suffix array of integers, the last of which is their single least.

    Linear grouping: groups by Lyndon prefix, in descending order, then one emitting pass.
    """
    n = len(text)
    if not n:
        return []
    # Groups by first symbol; a group is named by where it starts among all suffixes.
    order = sorted(range(n), key=text.__getitem__)
    place, start, size, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    last, head = None, 0
    for at, i in enumerate(order):
        if text[i] != last:
            last, head = text[i], at
        place[i], start[i] = at, head
        size[head] += 1
    end = n
    while end > 0:
        low = start[order[end - 1]]
        group = order[low:end]
        if len(group) > 1:
            group.sort()
        pointed: dict[int, int] = {}
        for i in group:
            j = i - 1
            while j >= 0 and start[j] >= low:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            by_group: dict[int, list[int]] = {}
            for j in by_count[c]:
                by_group.setdefault(start[j], []).append(j)
            # A subset moves to a new group right after its old one.
            for old, moved in by_group.items():
                room = size[old]
                if len(moved) == room:
                    continue
                new = old + room - len(moved)
                size[old], size[new] = room - len(moved), len(moved)
                to = old + room
                for j in moved:
                    to -= 1
                    here, other = place[j], order[to]
                    order[here], order[to] = other, j
                    place[other], place[j] = here, to
                for j in moved:
                    start[j] = new
        end = low
    # Emit: a suffix goes to the front of its group when the suffix after it is placed.
    out: list[int] = [-1] * n
    front = [0] * n
    out[0] = n - 1
    front[start[n - 1]] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0:
            head = start[j]
            if place[j] < 0:
                break
            out[head + front[head]] = j
            front[head] += 1
            place[j] = -1
            j = prev[j]
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place on."""
    n = len(data) - gram + 1
    out = np.zeros(n, dtype=np.uint64)
    power, whole, width, done = _STEP | 1, data.astype(np.uint64) + np.uint64(1), 1, 0
    while True:  # grams of doubling width, joined as the bits of ``gram`` say
        if gram & width:
            shift = pow(_STEP | 1, width, 1 << 64)
            out = out * np.uint64(shift) + whole[done : done + n]
            done += width
        if 2 * width > gram:
            break
        whole = whole[:-width] * np.uint64(power) + whole[width:]
        power, width = power * power & _MASK, 2 * width
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, params: RepeatParams):
    """(anchor, first start, last start, gram hash) of all windows of a text."""
    out = []
    for low in range(0, max(0, len(data) - params.length + 1), _PIECE):
        piece = data[low : low + _PIECE + params.length - 1]
        h = gram_hashes(piece, params.gram)
        low_bits = np.uint64((1 << _PLACE_BITS) - 1)
        best = (h & ~low_bits) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= params.places:
            best, span = np.minimum(best[:-span], best[span:]), 2 * span
        rest = params.places - span
        if rest:
            best = np.minimum(best[: len(best) - rest], best[rest:])
        at = (best & low_bits).astype(np.int64)
        turn = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], turn))
        last = np.concatenate((turn, [len(at)])) - 1
        spot = at[first]
        out.append((spot + low, first + low, last + low, h[spot].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_windows(contexts: list[tuple[int, int, int, bytes, bytes]], width: int) -> list[int]:
    """Bits of the places (from the unit's first) whose window occurs in another context.

    A context: core number, least and greatest place, bytes before and after the core.
    """
    text: list[int] = []
    begin = []
    for core, _, _, left, right in contexts:
        begin.append(len(text))
        text.extend(b + 2 for b in left)
        text.append(258 + core)
        text.extend(b + 2 for b in right)
        text.append(1)
    text.append(0)
    owner = np.full(len(text), -1)
    for c, (core, least, most, left, right) in enumerate(contexts):
        owner[begin[c] : begin[c] + most - least + 1] = c
    order = np.array(group_suffixes(text))
    order = order[owner[order] >= 0]
    symbols = np.array(text)
    bits = [0] * len(contexts)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for k in range(width):
        same[same] = symbols[a[same] + k] == symbols[b[same] + k]
    for i in np.unique(np.concatenate((a[same], b[same]))):
        c = owner[i]
        least, most = contexts[c][1:3]
        bits[c] |= 1 << int(most - (i - begin[c]) - least // width * width)
    return bits


def _text_id(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tid", F.unhex(F.md5(F.col("text").cast("binary"))))


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text"):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _grams(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """(tid, fp, n): the anchors' gram hashes of every text, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fps, ns = [], [], []
            for i, data in enumerate(_bytes(batch)):
                fp = anchors(np.frombuffer(data, dtype=np.uint8), params)[3]
                if len(fp):
                    u, n = np.unique(fp, return_counts=True)
                    at.append(np.full(len(u), i))
                    fps.append(u)
                    ns.append(n)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("tid").take(pa.array(np.concatenate(at))),
                        pa.array(np.concatenate(fps)),
                        pa.array(np.concatenate(ns).astype(np.int64)),
                    ],
                    names=["tid", "fp", "n"],
                )

    return docs.select("tid", "text").mapInArrow(run, "tid binary, fp long, n long")


def _pieces(spot: int, first: int, last: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(part, least place, greatest place) of an anchor's windows, by parts."""
    low, high = spot - last, spot - first
    for k in range(low // width, high // width + 1):
        yield k, max(low, k * width), min(high, k * width + width - 1)


def _units(joined: DataFrame, params: RepeatParams) -> DataFrame:
    """(tid, spot, least, most, core, unit) of windows at anchors that occur twice."""
    length, width = params.length, params.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                at, rows = [], []
                for i, (data, known) in enumerate(zip(_bytes(part), part.column("fps"), strict=True)):
                    spots, firsts, lasts, fps = anchors(np.frombuffer(data, dtype=np.uint8), params)
                    good = np.isin(fps, known.values.to_numpy())
                    for spot, first, last in zip(
                        spots[good].tolist(), firsts[good].tolist(), lasts[good].tolist(), strict=True
                    ):
                        for k, least, most in _pieces(spot, first, last, width):
                            begin = spot - k * width
                            core = data[begin : begin + length - width + 1]
                            whole = data[spot - most : spot - least + length]
                            key = xxhash.xxh64_intdigest(core, k)
                            unit = xxhash.xxh64_intdigest(whole, (least << 12) | (most - least))
                            at.append(i)
                            rows.append((spot, least, most, key, unit))
                if rows:
                    c = np.array(rows, dtype=np.uint64).view(np.int64).reshape(-1, 5)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("tid").take(pa.array(at)),
                            pa.array(c[:, 0]),
                            pa.array(c[:, 1].astype(np.int32)),
                            pa.array(c[:, 2].astype(np.int32)),
                            pa.array(c[:, 3]),
                            pa.array(c[:, 4]),
                        ],
                        names=["tid", "spot", "least", "most", "core", "unit"],
                    )

    return joined.mapInArrow(
        run, "tid binary, spot long, least int, most int, core long, unit long"
    )


def _contexts(joined: DataFrame, params: RepeatParams) -> DataFrame:
    """(core, unit, least, most, left, right, wide): bytes around the cores of asked units."""
    length, width = params.length, params.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, asked in zip(_bytes(batch), batch.column("asked").to_pylist(), strict=True):
                for u in asked:
                    spot, least, most = u["spot"], u["least"], u["most"]
                    begin = spot - least // width * width
                    end = begin + length - width + 1
                    left, right = data[spot - most : begin], data[end : spot - least + length]
                    rows.append((u["core"], u["unit"], least, most, left, right, u["wide"]))
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(c, kinds, strict=True)],
                    names=["core", "unit", "least", "most", "left", "right", "wide"],
                )

    return joined.mapInArrow(
        run,
        "core long, unit long, least int, most int, left binary, right binary, wide boolean",
    )


def _sorted_masks(contexts: DataFrame, params: RepeatParams) -> DataFrame:
    """(core, unit, mask) from the suffix arrays of contexts that share a core.

    Rows come sorted by core; whole cores are sorted together, some thousands of contexts
    at a time, and a core's symbol keeps it apart from the others.
    """
    width = params.width

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        number = {c: i for i, c in enumerate(dict.fromkeys(r[0] for r in rows))}
        masks = repeated_windows([(number[r[0]], *r[2:6]) for r in rows], width)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(masks, pa.int64())],
            names=["core", "unit", "mask"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(held) >= 2_000 and held[-1][0] != row[0]:
                    yield resolve(held)
                    held = []
                held.append(row)
        if held:
            yield resolve(held)

    sorted_rows = contexts.repartition("core").sortWithinPartitions("core", "unit")
    return sorted_rows.select("core", "unit", "least", "most", "left", "right").mapInArrow(
        run, "core long, unit long, mask long"
    )


def _wide_masks(contexts: DataFrame, params: RepeatParams) -> DataFrame:
    """(core, unit, mask) of cores with very many contexts, one row for each window."""
    width = params.width
    window = (
        contexts.withColumn("place", F.explode(F.sequence("least", "most")))
        .withColumn("_k", F.col("place") % width)
        .withColumn("_from", (F.col("most") - F.col("place") + 1))
        .withColumn("_l", F.expr("substring(left, _from)"))
        .withColumn("_r", F.expr(f"substring(right, 1, {width} - 1 - _k)"))
        .withColumn("key", F.xxhash64("core", "place", F.hex("_l"), F.hex("_r")))
        .select("core", "unit", "place", "_k", "key")
    )
    counts = window.groupBy("core", "key").count().where("count > 1").select("core", "key")
    found = window.join(share_of(counts, "window-counts"), ["core", "key"])
    bit = F.expr("shiftleft(1L, _k)")
    return found.groupBy("core", "unit").agg(F.bit_or(bit).alias("mask"))


def find_repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """(tid, starts): windows of a text that start anywhere else too; reads ``text`` only.

    ``tid`` is the text's digest; a start is (spot, least, most, mask), as units have them.
    """
    texts = _text_id(docs.where("text is not null").select("text"))
    grams = share_of(_grams(texts, params), "grams")
    twice = grams.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    known = grams.select("tid", "fp").join(share_of(twice, "repeated-grams"), "fp")
    known = share_of(known.groupBy("tid").agg(F.collect_set("fp").alias("fps")), "text-grams")
    units = share_of(_units(texts.join(known, "tid"), params), "units")
    place = F.xxhash64("tid", "spot")
    found = units.groupBy("core", "unit").agg(
        F.count("*").alias("n"), F.min(place).alias("rep")
    )
    found = share_of(found, "unit-counts")
    cores = found.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
    cores = share_of(cores.where("all > 1"), "core-counts")
    live = share_of(found.join(cores, "core").drop("all"), "live-units")
    # Contexts of a core that differ: one place of each is looked up again.
    asked = live.where("kinds > 1").select(
        "core", "unit", "rep", (F.col("kinds") > params.contexts).alias("wide")
    )
    asked = units.join(asked, ["core", "unit"]).where(place == F.col("rep"))
    entry = F.struct("spot", "least", "most", "core", "unit", "wide")
    asked = share_of(asked.groupBy("tid").agg(F.collect_set(entry).alias("asked")), "asked")
    contexts = _contexts(texts.join(asked, "tid"), params).dropDuplicates(["core", "unit"])
    contexts = share_of(contexts, "contexts")
    masks = _sorted_masks(contexts.where("not wide"), params)
    masks = share_of(masks.unionByName(_wide_masks(contexts.where("wide"), params)), "masks")
    # A context that occurs twice is repeated at all its places.
    whole = F.lit((1 << params.width) - 1).cast("long")
    judged = (
        live.join(masks, ["core", "unit"], "left")
        .select(
            "core",
            "unit",
            F.when(F.col("n") > 1, whole).otherwise(F.coalesce("mask", F.lit(0).cast("long"))).alias("mask"),
        )
        .where("mask <> 0")
    )
    judged = share_of(judged, "judged-units")
    hits = units.join(judged, ["core", "unit"])
    start = F.struct("spot", "least", "most", "mask")
    starts = hits.groupBy("tid").agg(F.collect_set(start).alias("starts"))
    return share_of(starts, "repeats")


def _covered(n: int, starts: list[dict], params: RepeatParams) -> list[tuple[int, int]]:
    """Maximal runs of bytes that repeated windows cover."""
    width, length = params.width, params.length
    edge = np.zeros(n + 1, dtype=np.int32)
    for s in starts:
        base = s["least"] // width * width
        if s["mask"] == (1 << width) - 1:
            edge[s["spot"] - s["most"]] += 1
            edge[s["spot"] - s["least"] + length] -= 1
            continue
        for place in range(s["least"], s["most"] + 1):
            if s["mask"] >> (place - base) & 1:
                edge[s["spot"] - place] += 1
                edge[s["spot"] - place + length] -= 1
    on = np.concatenate(([0], (np.cumsum(edge[:n]) > 0).astype(np.int8), [0]))
    turn = np.diff(on)
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True))


def remove_repeats(
    docs: DataFrame, params: RepeatParams = RepeatParams(), text: bool = True
) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, and ``text`` without repeats.

    All columns pass through, except ``text`` if ``text`` is false.  Where a removed run
    cuts a character, its left-over bytes leave the text too; the digest has all bytes.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    passed = [c for c in docs.columns if c != "text" and c not in added]
    rows = docs.select(F.struct(*passed).alias("row"), "text")
    joined = _text_id(rows).join(find_repeats(docs, params), "tid", "left")
    extra = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kind = f"row {rows.schema['row'].dataType.simpleString()}, {extra}"
    kind += ", text string" if text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, digest, kept = [], [], [], [], []
            for data, starts, valid in zip(
                _bytes(batch),
                batch.column("starts").to_pylist(),
                batch.column("text").is_valid().to_pylist(),
                strict=True,
            ):
                runs = _covered(len(data), starts, params) if starts else []
                ends = [0, *[x for r in runs for x in r], len(data)]
                left = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                total.append(len(data))
                gone.append(len(data) - len(left))
                spans.append(len(runs))
                digest.append(hashlib.sha256(left).hexdigest())
                if text:
                    kept.append(left.decode("utf-8", "ignore") if valid else None)
            columns = [batch.column("row")]
            columns += [pa.array(x, pa.int64()) for x in (total, gone, spans)]
            columns.append(pa.array(digest, pa.string()))
            names = ["row", *added]
            if text:
                columns.append(pa.array(kept, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = joined.select("row", "text", "starts").mapInArrow(run, kind)
    return kept.select("row.*", *added, *(["text"] if text else []))
