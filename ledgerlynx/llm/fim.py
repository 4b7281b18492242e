"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames with the units and characters that end
before each frame's end.  A cut after k units is found in the counts; only its frame is
decompressed to find the place.  The transformed text is a stream of ordered frames, packed
into frames of its own, and digests and the way back read those in order, so no more than a
few frames of a text are plain at a time.

Units are runs of A-Z and a-z, or single other characters.  Prefix, middle and suffix end
after ``h1 % (n+1)`` and ``h2 % (n+1)`` units, the smaller first; h1 to h4 are the first
eight-digit groups of the sha256 of ``1:`` and the id.

Defined cases: a null text counts as empty; an empty text, or one that spells a mark, stays
plain; a null id draws as an empty one; repeated rows are transformed as rows of their own;
an empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_of
from .frames import Framed, framed, pack

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARK = 3  # bytes of each

_FRAMES = "frames binary, packed_ends array<long>, plain_ends array<long>"
STORED = f"doc_id {{kind}}, n long, marked boolean, {_FRAMES}, unit_ends array<long>, char_ends array<long>"
MADE = (
    "doc_id {kind}, n long, form string, prefix_chars long, middle_chars long,"
    " output binary, output_packed array<long>, output_plain array<long>"
)


@dataclass(frozen=True)
class FimParams:
    """``rate`` of 100 documents change form, ``spm`` of those 100 to suffix first."""

    frame_bytes: int = 1 << 16
    level: int = 3
    rate: int = 90
    spm: int = 20
    salt: str = "1"


# -- storing ------------------------------------------------------------------


def _starts(data: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte starts a unit, and whether it starts a character.

    ``joined``: the byte before the first one is a letter.
    """
    low = data | 0x20
    letter = (low >= 97) & (low <= 122)
    char = (data & 0xC0) != 0x80
    after = np.empty_like(letter)
    after[:1], after[1:] = joined, letter[:-1]
    return char & ~(letter & after), char


def _is_letter(byte: int) -> bool:
    return 97 <= byte | 0x20 <= 122


def store_frames(docs: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """Every text as frames with cumulative counts of units and characters.

    Columns: doc_id, n (units), marked (spells a mark), frames (one after another),
    packed_ends, plain_ends (bytes), unit_ends and char_ends, one value per frame.
    """
    kind, size = docs.schema["doc_id"].dataType.simpleString(), params.frame_bytes

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out: list[list] = [[] for _ in range(7)]
            for cell in texts:
                data = cell.as_py() or b""
                blob, packed, plain, units, chars = bytearray(), [], [], [], []
                n = c = 0
                for low in range(0, len(data), size):
                    part = data[low : low + size]
                    blob += pack(part, params.level)
                    joined = low > 0 and _is_letter(data[low - 1])
                    unit, char = _starts(np.frombuffer(part, np.uint8), joined)
                    n, c = n + int(np.count_nonzero(unit)), c + int(np.count_nonzero(char))
                    packed.append(len(blob))
                    plain.append(low + len(part))
                    units.append(n)
                    chars.append(c)
                marked = PREFIX in data or SUFFIX in data or MIDDLE in data
                row = (n, marked, bytes(blob), packed, plain, units, chars)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.bool_(), pa.binary(), longs, longs, longs, longs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                names=["doc_id", "n", "marked", "frames", "packed_ends", "plain_ends", "unit_ends", "char_ends"],
            )

    return docs.select("doc_id", "text").mapInArrow(store, STORED.format(kind=kind))


# -- cuts ---------------------------------------------------------------------


def drawn(doc_id: Column, params: FimParams = FimParams()) -> list[Column]:
    """h1 to h4 of a document."""
    key = F.concat(F.lit(f"{params.salt}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def choose_cuts(stored: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """Adds form, and low and high, the units before the middle and before the suffix."""
    h1, h2, h3, h4 = drawn(F.col("doc_id"), params)
    room = F.col("n") + 1
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= params.rate)
    form = F.when(plain, "plain").when(h4 % 100 < params.spm, "spm").otherwise("psm")
    return stored.withColumns(
        {"form": form, "low": F.least(h1 % room, h2 % room), "high": F.greatest(h1 % room, h2 % room)}
    )


def _place(text: Framed, units: list[int], chars: list[int], k: int) -> tuple[int, int]:
    """Bytes and characters before the cut after ``k`` units; unpacks one frame."""
    f = int(np.searchsorted(units, k, side="right"))
    if f == len(units):
        return (text.plain[-1], chars[-1]) if units else (0, 0)
    before = units[f - 1] if f else 0
    data = np.frombuffer(text.frame(f), np.uint8)
    unit, char = _starts(data, False)
    # With the byte before it unknown, a frame that goes on with a unit shows one start more.
    places = np.flatnonzero(unit)[int(np.count_nonzero(unit)) - (units[f] - before) :]
    at = int(places[k - before])
    start, seen = (text.plain[f - 1], chars[f - 1]) if f else (0, 0)
    return start + at, seen + int(np.count_nonzero(char[:at]))


# -- the transformed text -----------------------------------------------------


def _ordered(text: Framed, form: str, low: int, high: int) -> Iterator[bytes | memoryview]:
    end = text.plain[-1] if text.plain else 0
    if form == "plain":
        yield from text.stream(0, end)
        return
    prefix, suffix = (PREFIX, 0, low), (SUFFIX, high, end)
    first, second = (prefix, suffix) if form == "psm" else (suffix, prefix)
    for mark, start, stop in (first, second, (MIDDLE, low, high)):
        yield mark
        yield from text.stream(start, stop)


def transform(cut: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """The transformed texts as frames, from :func:`choose_cuts`.

    Columns: doc_id, n, form, prefix_chars, middle_chars, output (frames), output_packed
    and output_plain (their ends).
    """
    kind = cut.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            columns = [batch.column(c) for c in _READ]
            for cells in zip(*columns, strict=True):
                frames, packed, plain, units, chars, form, low, high = [c.as_py() for c in cells]
                text = Framed(frames, packed, plain)
                prefix_chars = middle_chars = None
                if form != "plain":
                    low, prefix_chars = _place(text, units, chars, low)
                    high, upto = _place(text, units, chars, high)
                    middle_chars = upto - prefix_chars
                made = framed(_ordered(text, form, low, high), params.frame_bytes, params.level)
                for column, value in zip(out, (prefix_chars, middle_chars, *made), strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.binary(), longs, longs]
            made_columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n", "form")], *made_columns],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", *_OUTPUT],
            )

    return cut.select("doc_id", "n", *_READ).mapInArrow(make, MADE.format(kind=kind))


_READ = ["frames", "packed_ends", "plain_ends", "unit_ends", "char_ends", "form", "low", "high"]
_OUTPUT = ["output", "output_packed", "output_plain"]


# -- reading it back ----------------------------------------------------------


def _mark_places(parts: Iterable, marks: list[bytes]) -> list[int]:
    """First place of each mark, in this order, over a stream of byte strings."""
    found, seen, tail = [], 0, b""
    wanted = list(marks)
    for part in parts:
        data = tail + bytes(part)
        base, start = seen - len(tail), 0
        while wanted:
            at = data.find(wanted[0], start)
            if at < 0:
                break
            found.append(base + at)
            start = at + _MARK
            wanted.pop(0)
        seen += len(part)
        if not wanted:
            break
        tail = data[max(start, len(data) - _MARK + 1) :]
    if wanted:
        raise ValueError(f"no {wanted[0]!r} in a transformed text")
    return found


def restored(output: Framed, form: str) -> Iterator[memoryview]:
    """The original text, in order, from a transformed one and its form."""
    end = output.plain[-1] if output.plain else 0
    if form == "plain":
        yield from output.stream(0, end)
        return
    marks = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    places = _mark_places(output.stream(0, end), marks)
    span = {
        mark: (low + _MARK, high)
        for mark, low, high in zip(marks, places, [*places[1:], end], strict=True)
    }
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*span[mark])


def _per_output(made: DataFrame, extra: str, of: Callable[[Framed, str], list]) -> DataFrame:
    """Map every transformed text to further columns, in place of its frames."""
    keep = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    kept = ", ".join(f"{c} {made.schema[c].dataType.simpleString()}" for c in keep)
    names = [c.split()[0] for c in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*[batch.column(c) for c in (*_OUTPUT, "form")], strict=True)
            rows = [of(Framed(*[c.as_py() for c in r[:3]]), r[3].as_py()) for r in cells]
            more = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(c, pa.string()) for c in more]],
                names=[*keep, *names],
            )

    return made.select(*keep, *_OUTPUT).mapInArrow(run, f"{kept}, {extra}")


def _sha256(parts: Iterable) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def output_digests(made: DataFrame) -> DataFrame:
    """Adds output_sha256 and restored_sha256, both streamed over the output's frames."""

    def digests(output: Framed, form: str) -> list:
        end = output.plain[-1] if output.plain else 0
        return [_sha256(output.stream(0, end)), _sha256(restored(output, form))]

    return _per_output(made, "output_sha256 string, restored_sha256 string", digests)


def output_texts(made: DataFrame) -> DataFrame:
    """Adds the transformed texts themselves as ``text``."""

    def whole(output: Framed, form: str) -> list:
        end = output.plain[-1] if output.plain else 0
        return [b"".join(output.stream(0, end)).decode()]

    return _per_output(made, "text string", whole)


def fill_in_middle(docs: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """Store the texts as frames in the shared folder, and transform them from there."""
    stored = share_of(store_frames(docs, params), "text-frames")
    return transform(choose_cuts(stored, params), params)
