"""Token ids in seekable files: independent frames, a seek table, checksums per frame.

Documents are dealt by ranges of their id, in ascending order, and every range becomes one
file.  Its stream is the ids of its documents, little-endian unsigned 32-bit, one document
after another, each closed by the end id; every frame holds the same number of ids, so a
document of any length spans as many frames as it needs.  A document index lies beside the
stream and a seek table at the end, so a reader decompresses only the frames of the
documents it asks for.  Files get a name of their own in every attempt of a task, and only
the stored manifest says which count: a lost executor leaves at most a file nobody reads.

Defined cases: a null text counts as empty; an empty text is the end id alone; rows without
an id come after all others; rows that share an id follow each other in the order of a hash
of their text, and a request for the id returns all of them; an empty table gives no file
and no rows.  Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import share_of
from .frames import SeekableReader, SeekableWriter
from .tokens import _byte_letters

_CACHED = 1_200_000  # words a worker remembers; then it starts anew
_LONGEST = 64  # characters of a word worth remembering
_OUT = 4 << 20  # bytes of ids in one batch of a reader

MANIFEST = "part long, path string, bytes long, n_docs long, n_ids long, frames long, first_id long, last_id long"


@dataclass(frozen=True)
class TokenFileParams:
    """``frame_ids`` ids make a frame; a scan reads ``scan_frames`` frames a row."""

    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 0
    frame_ids: int = 1 << 16
    level: int = 3
    scan_frames: int = 64


# The letters and numbers below U+0250, where most texts stay.
_LETTERS = "a-zA-Zªµº\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_BEYOND = "\u0250"
_NUMBERS = "0-9²³¹¼½¾"
_LOW = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+"
).findall
_PLAIN_WORD = re.compile("[!-~]*").fullmatch  # after its blank, if it has one


class _Known(dict):
    """Word to its ids as bytes; the library is asked for a new word once."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        blank = word[:1] == " "
        if _PLAIN_WORD(word, int(blank)):  # bytes that are written as themselves
            spelled = self.letters[32] + word[1:] if blank else word
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(spelled)]
        data = pack(f"<{len(ids)}I", *ids)
        if len(word) <= _LONGEST:
            self[word] = data
        return data


class ByteIds:
    """Ids of whole texts under a byte-level vocabulary, remembering single words.

    Such a vocabulary splits a text into words by a fixed pattern and encodes word by word.
    The pattern asks only whether a character is a letter, a number or white space; before a
    character counts as known here, the library is asked how it sees it.  A text with a
    character that both see differently, or one that spells a special token, goes to the
    library whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.same: set[str] = set()
        self.other: set[str] = set()
        self.known = _Known(self.tokenizer.model)

    def _agrees(self, char: str) -> bool:
        """Both split the character alike after a letter, a digit, a sign and blanks."""
        for probe in (f"a{char}", f"1{char}", f"!{char}", f" {char}", f"  {char}a"):
            ends = [end for _, (_, end) in self.split(probe)]
            for words in (self.words, _LOW)[: 1 + (char < _BEYOND)]:
                if ends != np.cumsum([len(w) for w in words(probe)]).tolist():
                    return False
        return True

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        chars = set(text)
        fresh = chars - self.same
        if fresh:
            for char in fresh - self.other:
                (self.same if self._agrees(char) else self.other).add(char)
            if not fresh.isdisjoint(self.other):
                return self.library(text)
        if any(s in text for s in self.special):
            return self.library(text)
        if len(self.known) > _CACHED:
            self.known.clear()
        words = _LOW if max(chars, default="") < _BEYOND else self.words
        return b"".join(map(self.known.__getitem__, words(text)))


@cache
def byte_ids(path: str) -> ByteIds:
    """One encoder per worker process."""
    return ByteIds(path)


@contextmanager
def _opened(path: str, mode: str):
    """A stream on any file system that the path names, local or remote."""
    from pyarrow import fs

    path = re.sub(r"^file:/*", "/", path)
    system, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as sink:
            yield sink
    else:
        with system.open_input_file(inner) as source:
            yield source


class TokenFile:
    """One file of a manifest: its documents by place or by id."""

    def __init__(self, source, size: int, params: TokenFileParams):
        self.reader, self.params = SeekableReader(source, size), params
        index = b"".join(map(self.reader.content, self.reader.asides))
        cells = np.frombuffer(index, dtype=[("id", "<i8"), ("known", "u1"), ("n", "<i8")])
        self.ids, self.known, self.n = cells["id"], cells["known"].astype(bool), cells["n"]
        self.start = np.cumsum(self.n) - self.n
        self._held: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = (k, self.reader.content(self.reader.frames[k]))
        return self._held[1]

    def document(self, k: int) -> bytes:
        """Ids of the k-th document, from the frames that hold them."""
        size, low, high = self.params.frame_ids, int(self.start[k]), int(self.start[k] + self.n[k])
        parts = []
        for f in range(low // size, -(-high // size)):
            base = f * size
            parts.append(self._frame(f)[4 * max(0, low - base) : 4 * (high - base)])
        return b"".join(parts)

    def starting_in(self, low_frame: int, high_frame: int) -> range:
        """Documents whose first id lies in these frames."""
        size = self.params.frame_ids
        return range(*np.searchsorted(self.start, [low_frame * size, high_frame * size]).tolist())

    def having(self, doc_id: int) -> range:
        """Documents of one id; rows without an id come last and are never meant."""
        ids = self.ids[: int(self.known.sum())]
        return range(int(np.searchsorted(ids, doc_id)), int(np.searchsorted(ids, doc_id, "right")))


def write_token_files(docs: DataFrame, params: TokenFileParams = TokenFileParams()) -> DataFrame:
    """Encode and write all documents; returns the stored manifest, one row per file.

    ``part`` orders the files, ``base`` counts the ids of all files before one.  Reads
    ``doc_id`` and ``text``.
    """
    folder = new_folder(docs.sparkSession, "token-files")
    end = int(params.end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        coder, context = byte_ids(public_tokenizers.path(params.tokenizer)), TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.ids.zst"
        ids, known, lengths, held, n = [], [], [], bytearray(), 4 * params.frame_ids
        with _opened(path, "w") as sink:
            out = SeekableWriter(sink, params.level)
            for batch in _with_first(first, batches):
                keys = batch.column("doc_id")
                ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
                known.append(keys.is_valid().to_numpy(zero_copy_only=False))
                for text in batch.column("text"):
                    data = coder.encode(text.as_py() or "") + end
                    lengths.append(len(data) // 4)
                    held += data
                    while len(held) >= n:
                        out.frame(bytes(held[:n]))
                        del held[:n]
            if held:
                out.frame(bytes(held))
            index = np.zeros(len(lengths), dtype=[("id", "<i8"), ("known", "u1"), ("n", "<i8")])
            index["id"], index["known"], index["n"] = np.concatenate(ids), np.concatenate(known), lengths
            for low in range(0, len(index), 1 << 20):
                out.aside(index[low : low + (1 << 20)].tobytes())
            frames = out.close()
        named = index["id"][index["known"].astype(bool)]
        row = {
            "part": context.partitionId(),
            "path": path,
            "bytes": out.size,
            "n_docs": len(index),
            "n_ids": int(index["n"].sum()),
            "frames": frames,
            "first_id": int(named[0]) if len(named) else None,
            "last_id": int(named[-1]) if len(named) else None,
        }
        types = [pa.string() if c == "path" else pa.int64() for c in row]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row)
        )

    order = [F.col("doc_id").asc_nulls_last(), F.col("_text_hash").asc(), F.col("_row").asc()]
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("_text_hash"),
        F.monotonically_increasing_id().alias("_row"),  # ranges split any number of equal rows
    )
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = share_of(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    # One row per file.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _with_first(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


_READ = "doc_id long, start long, n_tokens long, ids binary"


def _emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes from (doc_id, start, n_tokens, ids)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size >= _OUT:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


def _document_row(file: TokenFile, base: int, k: int) -> tuple:
    key = int(file.ids[k]) if file.known[k] else None
    return key, base + int(file.start[k]), int(file.n[k]), file.document(k)


def scan_token_files(manifest: DataFrame, params: TokenFileParams = TokenFileParams()) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all before it), n_tokens, ids.

    Rows of the scan are groups of frames, so large files are read by many tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    with _opened(r["path"], "r") as source:
                        file = TokenFile(source, r["bytes"], params)
                        for k in file.starting_in(r["low"], r["low"] + params.scan_frames):
                            yield _document_row(file, r["base"], k)

        yield from _emit(rows())

    step = F.lit(params.scan_frames).cast("long")
    lows = F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, step)
    groups = manifest.select("path", "bytes", "base", F.explode(lows).alias("low"))
    return groups.repartition("path", "low").mapInArrow(read, _READ)


def read_documents(
    manifest: DataFrame, wanted: DataFrame, params: TokenFileParams = TokenFileParams()
) -> DataFrame:
    """The documents whose ``doc_id`` is among ``wanted``, decompressing only their frames.

    Columns as of :func:`scan_token_files`.  The manifest, one row per file, is broadcast.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                asked: dict[tuple, list[int]] = {}
                for r in batch.to_pylist():
                    asked.setdefault((r["path"], r["bytes"], r["base"]), []).append(r["doc_id"])
                for (path, size, base), ids in asked.items():
                    with _opened(path, "r") as source:
                        file = TokenFile(source, size, params)
                        for doc_id in sorted(ids):
                            for k in file.having(doc_id):
                                yield _document_row(file, base, k)

        yield from _emit(rows())

    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    files = F.broadcast(manifest.select("path", "bytes", "base", "first_id", "last_id"))
    places = ids.join(files, F.col("doc_id").between(F.col("first_id"), F.col("last_id")))
    dealt = places.repartition("path").sortWithinPartitions("path", "doc_id")
    return dealt.select("path", "bytes", "base", "doc_id").mapInArrow(read, _READ)


def token_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as they lie in the files."""
    return scanned.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
