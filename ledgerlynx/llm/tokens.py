"""Token ids of whole texts by public vocabulary files, and exact length histograms.

Lengths are aggregated once per encoded length; suffix sums over that histogram answer
totals, quantiles and truncated totals for every context limit.

Defined cases: a null text counts as empty, an empty text has length 0; repeated rows
count as often as they occur; an empty table gives an empty histogram.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import share_of

_CACHED = 300_000  # words of each of the two generations a worker remembers
_WORD_CHARS = 64

# The vocabulary's own split of lower-cased text into words, spelled out for
# code points below U+0250, where letters and digits are these.
_PLAIN = re.compile(
    "'(?:s|t|re|ve|m|ll|d)|[a-zA-Zªµº\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+"
    "|[0-9²³¹¼½¾]|[^ \t\n\x0B\x0C\r\x85\xA0a-zA-Zªµº\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F0-9²³¹¼½¾]+"
)
_BEYOND = re.compile("[\u0250-\U0010FFFF]")


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(name: str) -> str:
    """Path of one of the public vocabulary files on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Word to its ids as bytes; a word not met lately is asked of the vocabulary.

    Holds at most ``size`` words, and as many of the generation before, of which those met
    again move on; so frequent words stay and rare ones take bounded memory.
    """

    def __init__(self, model, size: int = _CACHED):
        super().__init__()
        self.tokenize, self.letters, self.size = model.tokenize, _byte_letters(), size
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            spelled = word.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelled)])
        if len(word) <= _WORD_CHARS:
            if len(self) >= self.size:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes, remembering single words.

    Words of a lower-cased text are encoded one by one, as the vocabulary itself does.
    A text with code points from U+0250 on, or one that spells a special token, goes to
    the library whole.
    """

    def __init__(self, path: str, words: int = _CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.tokenizer.model, words)

    def library(self, text: str) -> bytes:
        text = text.encode("utf-8", "replace").decode()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if not text.isascii():
                if _BEYOND.search(text):
                    yield self.library(text)
                    continue
                text = unicodedata.normalize("NFC", text)
            if any(s in text for s in self.special):
                yield self.library(text)
                continue
            low = text.lower()
            if not low.isascii() and _BEYOND.search(low):
                yield self.library(text)
                continue
            yield b"".join(map(self.known.__getitem__, _PLAIN.findall(low)))


@cache
def word_ids(path: str, words: int = _CACHED) -> WordIds:
    """One encoder per worker process; it remembers at most twice ``words`` words."""
    return WordIds(path, words)


@cache
def rank_lengths(path: str, pattern: str) -> Callable[[str], int]:
    """Length of a whole text under a byte-level vocabulary of ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def token_lengths(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per document: ``length``, the tokens of its whole text; reads ``text`` only."""

    @F.pandas_udf("long")
    def encoded_length(texts: pd.Series) -> pd.Series:
        import public_tokenizers

        of = rank_lengths(public_tokenizers.path(name), public_tokenizers.PATTERN)
        clean = (t.encode("utf-8", "replace").decode() if t else "" for t in texts)
        return pd.Series([of(t) if t else 0 for t in clean], dtype="int64")

    return docs.select(encoded_length("text").alias("length"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs): one row per encoded length, combined before the shuffle."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 512) -> DataFrame:
    """For every length L of the histogram as a context limit, what all documents hold.

    ``docs_at_least``, ``tokens_at_least``: documents of L tokens or more; ``truncated_total``:
    tokens left if each document is cut at L; ``docs_upto``: documents that fit whole, the
    rank by which ``length`` is a quantile; ``total_docs``, ``total_tokens``.
    Lengths are summed by blocks, so no window holds more than one block of lengths, or
    one row for each block.
    """
    held = share_of(histogram.withColumn("_block", F.floor(F.col("length") / block)), "lengths")
    tokens = F.col("length") * F.col("n_docs")
    blocks = held.groupBy("_block").agg(
        F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens")
    )
    after = Window.partitionBy(F.lit(0)).orderBy(F.col("_block").desc())
    later = after.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(whole).alias("total_docs"),
        F.sum("_tokens").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("_block").orderBy(F.col("length").desc())
    rows = held.join(blocks, "_block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum(tokens).over(within) + F.col("_tokens_after")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    cut = F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    return rows.withColumns(
        {
            "truncated_total": cut,
            "docs_upto": F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"),
        }
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """One row: for each context limit, the truncated total and the documents cut."""
    n, long = F.col("n_docs"), F.col("length")
    return sums.agg(
        *[F.sum(F.least(long, F.lit(x)) * n).alias(f"truncated_{x}") for x in limits],
        *[F.sum(F.when(long > x, n).otherwise(0)).alias(f"cut_{x}") for x in limits],
    )


def quantile_lengths(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Exact length quantiles: the least length that so large a share of documents fits."""
    wanted = [
        F.min(F.when(F.col("docs_upto") >= F.ceil(F.col("total_docs") * s), F.col("length")))
        for s in shares
    ]
    return sums.agg(*[w.alias(f"q{s:g}") for w, s in zip(wanted, shares, strict=True)])
