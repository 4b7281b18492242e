"""Language identification with spans of mixed text.

Script ranges narrow the candidate languages of a word; hashed character n-grams score
the word for each of them; Viterbi with a penalty for every switch labels the words of a
text, and runs of one label are its language spans.  A document's language is the one
that labels most of its letters.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; a word
of a script that no learned language uses scores alike for all of them; without any
training text every document is ``und``; ties go to the language first in code-point order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First and last code point of each script's main blocks.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)),
}
_OTHER = 1 + len(SCRIPTS)
_MARK = _OTHER + 1  # combining marks belong to a word but are no letters
_KINDS = _MARK + 1
_CHARS = 1 << 19  # characters a worker scores at a time, whole texts only
_CELLS = 1 << 24  # characters x languages, which bound its memory with many languages


@dataclass(frozen=True)
class LangParams:
    """About ``sample`` different training texts of each language are used, each once."""

    sample: int = 2_000
    buckets: int = 1 << 17
    switch: float = 12.0
    smooth: float = 0.5
    script_share: float = 0.002
    clip: float = 6.0


@cache
def _script_of() -> np.ndarray:
    """0 for what is no letter or mark, else the number of the script, or that of marks."""
    kinds = np.zeros(0x110000, dtype=np.int8)
    for c in range(0x32400):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            kinds[c] = _OTHER if kind == "L" else _MARK
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            part = kinds[low : high + 1]
            part[part == _OTHER] = i
    return kinds


def _letters(texts: list[str]):
    """Code points with 0 between words, document of each, and script of each."""
    parts, lengths = [], []
    for t in texts:
        low = t.lower().encode("utf-32-le", "surrogatepass")
        parts.append(low + b"\0\0\0\0")
        lengths.append(len(low) // 4 + 1)
    codes = np.frombuffer(b"".join(parts), dtype=np.uint32)
    script = _script_of()[np.minimum(codes, 0x10FFFF)]
    return np.where(script > 0, codes, 0), np.repeat(np.arange(len(texts)), lengths), script


def _hashes(codes: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the 1- to 4-grams that end at each position; they stay within a word.

    The zero before and after a word belongs to its grams.
    """
    c = codes.astype(np.uint64)
    gram, inside = c.copy(), np.ones(len(c), dtype=bool)
    for n in range(1, 5):
        if n > 1:
            back = np.zeros_like(c)
            back[n - 1 :] = c[: len(c) - n + 1]
            gram = np.where(inside, gram * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(n), gram)
            inside = inside & (back > 0)
        else:
            inside = np.ones(len(c), dtype=bool)
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last position of each word."""
    on = np.concatenate(([0], (codes > 0).astype(np.int8), [0]))
    turn = np.diff(on)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


@dataclass(frozen=True)
class LangModel:
    """Log-likelihood of each n-gram bucket and the allowed scripts, by language."""

    langs: list[str]
    table: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages
    params: LangParams


def _chunks(texts: list[str], langs: int = 1) -> Iterator[tuple[int, int]]:
    most = min(_CHARS, _CELLS // langs)
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def training_texts(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text): about ``sample`` different texts of every language, all where it has fewer.

    Copies count once, both for the size of a language and in its sample.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    # One row for each language; only hashes of its texts are shuffled.
    sizes = rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("_all"))
    picked = F.pmod(F.xxhash64("text"), F.col("_all")) < sample
    return rows.join(F.broadcast(sizes), "lang").where(picked).select("lang", "text").distinct()


def fit_languages(docs: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """Count the n-grams of about ``params.sample`` whole texts of every language.

    Reads ``text`` and ``lang``; rows without either are left out.
    """
    buckets = params.buckets
    chosen = training_texts(docs, params.sample).repartition(16, F.xxhash64("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, group in b.groupby("lang"):
                total = sums.setdefault(lang, np.zeros(buckets + _KINDS))
                texts = group["text"].tolist()
                for low, high in _chunks(texts):
                    codes, _, script = _letters(texts[low:high])
                    near = codes > 0
                    near[1:] |= codes[:-1] > 0
                    for h in _hashes(codes, buckets):
                        total[:buckets] += np.bincount(h[near], minlength=buckets)
                    total[buckets:] += np.bincount(script, minlength=_KINDS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at].astype(np.int64)})

    # A bounded sample, so at most languages x (buckets + scripts) sums come back.
    sums = (
        chosen.mapInPandas(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(sums["lang"].unique())
    table = np.zeros((buckets, len(langs)))
    scripts = np.zeros((_KINDS, len(langs)))
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        is_gram = (own["bucket"] < buckets).to_numpy()
        table[own["bucket"][is_gram], i] = own["n"][is_gram]
        scripts[own["bucket"][~is_gram] - buckets, i] = own["n"][~is_gram]
    if langs:
        p = (table + params.smooth) / (table.sum(axis=0) + params.smooth * buckets)
        logs = np.log(p)
        logs -= logs.mean(axis=1, keepdims=True)
        table = np.clip(logs, -params.clip, params.clip)
        scripts[0] = scripts[_MARK] = 0
        shares = scripts / np.maximum(1, scripts.sum(axis=0))
        allowed = shares >= params.script_share
    else:
        allowed = np.zeros((_KINDS, 0), dtype=bool)
    return LangModel(langs, table.astype(np.float32), allowed, params)


def _viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; all texts advance together, one word at a time."""
    kind = np.min_scalar_type(scores.shape[1])
    labels = np.zeros(len(scores), dtype=kind)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    live = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), side="right")
    back = np.empty((len(scores), scores.shape[1]), dtype=kind)
    best = np.zeros((len(count), scores.shape[1]), dtype=np.float64)
    own = np.arange(scores.shape[1], dtype=kind)
    for t, n in enumerate(live):
        at, prev = first[:n] + t, best[:n]
        top = prev.argmax(axis=1)
        jump = prev[np.arange(n), top] - penalty
        stay = prev >= jump[:, None] if t else np.ones_like(prev, dtype=bool)
        back[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, prev, jump[:, None]) + scores[at]
    now = best.argmax(axis=1).astype(kind)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        labels[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return labels


def _label(texts: list[str], model: LangModel):
    """Word positions, documents and labels of a chunk of texts, and which texts have letters."""
    codes, owner, script = _letters(texts)
    start, end = _words(codes)
    k = len(model.langs)
    scores = np.zeros((len(start), k), dtype=np.float32)
    if len(start):
        # A word's sum covers the zero after it, where its closing grams end.
        spots = np.column_stack([start, np.minimum(end + 1, len(codes))]).ravel()
        spots = np.minimum(spots, len(codes) - 1)
        for h in _hashes(codes, model.params.buckets):
            at = model.table[h]
            scores += np.add.reduceat(at, spots, axis=0)[::2]
        allowed = model.allowed[script[start]]
        none = ~allowed.any(axis=1)
        scores[none] = 0
        scores = np.where(allowed | none[:, None], scores, scores.min(axis=1, initial=0)[:, None] - 30)
    doc = owner[start]
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    has = np.flatnonzero(count)
    labels = _viterbi(scores, first[has], count[has], model.params.switch) if len(has) else np.zeros(0, np.int8)
    lettered = np.bincount(owner, weights=(script > 0) & (script != _MARK), minlength=len(texts))
    return start, end, doc, labels, lettered > 0


def identify_languages(docs: DataFrame, model: LangModel, spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its share of letters) and ``lang_spans``.

    A span is (lang, start, end) in characters of the lower-cased text, over whole words.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<lang:string,start:int,end:int>>"
    kind = f"struct<lang_pred:string,score:double{',lang_spans:' + span if spans else ''}>"

    @F.pandas_udf(kind)
    def languages(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        names, k = np.array([*m.langs, "und"], dtype=object), len(m.langs)
        texts = [t or "" for t in texts]
        pred, score = np.full(len(texts), k), np.zeros(len(texts))
        runs: list[list[dict]] = [[] for _ in texts]
        for low, high in _chunks(texts, k) if k else ():
            start, end, doc, labels, lettered = _label(texts[low:high], m)
            sums = np.bincount(doc * k + labels, weights=end - start, minlength=(high - low) * k)
            sums = sums.reshape(-1, k)
            total = sums.sum(axis=1)
            some = (total > 0) & lettered
            pred[low:high] = np.where(some, sums.argmax(axis=1), k)
            score[low:high] = np.where(some, sums.max(axis=1) / np.maximum(total, 1), 0.0)
            if spans and len(doc):
                turn = np.flatnonzero((np.diff(doc) != 0) | (np.diff(labels) != 0)) + 1
                a = np.concatenate(([0], turn))
                b = np.concatenate((turn, [len(doc)])) - 1
                base = np.concatenate(([0], np.cumsum([len(t.lower()) + 1 for t in texts[low:high]])))
                for i, j in zip(a, b, strict=True):
                    off = base[doc[i]]
                    runs[low + doc[i]].append(
                        {"lang": names[labels[i]], "start": int(start[i] - off), "end": int(end[j] - off)}
                    )
        out = pd.DataFrame({"lang_pred": names[pred], "score": score})
        if spans:
            out["lang_spans"] = runs
        return out

    return docs.select(*kept, languages("text").alias("_lang")).select(*kept, "_lang.*")
