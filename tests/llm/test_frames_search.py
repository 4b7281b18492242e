"""Compressed frames, fill-in-middle, token files and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerlynx.llm import bitsliced, fim, frames, token_files
from ledgerlynx.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", n long, form string, term string, kind string, ids string, start int, frames int"
ODD = [
    (1, None),
    (2, ""),
    (3, "  \n "),
    (4, "x"),
    (5, "word " * 30_000 + "é" * 70_000 + "tail"),
    (6, "one two three"),
    (6, "one two three"),
    (6, "another text, same id"),
    (None, "no id at all"),
    (7, "spells <M> itself"),
    (8, "naïve café “quotes” \U0001f600 中文   end<|endoftext|>"),
    (9, "a" * 200_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing names."""
    rows = [(i, t, None, None, None, 1, "f", "t", "k", "i", 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def as_sorted(rows):
    return sorted(map(tuple, rows), key=repr)


# -- frames -------------------------------------------------------------------


def test_seekable_file_is_a_plain_zstandard_file(tmp_path):
    parts = [bytes([k]) * (1000 + k) for k in range(5)]
    path = tmp_path / "x.zst"
    with open(path, "wb") as sink:
        out = frames.SeekableWriter(sink)
        for part in parts:
            out.frame(part)
        out.aside(b"beside the stream")
        assert out.close() == 5
    assert out.size == path.stat().st_size
    with open(path, "rb") as source:
        stream = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
        assert stream.read() == b"".join(parts)
    with open(path, "rb") as source:
        reader = frames.SeekableReader(source, out.size)
        assert [reader.content(e) for e in reader.frames] == parts
        assert [reader.content(e) for e in reader.asides] == [b"beside the stream"]
        assert [e.start for e in reader.frames] == np.cumsum([0, *map(len, parts[:-1])]).tolist()


def test_a_damaged_frame_is_noticed(tmp_path):
    path = tmp_path / "x.zst"
    with open(path, "wb") as sink:
        out = frames.SeekableWriter(sink)
        out.frame(random.Random(1).randbytes(500))
        out.close()
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as source:
        reader = frames.SeekableReader(source, out.size)
        with pytest.raises((ValueError, zstandard.ZstdError)):
            reader.content(reader.frames[0])


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_streams_of_frames_equal_slices(size):
    data = bytes(range(50))
    text = frames.framed([data[:20], b"", data[20:]], size)
    for a in range(0, 51, 7):
        for b in range(a, 51, 5):
            assert b"".join(text.stream(a, b)) == data[a:b]


# -- fill in the middle -------------------------------------------------------


def plain_fim(doc_id, text):
    """The rule itself, on whole texts."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def expected_digests(docs):
    out = []
    for doc_id, text in plain_rows(docs):
        *head, made = plain_fim(doc_id, text)
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (made, text)]
        out.append((doc_id, *head, *sums))
    return as_sorted(out)


@pytest.mark.parametrize("size", [1 << 16, 999])
def test_transformed_texts_equal_the_rule(spark, odd, size):
    docs = odd.unionByName(table(spark, SF, "documents"), allowMissingColumns=True)
    made = fim.fill_in_middle(docs, fim.FimParams(frame_bytes=size))
    assert as_sorted(fim.output_digests(made).collect()) == expected_digests(docs)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_cuts_inside_units_and_characters_of_tiny_frames(spark, size):
    rng = random.Random(size)
    texts = ["".join(rng.choices("abC é中\U0001f600 <>PSM1", k=rng.randint(0, 40))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fim.fill_in_middle(docs, fim.FimParams(frame_bytes=size))
    assert as_sorted(fim.output_digests(made).collect()) == expected_digests(docs)
    whole = {r["doc_id"]: r["text"] for r in fim.output_texts(made).collect()}
    assert whole == {i: plain_fim(i, t)[-1] for i, t in enumerate(texts)}


def test_marks_across_frames_are_found():
    assert fim._mark_places([b"a<", b"P", b">b<S", b"><M", b">"], [b"<P>", b"<S>", b"<M>"]) == [1, 5, 8]
    assert fim._mark_places([b"<P><S><M>"], [b"<P>", b"<S>", b"<M>"]) == [0, 3, 6]


def test_fill_in_middle_of_nothing(none):
    assert fim.output_digests(fim.fill_in_middle(none)).collect() == []


# -- token files --------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    return token_files.ByteIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(spark, coder):
    rng = random.Random(7)
    signs = "aZé中́՘֋​  \x1c\x85 \t\n'stl0٣½\U0001f600-_　"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3_000)]
    texts += [t for _, t in plain_rows(table(spark, SF, "documents"))]
    texts += [t or "" for _, t in ODD]
    assert [t for t in texts if coder.encode(t) != coder.library(t)] == []


def expected_ids(docs, coder):
    out, start = [], 0
    for doc_id, text in sorted(plain_rows(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = coder.library(text) + bytes(4)
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


@pytest.mark.parametrize("params", [(1 << 16, 64), (1000, 5)])
def test_files_hold_every_document_in_order(spark, coder, params):
    docs = table(spark, SF, "documents").repartition(4)
    p = token_files.TokenFileParams(frame_ids=params[0], scan_frames=params[1])
    manifest = token_files.write_token_files(docs, p).cache()
    want = expected_ids(docs, coder)
    got = token_files.token_digests(token_files.scan_token_files(manifest, p)).collect()
    assert as_sorted(got) == as_sorted(want)
    asked = docs.where("doc_id % 13 = 0").unionByName(docs.where("doc_id = 26"))
    some = token_files.read_documents(manifest, asked, p)
    assert as_sorted(token_files.token_digests(some).collect()) == as_sorted(
        [w for w in want if w[0] % 13 == 0]
    )


def test_token_files_of_odd_rows(odd, coder):
    p = token_files.TokenFileParams(frame_ids=100)
    manifest = token_files.write_token_files(odd, p)
    got = token_files.token_digests(token_files.scan_token_files(manifest, p)).collect()
    want = expected_ids(odd, coder)
    # Rows of one id come in any order among themselves; all else has its place.
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((w[0], w[2], w[3]) for w in want)
    assert {r[1] for r in got if r[0] != 6 and r[0]} == {w[1] for w in want if w[0] != 6 and w[0]}
    end = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == end
        end += row["n_tokens"]
    three = token_files.read_documents(manifest, odd.where("doc_id = 6"), p)
    assert three.count() == 3


def test_many_equal_rows_are_dealt_to_several_files(spark):
    docs = spark.range(20_000).selectExpr("cast(1 as long) as doc_id", "'same words' as text")
    docs = docs.repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs)
        assert manifest.count() > 4
        assert manifest.agg(F.max("n_docs")).first()[0] < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_token_files_of_nothing(none):
    manifest = token_files.write_token_files(none)
    assert manifest.count() == 0
    assert token_files.scan_token_files(manifest).count() == 0


# -- ranked search ------------------------------------------------------------


def plain_search(docs, items, top=50):
    def terms(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    held = [(d, Counter(terms(t))) for d, t in plain_rows(docs)]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for r in items.collect():
        asked.setdefault(r["item_id"], set()).update(terms(r["text"]))
    out = []
    for item, wanted in asked.items():
        scores = []
        for d, c in held:
            m, s = 50 + (50 * c.total() * n) // total, 0
            for t in wanted & c.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                s += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for rank, (s, unknown, d) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if unknown else d, -s))
    return as_sorted(out)


@pytest.mark.parametrize("params", [{}, {"rows": 8, "bits": 2, "hashes": 1, "items": 7, "top": 5}])
def test_ranks_equal_all_pairs(spark, params):
    docs = table(spark, SF, "documents").repartition(5)
    items = table(spark, SF, "benchmark")
    p = bitsliced.SliceParams(**params)
    got = bitsliced.search(bitsliced.index_documents(docs, p), items, p).collect()
    assert as_sorted(got) == plain_search(docs, items, p.top)


def test_search_of_odd_rows(spark, odd):
    rows = [
        (1, "one TWO three", "x", 5),
        (1, "café word", "x", 5),  # shares an id
        (2, None, "x", 5),
        (3, "  ,.", "x", 5),
        (None, "another 中文", "x", 5),
        (4, "nowhere", "x", 5),
    ]
    items = spark.createDataFrame(rows, "item_id long, text string, term string, df int")
    got = bitsliced.search(bitsliced.index_documents(odd), items).collect()
    assert as_sorted(got) == plain_search(odd, items)


def test_ties_at_the_last_place_go_to_lesser_ids(spark):
    docs = spark.createDataFrame(
        [(i, f"same words {'x' if i % 3 else 'other'}") for i in range(400)], "doc_id long, text string"
    ).repartition(6)
    items = spark.createDataFrame([(1, "words other"), (2, "x same")], "item_id long, text string")
    got = bitsliced.search(bitsliced.index_documents(docs), items).collect()
    assert as_sorted(got) == plain_search(docs, items)


def test_bounds_exclude_most_documents(spark):
    """Rare terms: only documents that hold them, and few others, are scored."""
    rng = np.random.default_rng(3)
    words = rng.zipf(1.3, size=(3_000, 80)) % 5_000
    texts = [(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(words)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    items = spark.createDataFrame([(0, texts[5][1]), (1, texts[77][1])], "item_id long, text string")
    index = bitsliced.index_documents(docs)
    blocks = index.where("kind = 'block'").drop("kind", "term", "df")
    n, total = 3_000, 240_000
    df = {r["term"]: r["df"] for r in index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    rows = [{"item_id": i, "term": t, "df": df[t]} for i in (0, 1) for t in set(texts[(5, 77)[i]][1].split())]
    asked = bitsliced._asked(rows, n, total)
    p = bitsliced.SliceParams(top=10)
    least = bitsliced._thresholds(blocks, asked, p)
    codes = bitsliced._codes(asked)
    reached = sum(
        int((bitsliced._bounds(r.asDict(), asked, codes, p) >= least[:, None]).sum()) for r in blocks.collect()
    )
    assert 20 <= reached < 3_000


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bitsliced.search(bitsliced.index_documents(none), items).collect() == []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert bitsliced.search(bitsliced.index_documents(docs), items.where("false")).collect() == []
