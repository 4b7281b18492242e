"""Text operators against brute force, held-out labels and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlynx.llm import langid, mixing, near_text, packing, quality, suffixes, tokens
from ledgerlynx.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, predicted int, tid string, source_no int, words int, node string"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n ", "en", "a", 4),
    (4, "x", "en", None, 1),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "one two three four five six seven", "en", "b", 10),
    (6, "one two three four five six seven", "en", "b", 10),
    (None, "one two three four five six seven", "en", "b", 10),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, clashing column names."""
    rows = [(*r, 0.5, 7, "t", 1, 2, "n") for r in ODD]
    return spark.createDataFrame(rows, DOCS + EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- quality ------------------------------------------------------------------


def test_quality_separates_held_out_labels(spark):
    from ledgerlynx.llm.queries import op1_quality

    got = op1_quality(spark, SF).where("held_out").join(table(spark, SF, "labels"), "doc_id")
    rows = got.select("predicted", "quality").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_estimates_the_prior():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, 3_000), rng.normal(-2, 1, 3_000)
    unlabelled = np.concatenate([good[:1_800], bad[:1_200]])
    assert abs(quality.class_prior(rng.normal(2, 1, 2_000), unlabelled) - 0.6) < 0.05


def test_quality_risk_never_rewards_a_negative_part():
    rng = np.random.default_rng(1)
    params = quality.QualityParams(steps=200)
    x_p, x_n = rng.normal(1, 1, (300, 5)), rng.normal(-1, 1, (300, 5))
    w, b = quality._descend(x_p, np.vstack([x_p, x_n]), 0.5, params)
    assert ((x_p @ w + b) > 0).mean() > 0.9 and ((x_n @ w + b) < 0).mean() > 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (6, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(odd, labels)
    rows = quality.score_quality(odd, model, 0.7).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1  # a null text counts as empty
    nothing = quality.fit_quality(none, labels)
    assert quality.score_quality(none, nothing, 0.7).count() == 0
    assert quality.score_quality(odd, nothing, 0.7).first()["score"] == 0.5


# -- language -----------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    from ledgerlynx.llm.queries import op9_language_id

    docs = table(spark, SF, "documents").select("doc_id", "lang")
    rows = op9_language_id(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_language_spans_of_mixed_text(spark):
    en, ru = "the house and the garden of the old town " * 5, "дом и сад старого города на реке " * 5
    train = spark.createDataFrame([(en, "en"), (ru, "ru")] * 3, "text string, lang string")
    model = langid.fit_languages(train)
    mixed = spark.createDataFrame([(1, en + ru), (2, "123 !"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in langid.identify_languages(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["lang_spans"]] == ["en", "ru"]
    assert (en + ru)[got[1]["lang_spans"][1]["start"] :].startswith("дом")
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    marks = spark.createDataFrame([(1, "\u0301 \u0300")], "doc_id int, text string")
    assert langid.identify_languages(marks, model).first()["lang_pred"] == "und"


def test_viterbi_equals_plain_search():
    rng = np.random.default_rng(2)
    count = np.array([3, 1, 5])
    first = np.array([0, 3, 4])
    scores = rng.normal(0, 2, (9, 3)).astype(np.float32)
    labels = langid._viterbi(scores, first, count, 1.5)
    for f, n in zip(first, count, strict=True):

        def value(path):
            own = sum(float(scores[f + i, p]) for i, p in enumerate(path))
            return own - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        best = max(value(tuple(p)) for p in np.ndindex(*[3] * n))
        assert abs(value(tuple(labels[f : f + n])) - best) < 1e-4


def test_language_odd_rows(odd, none):
    model = langid.fit_languages(odd)
    got = langid.identify_languages(odd, model).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got} == {"en", "und"}
    nothing = langid.fit_languages(none)
    assert {r["lang_pred"] for r in langid.identify_languages(odd, nothing).collect()} == {"und"}
    assert langid.identify_languages(none, model).count() == 0


def test_language_sample_counts_copies_once(spark):
    """A hot text neither hides its language nor fills the sample."""
    rows = [(f"habari ya mji wa zamani {i}", "sw") for i in range(100)] + [("soko kubwa", "sw")] * 25_000
    rows += [(f"the garden of the old town {i}", "en") for i in range(100)] + [("ile nla", "yo")] * 15
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    params = langid.LangParams(sample=20, buckets=1 << 12)
    model = langid.fit_languages(docs, params)
    assert model.langs == ["en", "sw", "yo"]
    chosen = Counter((r["lang"], r["text"]) for r in langid.training_texts(docs, 20).collect())
    assert set(chosen.values()) == {1}
    sizes = Counter(lang for lang, _ in chosen)
    assert sizes["yo"] == 1 and 5 < sizes["sw"] < 40 and 5 < sizes["en"] < 40


def test_language_of_two_hundred(spark):
    """Labels of many languages stay their own: each language here has syllables no other has."""
    names = [f"l{i:03}" for i in range(200)]
    words = [[chr(0xAC00 + 50 * i + j) * 2 for j in range(8)] for i in range(200)]
    rows = [(i, n, " ".join(w * 3)) for i, (n, w) in enumerate(zip(names, words, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string").coalesce(1)
    model = langid.fit_languages(docs, langid.LangParams(buckets=1 << 14))
    assert model.langs == names
    got = langid.identify_languages(docs, model).collect()
    assert [r["lang_pred"] for r in got] == [r["lang"] for r in got]
    assert all([s["lang"] for s in r["lang_spans"]] == [r["lang"]] for r in got)


# -- tokens and packing -------------------------------------------------------


def test_word_ids_equal_the_library():
    coder = tokens.WordIds(tokens.vocabulary("word_bpe_49k.json"))
    texts = [
        "", "It's don't we'LL 12½ ³", "a\x1cb\x85d\xa0e", "İstanbul ΣΑΣ ſ", "naïve café e\u0301",
        "<|endoftext|> x", "日本 x", "''s 'S !'s 're'", "ß µ", "a" * 3_000, "x\u200by",
    ]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        expected = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text


def test_word_ids_remember_a_bounded_number_of_words():
    whole, few = (tokens.WordIds(tokens.vocabulary("word_bpe_49k.json"), n) for n in (300_000, 20))
    texts = [" ".join(f"often w{chr(97 + i % 26)}{chr(97 + k)}" for k in range(26)) for i in range(60)]
    for a, b in zip(whole.encode(texts), few.encode(texts), strict=True):
        assert a == b and len(few.known) + len(few.known.before) <= 40
    assert "often" in few.known


def test_packing_slices_a_batch_of_texts(spark, monkeypatch):
    docs = table(spark, SF, "documents").limit(200).coalesce(1)
    expected = sorted(map(tuple, packing.token_pieces(docs).collect()))
    monkeypatch.setattr(packing, "_TEXTS", 7)
    coded = packing.token_pieces(docs, packing.PackParams(words=50))
    assert sorted(map(tuple, coded.collect())) == expected


def test_packing_round_trip(spark):
    docs = table(spark, SF, "documents")
    rows = packing.pack_documents(docs).collect()
    coder = tokens.word_ids(tokens.vocabulary("word_bpe_49k.json"))
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    sequences, total = {}, 0
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.frombuffer(next(coder.encode([whole[r["doc_id"]]])) + b"\1\0\0\0", "<u4")
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        total += r["length"]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) * 1.02 + 1
    assert {r["doc_id"] for r in rows} == set(whole)


@pytest.mark.parametrize("kind", ["mixed", "large", "small", "equal", "full"])
def test_plan_places_every_length(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": rng.integers(1, 4097, 4_000),
        "large": rng.integers(1_400, 2_600, 3_000),
        "small": rng.integers(1, 60, 3_000),
        "equal": np.full(1_000, 1_500),
        "full": np.full(50, 4_096),
    }[kind]
    plan = packing.plan_packing(dict(Counter(lengths.tolist())))
    spots, used = {}, Counter()
    for length, entries in plan.entries.items():
        for rank, count, base, each, offset in entries:
            for k in range(count):
                spots.setdefault(base + k // each, []).append((offset + k % each * length, length))
                used[length] += 1
    assert used == Counter(lengths.tolist())
    for places in spots.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    greedy = packing.Plan(4096)
    for length in sorted(used, reverse=True):
        greedy.best_fit(length, used[length])
    assert plan.sequences <= greedy.sequences * 1.02 + 1


def test_non_negative_fit_is_optimal():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.fit_counts(a, b)
    pull = a.T @ (b - a @ x)
    assert (x >= 0).all() and pull.max() < 1e-6 and np.abs(pull[x > 0]).max() < 1e-6


def test_packing_odd_rows(odd, none):
    rows = packing.pack_documents(odd).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] == 6) == [6, 6]
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 30_001
    assert packing.pack_documents(none).count() == 0


def test_token_sums(spark, odd, none):
    lengths = [r["length"] for r in tokens.token_lengths(odd).collect()]
    assert lengths[0] == lengths[1] == 0 and lengths[4] >= 30_000
    values = [0, 0, 3, 3, 3, 600, 1_500]
    frame = spark.createDataFrame([(v,) for v in values], "length long")
    sums = tokens.suffix_sums(tokens.length_histogram(frame))
    for r in sums.collect():
        n = r["length"]
        assert r["docs_at_least"] == sum(v >= n for v in values)
        assert r["tokens_at_least"] == sum(v for v in values if v >= n)
        assert r["truncated_total"] == sum(min(v, n) for v in values)
        assert r["docs_upto"] == sum(v <= n for v in values)
        assert (r["total_docs"], r["total_tokens"]) == (7, sum(values))
    cut = tokens.at_limits(sums, [2, 1_000]).first()
    assert (cut["truncated_2"], cut["cut_1000"]) == (sum(min(v, 2) for v in values), 1)
    assert tokens.quantile_lengths(sums, [0.5]).first()["q0.5"] == 3
    assert tokens.suffix_sums(tokens.length_histogram(tokens.token_lengths(none))).count() == 0


# -- repeated strings ---------------------------------------------------------


def test_suffix_grouping_sorts():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.group_suffixes(text) == sorted(range(len(text)), key=lambda i: text[i:])


def _plain_repeats(rows, length):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((key, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("contexts", [512, 3])
def test_repeats_equal_plain_search(spark, contexts):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["aa", "ab", "é", "abc"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(90):
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randint(0, len(a)), rng.randint(0, len(b))
        rows.append((100 + i, a[x : x + rng.randint(0, 80)] + b[y : y + rng.randint(0, 80)]))
    rows += [(500, None), (501, ""), (502, base[0]), (502, base[0]), (None, base[3])]
    params = suffixes.RepeatParams(length=30, gram=6, parts=4, contexts=contexts)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(docs, params, text=False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _plain_repeats(rows, 30)


def test_repeats_of_a_whole_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = suffixes.remove_repeats(docs, text=False).collect()
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in got), key=repr) == _plain_repeats(rows, 400)


def test_anchors_of_pieces_equal_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 2_000).astype(np.uint8)
    params = suffixes.RepeatParams(length=60, gram=8, parts=4)

    def by_window():
        out = {}
        for spot, first, last, fp in zip(*suffixes.anchors(data, params), strict=True):
            out.update({s: (spot, fp) for s in range(first, last + 1)})
        return out

    whole = by_window()
    assert sorted(whole) == list(range(len(data) - 59))
    assert all(s <= spot <= s + params.places - 1 for s, (spot, _) in whole.items())
    monkeypatch.setattr(suffixes, "_PIECE", 300)
    assert by_window() == whole


def test_repeats_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(odd).collect()}
    assert got[1]["text"] is None and got[1]["n_bytes"] == 0
    assert got[5]["n_removed"] == 150_000 and got[5]["text"] == ""
    assert got[6]["n_removed"] == 0 and got[6]["tid"] == "t"
    assert suffixes.remove_repeats(none).count() == 0


# -- mixing -------------------------------------------------------------------


def test_targets_are_reshared():
    got = mixing.shared_targets([100, 10, 1_000, 0], [5, 2, 1, 5], 1.5, 2.0)
    assert abs(got.sum() - 1.5 * 1_110) < 1e-6
    assert got[0] == 200 and got[1] == 20 and got[3] == 0 and got[2] <= 2_000


def test_split_quotas_keep_every_block():
    quotas = np.array([700, 3, 0, 120])
    out = mixing.split_quotas(quotas, 7, 1)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
    sizes = out.sum(axis=1)
    assert sizes.max() - sizes.min() <= 7
    assert (mixing.split_quotas(quotas, 7, 1) == out).all()


def test_mix_meets_its_targets(spark):
    docs = table(spark, SF, "documents")
    mix = mixing.mix_sources(docs)
    rows = mix.documents().collect()
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_source.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        s[0] += r["taken"]
        s[3] += r["size"]
    for taken, target, size, seen in by_source.values():
        assert abs(taken - target) <= 1 and size == seen and target <= 2 * size + 1e-9
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).documents().collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    draws = mix.draws.collect()
    assert sum(r["words"] for r in draws) == sum(r["taken"] for r in rows)
    assert len({r["shard"] for r in draws}) == 16
    mixed = mixing.mixed_documents(docs)
    words = mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r["taken"] for r in rows)


def test_mix_odd_rows(odd, none):
    rows = mixing.mix_sources(odd).documents().collect()
    assert len(rows) == len(ODD)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_sources(none).documents().count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_rows_equal_but_for_another_column_all_stay(spark):
    rows = [(k // 3, f"text number {k // 3}", "en" if k % 3 else "de", "s", k % 2) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    params = mixing.MixParams(total=1.0, passes=1.0)
    mixed = mixing.mixed_documents(docs, params)
    assert sorted(map(tuple, mixed.collect())) == sorted(rows)
    taken = mixing.mix_sources(docs, params).documents().collect()
    assert all(r["taken"] == r["size"] == 3 for r in taken)


def test_large_mixes_get_more_shards(spark):
    docs = table(spark, SF, "documents")
    params = mixing.MixParams(shard_words=20_000)
    mix = mixing.mix_sources(docs, params)
    assert mix.shards > 16
    by_shard = mix.draws.groupBy("shard").agg(F.sum("words").alias("words")).collect()
    assert len(by_shard) == mix.shards
    assert mixing.mixed_documents(docs, params).rdd.getNumPartitions() == mix.shards


# -- near copies --------------------------------------------------------------


def _edits(a, b):
    """Plain edit distance of two lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def _plain_classes(rows, params):
    """Least id of every class, by plain edit distance of all pairs that agree in a band."""
    coder = near_text.WordCoder()

    def sketch(text):
        return near_text.order_sketch(near_text.labelled(coder.codes(text), params.words), params)

    texts = [(i, t.lower().split(), sketch(t)) for i, t in rows if i is not None and t and t.split()]
    root = {i: i for i, _, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x, p) in enumerate(texts):
        for j, y, q in texts[:n]:
            longer = max(len(x), len(y))
            if find(i) == find(j) or not (p == q).any():
                continue
            if _edits(x, y) <= (1 - params.similarity) * longer + 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def _families(rng):
    words = ["w%d" % i for i in range(300)]
    rows = []
    for f in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_near_copies_equal_all_pairs(spark):
    params = near_text.NearParams()
    rows = _families(random.Random(7))
    rows += [(900, rows[0][1]), (901, None), (902, "  "), (903, "only three words"), (904, "only three words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(docs, params).collect()}
    expected = {**_plain_classes(rows, params), 901: 901, 902: 902}
    assert got == expected


def test_near_copies_in_blocks(spark):
    params = near_text.NearParams(block=3, chunk=2)
    rows = _families(random.Random(8))[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(docs, params).collect()}
    assert got == _plain_classes(rows, params)


@pytest.mark.parametrize("words, changed", [(100, 3), (100, 5), (300, 9)])
def test_scattered_word_changes_link(spark, words, changed):
    rng, rows = random.Random(words + changed), []
    for f in range(60):
        base = ["w%d" % rng.randrange(5_000) for _ in range(words)]
        copy = list(base)
        for at in rng.sample(range(words), changed):
            copy[at] = "x%d" % rng.randrange(5_000)
        rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(docs).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert sum(got[2 * f + 1] == 2 * f for f in range(60)) >= 55


def test_alignment_equals_plain_edit_distance():
    rng = random.Random(11)
    for _ in range(1_500):
        k = rng.choice([2, 3, 8])
        a = [rng.randrange(k) for _ in range(rng.randrange(0, 18))]
        b = [rng.randrange(k) for _ in range(rng.randrange(0, 18))]
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() > 0.1] + [rng.randrange(k)] * rng.randrange(2)
        limit = rng.randrange(0, 12)
        found = near_text.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), limit)
        assert found == (_edits(a, b) <= limit)


def test_order_matters_to_sketch_and_alignment():
    rng = random.Random(9)
    words = ["w%d" % rng.randrange(10_000) for _ in range(200)]
    coder = near_text.WordCoder()
    a, b = coder(" ".join(words)), coder(" ".join(words[100:] + words[:100]))
    assert len(np.intersect1d(a.bag, b.bag)) == 200
    assert not near_text.compare(a, b, 0.8)  # the same words, another order


def test_different_texts_under_one_id_keep_their_links(spark):
    rng = random.Random(12)
    a, b = (["w%d" % rng.randrange(10_000) for _ in range(80)] for _ in range(2))
    near_b = [*b[:40], "other", *b[41:]]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(near_b)), (8, " ".join(a)), (8, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_text.near_duplicates(docs).collect()} == {5}
    kept = near_text.without_near_copies(docs).collect()
    assert sorted(map(tuple, kept)) == sorted([rows[0], rows[1], (8, "alone here")])


def test_one_row_of_each_class_stays(odd, none):
    kept = near_text.without_near_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert near_text.without_near_copies(none).collect() == []


def test_near_odd_rows(odd, none):
    rows = near_text.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] == 6} == {6}
    assert next(r for r in rows if r["doc_id"] is None)["component_id"] is None
    assert near_text.near_duplicates(none).count() == 0
