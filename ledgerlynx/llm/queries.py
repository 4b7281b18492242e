"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bitsliced,
    fim,
    langid,
    mixing,
    near_text,
    packing,
    quality,
    suffixes,
    token_files,
    tokens,
    urls,
    vector_graph,
    vector_search,
)
from .common import fold, table

URL_RULES = (
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    )
    params = quality.QualityParams()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit_quality(docs.where(~F.col("held_out")), labels, params)
    scored = quality.score_quality(docs, model, params.accept)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_neighbours(
        table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs, text=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.documents().select("doc_id", "size", "source_size", "target", "taken")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    )
    model = langid.fit_languages(docs.where(~F.col("held_out")))
    found = langid.identify_languages(docs.drop("lang"), model, spans=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokens.token_lengths(table(spark, sf_dir, "documents"))
    return tokens.suffix_sums(tokens.length_histogram(lengths))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.output_digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bitsliced.index_documents(table(spark, sf_dir, "documents"))
    return bitsliced.search(index, table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.token_digests(token_files.scan_token_files(manifest))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_nearest": op2_nearest,
    "op3_packing": op3_packing,
    "op4_vector_duplicates": op4_vector_duplicates,
    "op5_url_verdicts": op5_url_verdicts,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_mixing": op7_mixing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_files": op13_token_files,
}
#: SQL for what SQL can express; the trained, hashed and tokenised queries have tests instead.
ORACLES: dict[str, str] = {
    "op4_vector_duplicates": """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([1 FOR x IN embedding IF x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_repeated_bytes": """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT rid, s, md5(array_slice(b, s, s + 399)) AS h
  FROM (SELECT rid, b, unnest(generate_series(1, CAST(octet_length(b) AS BIGINT) - 399)) AS s FROM d)),
t AS (
  SELECT rid, s, s - lag(s) OVER (PARTITION BY rid ORDER BY s) AS step
  FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
i AS (
  SELECT rid, s, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM t),
r AS (SELECT rid, min(s) AS a, max(s) + 399 AS e FROM i GROUP BY rid, run),
g AS (
  SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS low, a AS high FROM r
  UNION ALL
  SELECT d.rid, coalesce(max(e), 0), any_value(octet_length(b)) + 1 FROM d LEFT JOIN r ON r.rid = d.rid GROUP BY d.rid),
k AS (
  SELECT d.rid, string_agg(substr(hex(b), CAST(2 * low + 1 AS BIGINT), CAST(2 * (high - low - 1) AS BIGINT)), '' ORDER BY low) AS kept
  FROM g JOIN d ON d.rid = g.rid GROUP BY d.rid),
c AS (SELECT rid, sum(e - a + 1) AS gone, count(*) AS runs FROM r GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  coalesce(runs, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k ON k.rid = d.rid LEFT JOIN c ON c.rid = d.rid""",
    "op11_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
    CAST('0x' || substr(g, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(g, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
    array_to_string(u[b + 1:n], '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (
  SELECT rid, doc_id, t, count(*) AS tf, any_value(100 - 50 + (50 * size * n) // total) AS m
  FROM (SELECT rid, doc_id, unnest(ts) AS t, len(ts) AS size FROM d), c GROUP BY rid, doc_id, t),
w AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM f, c GROUP BY t),
s AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN w USING (t) GROUP BY item_id, rid, doc_id),
r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
    doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""",
}
