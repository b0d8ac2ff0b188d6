"""The registered queries of the operators, and the SQL that checks those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import common as C
from tallyweave.llm.decontaminate import find_benchmark_text
from tallyweave.llm.filter_audit import audit_filters, text_failures
from tallyweave.llm.html_extraction import extract_main_text
from tallyweave.llm.knn_join import top_inner_products
from tallyweave.llm.language_id import identify_languages
from tallyweave.llm.lm_scoring import score_documents
from tallyweave.llm.packing import pack_documents
from tallyweave.llm.resampling import resample
from tallyweave.llm.simhash import near_duplicate_groups
from tallyweave.llm.substring_dedup import remove_repeated_windows
from tallyweave.llm.suffix_dedup import remove_repeated_strings
from tallyweave.llm.token_counts import count_tokens
from tallyweave.llm.toxicity import score_toxicity

TOKEN_LIMIT, TOXIC = 512, 0.3


def op1_interpolated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(C.table(spark, sf_dir, "documents"), C.fold("doc_id", 7) != 2)
    return scored.select("doc_id", (C.fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op3_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(C.table(spark, sf_dir, "documents"), window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents"), "word_bpe_49k.json", max_tokens=2048, end_id=1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = C.fold("doc_id", 4) == 2
    return identify_languages(C.table(spark, sf_dir, "documents"), ~held_out, "doc_id", held_out.alias("held_out"))


def op6_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"), "byte_bpe_50k.json").withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeated_strings(C.table(spark, sf_dir, "documents"), window=100)
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(C.table(spark, sf_dir, "documents"), width=4, distance=4).select("doc_id", "fingerprint", "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark_text(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = C.fold("doc_id", 4) == 2
    scored = score_toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), ~held_out, "doc_id", held_out.alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    return audit_filters(docs, labels, text_failures(F.col("text")), F.col("lang"), copies="E")


def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(C.table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")
    return resample(docs, target, percent=10, max_words=1, buckets=10_000, least_words=20, seed=2024)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_interpolated_scores, op2_voronoi_knn, op3_substring_doubling, op4_binary_packing, op5_language_id, op6_bpe_counts, op7_suffix_array_dedup,
        op8_simhash_groups, op9_decontaminate, op10_toxicity, op11_filter_audit,
        op12_html_main_text, op13_importance_resampling, pipeline,
    )
}

_KNN = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.c, d.c)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_WINDOWS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM starts),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM ranked, (SELECT unnest(range(0, 20)) AS j) WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY words.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCHMARK = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS a FROM i WHERE len(w) > 0),
pattern AS (SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS k FROM f),
lengths AS (SELECT DISTINCT n FROM pattern),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, lengths WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, a, s.n FROM (SELECT doc_id, n, a, array_to_string(w[a:a + n - 1], ' ') AS k FROM starts) s JOIN pattern p ON s.n = p.n AND s.k = p.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
judged AS (
  SELECT part, o, step, o[step] AS i, good, toxic, fails[o[step]] AS now, list_bool_or(list_transform(o[1:step - 1], lambda j: fails[j])) IS TRUE AS before,
    list_sum(list_transform(fails, lambda x: x::INT)) = 1 AS alone
  FROM f, steps),
counted AS (
  SELECT part, o, step, i, count(*) FILTER (NOT now AND NOT before)::BIGINT AS kept, count(*) FILTER (now AND NOT before)::BIGINT AS removed,
    count(*) FILTER (now AND before)::BIGINT AS redundant, count(*) FILTER (now AND alone)::BIGINT AS unique_fails,
    count(*) FILTER (now AND NOT before AND good = 1)::BIGINT AS good_lost, count(*) FILTER (now AND NOT before AND toxic = 1)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley
FROM counted
"""

# The bits of crc32 by its rule: eight shifts for each byte, over the bytes of each distinct word.
_RESAMPLING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM b)),
crc AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x:
    list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 10000 AS k FROM words),
s AS (SELECT k, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN crc USING (w) GROUP BY k),
totals AS (SELECT (SELECT count(*) FROM dw) AS source, (SELECT count(*) FROM b) AS target),
gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (source + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (target + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (k), totals),
weights AS (SELECT doc_id, sum(g) AS weight FROM dw JOIN crc USING (w) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""

# The article element of a page, where there is one and markup in it is paragraphs, headings, breaks and bold; that is what the tables hold.
_ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t FROM c)
SELECT page_id, url, t AS text, length(t)::BIGINT AS n_chars FROM d
"""

ORACLES = {"op12_html_main_text": _ARTICLES, "op13_importance_resampling": _RESAMPLING, "op11_filter_audit": _AUDIT, "op2_voronoi_knn": _KNN, "op3_substring_doubling": _WINDOWS, "op9_decontaminate": _BENCHMARK}
