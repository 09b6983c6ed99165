"""The queries of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, gram_join, image_match, licenses, quotes, surrogates, token_counts, toxicity, warc
from .columns import table


def op1_warc_dictionary_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_frames(table(spark, sf_dir, "pages"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_conversations(table(spark, sf_dir, "conversations"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs).drop("text").withColumnRenamed("surrogate_text", "text")


def op6_image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_match.linked_images(image_match.drawn(table(spark, sf_dir, "embeddings")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_join.similar_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs.select("doc_id", "text"), model).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_prefix_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Overlapping runs of 13 words (of all words of shorter items) that a document shares with an item, with the places of their words in the document.
OP3_SQL = r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
runs AS MATERIALIZED (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS run
    FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) >= 5)
),
docs AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS gaps FROM documents WHERE text <> ''),
sizes AS (SELECT DISTINCT size FROM runs),
places AS MATERIALIZED (
    SELECT doc_id, size, unnest([lower(array_to_string(w[i:i + size - 1], ' ')) for i in range(1, len(w) - size + 2)]) AS run, unnest(range(1, len(w) - size + 2)) AS i
    FROM docs, sizes WHERE len(w) >= size
),
hits AS MATERIALIZED (SELECT doc_id, item_id, i AS a, i + size - 1 AS b FROM places JOIN runs USING (size, run)),
fresh AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id, item_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM hits),
islands AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, item_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM fresh),
spans AS MATERIALIZED (SELECT doc_id, item_id, min(a) AS a, max(b) AS b FROM islands GROUP BY doc_id, item_id, island),
pieces AS (SELECT doc_id, unnest(w) AS word, unnest(gaps[1:len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE doc_id IN (SELECT doc_id FROM spans)),
words AS MATERIALIZED (SELECT doc_id, i, word, sum(len(gap) + len(word)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM pieces)
SELECT s.doc_id, s.item_id, CAST(f.stop - len(f.word) AS BIGINT) AS start_char, CAST(l.stop AS BIGINT) AS end_char, CAST(s.b - s.a + 1 AS BIGINT) AS words
FROM spans s JOIN words f ON f.doc_id = s.doc_id AND f.i = s.a JOIN words l ON l.doc_id = s.doc_id AND l.i = s.b
"""

#: Sets of 5-word runs (of all words of shorter texts), every pair of documents that shares one, and the groups that similar pairs link.
OP7_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE shared.n / (sa.n + sb.n - shared.n) >= 0.4 - 1e-12),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
groups AS (SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a)
SELECT doc_id, class_id, count(*) AS n_links FROM groups JOIN links ON links.a = doc_id GROUP BY doc_id, class_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op7_ngram_jaccard_join": OP7_SQL}
