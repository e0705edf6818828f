"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import langid, pii, quality, toxicity
from corpusloom.llm.common import learn_rows, table
from corpusloom.llm.decontam import decontaminate
from corpusloom.llm.exact_dedup import content_sort_dedup
from corpusloom.llm.ngram_join import ngram_join
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.suffix_dedup import suffix_dedup
from corpusloom.llm.url_filter import judge_urls

#: The tokenizer file of the packing query.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn_rows("doc_id", 3, 1))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", learn_rows("doc_id", 3, 1, want_held=True).alias("held_out"), "score", "predicted")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn_rows("doc_id", 5, 0))
    return langid.identify(docs, model).select("doc_id", learn_rows("doc_id", 5, 0, want_held=True).alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lex = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"), learn_rows("doc_id", 4, 2))
    out = toxicity.score_toxicity(docs, lex)
    return out.select("doc_id", learn_rows("doc_id", 4, 2, want_held=True).alias("held_out"), "score", "predicted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_url_filter, op2_best_fit_packing, op3_decontamination, op4_quality, op5_ngram_jaccard_join, op6_language_id, op7_pii, op8_exact_dedup, op9_toxicity, op10_suffix_dedup)
    return {f.__name__: f for f in named}


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.*, (SELECT max_by(h || q, length(h || q)) FROM r WHERE ends_with('.' || p.host, '.' || h) AND starts_with(p.path, q)) AS rule
  FROM p),
g AS (
  SELECT m.*, CASE WHEN host LIKE '%casino%' AND path LIKE '/%' THEN '*casino*/**' WHEN host LIKE '%-pills.%' AND path LIKE '/%' THEN '*-pills.*/**'
              WHEN '.' || host LIKE '%.adult-%' AND path LIKE '/%' THEN '*.adult-*/**' END AS hit
  FROM m)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT v FROM r WHERE h || q = g.rule) WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS glob
FROM g
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, greatest(2, len(w) - n + 2))) t(i) WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
w AS (
  SELECT *, row_number() OVER o AS rn, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW o AS (PARTITION BY norm ORDER BY pts DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op3_decontamination": OP3_SQL, "op8_exact_dedup": OP8_SQL}
