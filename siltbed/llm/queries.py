"""The operators as named queries over their whole tables, with SQL where it can state the result."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from siltbed.llm import (containment, exact_topk, html_text, language_id, ngram_jaccard, piece_sampling, private_data, quality_rules,
                         suffix_dedup, warc)
from siltbed.llm.common import table


def op1_warc(spark, d):
    got = warc.read_archives(warc.write_archives(table(spark, d, "pages")))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_classifier(spark, d):
    return quality_rules.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_pii(spark, d):
    return private_data.find_spans(table(spark, d, "documents")).drop("k2")


def op4_sentencepiece(spark, d):
    return piece_sampling.encode(table(spark, d, "documents"))


def op5_decontamination(spark, d):
    return containment.contained_items(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("k2")


def op6_language_id(spark, d):
    return language_id.identify(language_id.document_rows(table(spark, d, "documents"))).drop("k2")


def language_of_pages(spark, d):
    """The same operator on pages, with markup, address suffix and host; the labels are those of the documents."""
    pages = language_id.page_rows(table(spark, d, "pages"))
    found = language_id.identify(pages, language_id.document_labels(table(spark, d, "documents")))
    return found.drop("k2").withColumnRenamed("doc_id", "page_id")


def op7_html_extraction(spark, d):
    return html_text.extract_text(table(spark, d, "pages"))


def op8_exact_topk(spark, d):
    return exact_topk.search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_suffix_dedup(spark, d):
    return suffix_dedup.repeated_spans(table(spark, d, "documents")).drop("spans")


def op10_ngram_jaccard(spark, d):
    return ngram_jaccard.similar_groups(table(spark, d, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_quality_classifier, op3_pii, op4_sentencepiece, op5_decontamination, op6_language_id, language_of_pages, op7_html_extraction,
    op8_exact_topk, op9_suffix_dedup, op10_ngram_jaccard)}
QUERIES["pipeline"] = corpus_pipeline.run

WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 (1 + ((('0x' || substr(sha1(payload), 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31))::INT, 1)), '')"""
PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES = {
    "op1_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), t AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
 SELECT page_id, strlen(payload) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to FROM t""",
    "op9_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 199)) AS p FROM d WHERE strlen(h) >= 400)),
 hit AS (SELECT doc_id, p FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
 cut AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true) AS fresh FROM hit),
 numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cut),
 runs AS (SELECT doc_id, min(p) AS s, max(p) + 200 AS e FROM numbered GROUP BY doc_id, run),
 ends AS (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, strlen(h) // 2, NULL FROM d),
 parts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS b FROM ends)
 SELECT doc_id, any_value(strlen(h) // 2) AS n_bytes, coalesce(sum(e - s), 0)::BIGINT AS n_removed, count(e) AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s, e))) AS kept_sha256 FROM parts JOIN d USING (doc_id) GROUP BY doc_id""",
    "op10_ngram_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM low LEFT JOIN n USING (doc_id)""",
    "op5_decontamination": f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
 bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs))),
 n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
 SELECT doc_id, item_id, count(*) AS shared, n_item FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""",
    "op8_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
 SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
