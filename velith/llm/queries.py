"""Thin queries over the training-data operators, one per operator, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.llm import decontamination, embedding_dedup, language_id, line_dedup, near_dedup, quality, secrets_scan, sentencepiece_codec, token_output, warc
from velith.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_scan.scan(docs, secrets_scan.train(docs))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.round_trip(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed", "emptied")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


ORACLE_SQL = {
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM bw),
        sizes AS (SELECT DISTINCT n FROM win),
        dg AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
               FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT doc_id, item_id, k, n FROM dg JOIN win USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op4_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r),
        c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to, 'ok' AS status
        FROM g
    """,
    "op6_rp_forest": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
              AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= CAST(0.93 AS DOUBLE)),
        reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, e.b FROM reach JOIN e ON e.a = reach.r),
        c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
        SELECT m.vec_id, coalesce(n_links, 0) AS n_links, component_id, m.vec_id = component_id AS kept
        FROM embeddings m JOIN c USING (vec_id) LEFT JOIN n ON n.a = m.vec_id
    """,
    "op8_line_dedup": r"""
        WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, line, t, len(regexp_extract_all(t, '\S+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM raw WHERE regexp_matches(t, '\S')),
        c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM l),
        f AS (SELECT a.doc_id, a.k AS ks, min(b.k) AS ke FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + 50 AND b.upto >= a.upto - a.w + 50 GROUP BY ALL),
        r AS (SELECT b.doc_id, max(a.k) AS ks, b.k AS ke FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + 50 AND b.upto >= a.upto - a.w + 50 GROUP BY b.doc_id, b.k),
        win AS (SELECT * FROM f UNION SELECT * FROM r),
        txt AS (SELECT win.doc_id, ks, ke, string_agg(c.t, chr(10) ORDER BY c.k) AS g FROM win JOIN c ON c.doc_id = win.doc_id AND c.k BETWEEN ks AND ke GROUP BY ALL),
        fst AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, ks) AS nth FROM txt),
        dk AS (SELECT DISTINCT c.doc_id, c.k FROM c JOIN fst ON fst.doc_id = c.doc_id AND c.k BETWEEN ks AND ke WHERE nth > 1),
        near AS (SELECT raw.doc_id, raw.line, max(k) OVER (PARTITION BY raw.doc_id ORDER BY raw.line ROWS UNBOUNDED PRECEDING) AS p, min(k) OVER (PARTITION BY raw.doc_id ORDER BY raw.line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM raw LEFT JOIN c ON c.doc_id = raw.doc_id AND c.line = raw.line),
        del AS (SELECT near.doc_id, line FROM near JOIN dk x ON x.doc_id = near.doc_id AND x.k = p JOIN dk y ON y.doc_id = near.doc_id AND y.k = q),
        own AS (SELECT raw.doc_id, count(*) AS n_lines, count(del.line) AS n_removed, string_agg(t, chr(10) ORDER BY raw.line) FILTER (WHERE del.line IS NULL) AS text FROM raw LEFT JOIN del ON raw.doc_id = del.doc_id AND raw.line = del.line GROUP BY raw.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(own.text, '') END AS text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
               CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, coalesce(n_removed > 0 AND NOT regexp_matches(coalesce(own.text, ''), '\S'), false) AS emptied
        FROM documents d LEFT JOIN own USING (doc_id)
    """,
}
