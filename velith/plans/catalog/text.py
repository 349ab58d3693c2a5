"""Cleaning, sections, sentences, tokens, chunks and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.ids import chunk_id, content_hash, point_id
from velith.functions.text import clean_text, count_tokens, detect_section, first_section, is_noise, lines, split_sentences, table_to_markdown, terms
from velith.operators import chunking
from velith.operators.statistics import document_totals
from velith.plans.catalog import inputs as i


def op_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = i.documents(spark, sf_dir).select("doc_id", F.coalesce(terms("text"), F.array().cast("array<string>")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ").cast("binary")).alias("terms_md5"))


def op_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.raw_pages(spark, sf_dir).select("doc_id", "page_number", clean_text("raw").alias("text"), first_section("raw").alias("section"))


def op_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.documents(spark, sf_dir).select("doc_id", clean_text("text").alias("text"))


def op_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = i.raw_pages(spark, sf_dir).select("doc_id", F.explode(lines("raw")).alias("line"))
    return each.filter(is_noise("line")).groupBy("line").agg(F.count("*").alias("n"))


def op_detect_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = i.raw_pages(spark, sf_dir).select(F.explode(lines("raw")).alias("line"))
    every = own.union(i.documents(spark, sf_dir).select(F.explode(lines("text"))))
    return every.select(detect_section("line").alias("section")).filter("section is not null").groupBy("section").agg(F.count("*").alias("n"))


def op_section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.carry_sections(i.pages(spark, sf_dir)).select("doc_id", "page_number", "text", "section")


def op_table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    cells = F.when(line % 3 == 0, F.array(F.lit(None).cast("string"), F.lit(" "))).when(line % 3 == 1, F.array(F.col("l_returnflag"), F.concat("l_shipdate_d", F.lit("\nshipped ")))).otherwise(F.array(F.col("l_linestatus"), F.lit(None).cast("string"), F.col("l_partkey").cast("string")))
    rows = i.table(spark, sf_dir, "lineitem").withColumn("l_shipdate_d", F.date_format("l_shipdate", "yyyy-MM-dd")).select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate_d", cells.alias("cells")).alias("r"))
    tables = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("r")).getField("cells").alias("t"))
    return tables.select("doc_id", table_to_markdown("t").alias("markdown"))


def op_split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.documents(spark, sf_dir).select("doc_id", F.posexplode(split_sentences("text")).alias("ix", "sentence"))


def op_pages_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pages_to_sentences(i.pages(spark, sf_dir))


def op_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.documents(spark, sf_dir).select("doc_id", count_tokens("text").alias("n_tokens"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.as_pages(i.documents(spark, sf_dir))


def op_chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(_paged(spark, sf_dir))


def op_chunk_fixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(i.pages(spark, sf_dir), 40, 8)


def op_chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_chunks(_paged(spark, sf_dir), 64, 1)


def op_chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic_chunks(_paged(spark, sf_dir), chunking.letter_encoder, 128)


def op_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "").otherwise("fixed").alias("plan"), F.concat_ws("|", "l_partkey", "l_returnflag", "l_linestatus").alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", chunk_id("l_orderkey", "plan", F.col("l_linenumber") * 30011, "t").alias("chunk_id"))


def op_point_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.chunks(spark, sf_dir).select("chunk_id", point_id("chunk_id").alias("point_id"))


def op_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "pages").select("page_id", content_hash("html").alias("content_hash"))


def op_document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_totals(i.pages(spark, sf_dir).withColumn("table_count", F.col("page_number") % 2))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vec_id, d): distance of each vector to the one before it with its label."""
    rows = i.table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ix"), F.col("embedding").alias("text"))
    return chunking.with_distances(rows, lambda v: v).select(F.col("doc_id").alias("label"), F.col("ix").alias("vec_id"), "d")


def op_adjacent_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).select("label", "vec_id", F.round("d", 6).alias("distance"))


def op_breakpoint_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).groupBy("label").agg(F.round(F.percentile("d", lx.SEMANTIC_PERCENTILE), 6).alias("threshold"))


CHUNK_ID = "doc_id || '_' || strategy || '_' || printf('%05d', chunk_index) || '_' || left(sha1(doc_id || '|' || strategy || '|' || chunk_index || '|' || text), 16) AS chunk_id"
DISTANCES = """SELECT label, vec_id, round(CASE WHEN p IS NOT NULL THEN 1 - list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))) END, 9) AS d
    FROM (SELECT label, vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""
CLEAN = f"SELECT doc_id, page_number, {i.sql_clean('raw')} AS text, list_filter(list_transform(list_filter({i.sql_lines('raw')}, lambda y: NOT {i.sql_noise('y')}), lambda z: {i.sql_section('z')}), lambda s: s IS NOT NULL)[1] AS section FROM ({i.RAW_PAGES})"
PIECES = f"SELECT doc_id, unnest(generate_series(1, len(s))) - 1 AS i, unnest(s) AS text FROM (SELECT doc_id, {i.sql_sentences('text')} AS s FROM documents WHERE text IS NOT NULL)"
FROM_RANGES = f"""
    spans AS (SELECT r.doc_id, a, b, row_number() OVER (PARTITION BY r.doc_id ORDER BY a, b) - 1 AS k FROM ranges r),
    made AS (SELECT spans.doc_id, k, string_agg(p.text, ' ' ORDER BY p.i) AS text FROM spans JOIN p ON p.doc_id = spans.doc_id AND p.i >= a AND p.i < b GROUP BY ALL),
    named AS (SELECT doc_id, STRATEGY AS strategy, CAST(k AS INTEGER) AS chunk_index, text FROM made)
    SELECT doc_id, strategy, chunk_index, {CHUNK_ID}, text, CAST({i.sql_count('text')} AS INTEGER) AS token_count, 1 AS page_start, 1 AS page_end, CAST(NULL AS VARCHAR) AS section FROM named"""
LETTERS = "[" + ", ".join(f"CAST(len(regexp_extract_all(text, '{g}')) AS DOUBLE)" for g in ["[aeiou]", "[bcdfg]", "[hjklm]", "[npqrs]", "[tvwxyz]", "[0-9]", "[ ]", "[A-Z]"]) + "]"

def sentence_sql(budget: int) -> str:
    """Greedy packing of whole sentences, one sentence a step."""
    return f"""
        WITH RECURSIVE p AS ({PIECES}), l AS (SELECT doc_id, list({i.sql_count('text')} ORDER BY i) AS n FROM p GROUP BY doc_id),
        s AS (SELECT doc_id, n, 0 AS i, 0 AS start, 0 AS total, NULL::INTEGER AS a, NULL::INTEGER AS b, false AS alone FROM l
            UNION ALL SELECT doc_id, n, i + 1, CASE WHEN n[i + 1] > {budget} THEN i + 1 WHEN total + n[i + 1] > {budget} AND start < i THEN i - 1 ELSE start END,
                CASE WHEN n[i + 1] > {budget} THEN 0 WHEN total + n[i + 1] > {budget} AND start < i THEN n[i] + n[i + 1] ELSE total + n[i + 1] END,
                CASE WHEN (n[i + 1] > {budget} OR total + n[i + 1] > {budget}) AND start < i THEN start END, i, n[i + 1] > {budget} FROM s WHERE i < len(n)),
        ranges AS (SELECT doc_id, a, b FROM s WHERE a IS NOT NULL UNION ALL SELECT doc_id, b, b + 1 FROM s WHERE alone UNION ALL SELECT doc_id, start, i FROM s WHERE i = len(n) AND start < i), {FROM_RANGES.replace('STRATEGY', "'sentence'")}"""


SQL = {
    "op_tokenize": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {i.sql_terms('text')} AS t FROM documents)",
    "op_clean_text": f"SELECT doc_id, page_number, text, section FROM ({CLEAN})",
    "op_clean_documents": f"SELECT doc_id, {i.sql_clean('text')} AS text FROM documents",
    "op_noise_lines": f"SELECT line, count(*) AS n FROM (SELECT unnest({i.sql_lines('raw')}) AS line FROM ({i.RAW_PAGES})) WHERE {i.sql_noise('line')} GROUP BY line",
    "op_detect_section": f"""SELECT section, count(*) AS n FROM (SELECT {i.sql_section('line')} AS section FROM (SELECT unnest({i.sql_lines('raw')}) AS line FROM ({i.RAW_PAGES})
        UNION ALL SELECT unnest({i.sql_lines('text')}) FROM documents)) WHERE section IS NOT NULL GROUP BY section""",
    "op_section_carry": f"SELECT doc_id, page_number, text, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, text ROWS UNBOUNDED PRECEDING) AS section FROM ({CLEAN})",
    "op_table_markdown": """
        WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, strftime(l_shipdate, '%Y-%m-%d') AS sd, l_returnflag AS rf, l_linestatus AS ls,
            CASE l_linenumber % 3 WHEN 0 THEN [] WHEN 1 THEN [l_returnflag, strftime(l_shipdate, '%Y-%m-%d') || ' shipped'] ELSE [l_linestatus, '', CAST(l_partkey AS VARCHAR)] END AS c FROM lineitem),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln, pk, sk, sd, c) AS k, max(len(c)) OVER (PARTITION BY doc_id) AS w FROM r WHERE len(c) > 0),
        t AS (SELECT doc_id, k, '| ' || array_to_string(list_concat(c, list_transform(range(w - len(c)), lambda x: '')), ' | ') || ' |' || CASE WHEN k = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |' ELSE '' END AS line FROM k)
        SELECT d.doc_id, coalesce(m, '') AS markdown FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS m FROM t GROUP BY doc_id) USING (doc_id)""",
    "op_split_sentences": f"SELECT doc_id, CAST(i AS INTEGER) AS ix, text AS sentence FROM ({PIECES})",
    "op_pages_to_sentences": f"""
        WITH c AS ({CLEAN}), s AS (SELECT doc_id, page_number, section, text AS page_text, unnest({i.sql_sentences('text')}) AS text, generate_subscripts({i.sql_sentences('text')}, 1) AS pos FROM c),
        e AS (SELECT *, coalesce({i.sql_section(i.sql_lines('text') + '[1]')}, CASE WHEN pos = 1 THEN section END) AS event FROM s)
        SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS ix, text, page_number AS page, last_value(event IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS section, CAST({i.sql_count('text')} AS INTEGER) AS n
        FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, page_text, pos)""",
    "op_count_tokens": f"SELECT doc_id, CAST({i.sql_count('text')} AS INTEGER) AS n_tokens FROM documents",
    "op_chunk_fixed": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, {i.q(lx.NOT_WS + '+')}) AS w FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, w, unnest(list_filter(range(0, len(w), 462), lambda s: s = 0 OR s + 50 < len(w))) AS start FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, 'fixed' AS strategy, CAST(start // 462 AS INTEGER) AS chunk_index, w[start + 1:start + 512] AS t, array_to_string(w[start + 1:start + 512], ' ') AS text FROM c)
        SELECT doc_id, strategy, chunk_index, {CHUNK_ID}, text, CAST(len(t) AS INTEGER) AS token_count, 1 AS page_start, 1 AS page_end, CAST(NULL AS VARCHAR) AS section FROM n""",
    "op_chunk_fixed_pages": f"""
        WITH c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, text) AS copy FROM ({CLEAN})), t AS (SELECT doc_id, page_number AS page, section, copy, text AS page_text, unnest(regexp_extract_all(text, {i.q(lx.NOT_WS + '+')})) AS t, generate_subscripts(regexp_extract_all(text, {i.q(lx.NOT_WS + '+')}), 1) AS pos FROM c),
        n AS (SELECT doc_id, page, section, t, row_number() OVER (PARTITION BY doc_id ORDER BY page, page_text, copy, pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM t),
        w AS (SELECT DISTINCT doc_id, unnest(list_filter(range(0, total, 32), lambda s: s = 0 OR s + 8 < total)) AS start FROM n),
        g AS (SELECT w.doc_id, 'fixed' AS strategy, CAST(start // 32 AS INTEGER) AS chunk_index, string_agg(t, ' ' ORDER BY k) AS text, CAST(count(*) AS INTEGER) AS token_count, min(page) AS page_start, max(page) AS page_end, arg_min(section, k) FILTER (WHERE section IS NOT NULL) AS section
              FROM w JOIN n ON n.doc_id = w.doc_id AND k >= start AND k < start + 40 GROUP BY w.doc_id, start)
        SELECT doc_id, strategy, chunk_index, {CHUNK_ID}, text, token_count, page_start, page_end, section FROM g""",
    "op_chunk_sentence": sentence_sql(64),
    "op_chunk_semantic": f"""
        WITH RECURSIVE p AS ({PIECES}), v AS (SELECT *, {LETTERS} AS v FROM p), g AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM v),
        d AS (SELECT doc_id, i, {i.sql_count('text')} AS n, CASE WHEN u IS NOT NULL THEN round(1 - list_dot_product(u, v) / ((CASE WHEN list_dot_product(u, u) = 0 THEN 1 ELSE sqrt(list_dot_product(u, u)) END) * (CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END)), 9) END AS d FROM g),
        l AS (SELECT doc_id, list(n ORDER BY i) AS n, list(d ORDER BY i) AS d, round(quantile_cont(d, 0.85), 9) AS t FROM d GROUP BY doc_id),
        s AS (SELECT doc_id, n, d, t, 0 AS i, 0 AS start, 0 AS total, NULL::INTEGER AS a, NULL::INTEGER AS b FROM l WHERE len(n) > 3
            UNION ALL SELECT doc_id, n, d, t, i + 1, CASE WHEN cut THEN i ELSE start END, CASE WHEN cut THEN n[i + 1] ELSE total + n[i + 1] END, CASE WHEN cut THEN start END, i
            FROM (SELECT *, i > start AND ((coalesce(d[i + 1] >= t, false) AND i - start >= 3) OR total + n[i + 1] > 128) AS cut FROM s WHERE i < len(n))),
        ranges AS (SELECT doc_id, a, b FROM s WHERE a IS NOT NULL UNION ALL SELECT doc_id, start, i FROM s WHERE i = len(n) UNION ALL SELECT doc_id, 0, len(n) FROM l WHERE len(n) <= 3), {FROM_RANGES.replace('STRATEGY', "'semantic'")}""",
    "op_chunk_id": """SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || CASE WHEN s = '' THEN '' ELSE '_' || s END || '_' || printf('%05d', k) || '_' || left(sha1(l_orderkey || '|' || s || '|' || k || '|' || t), 16) AS chunk_id
        FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN '' ELSE 'fixed' END AS s, l_linenumber * 30011 AS k, concat_ws('|', l_partkey, l_returnflag, l_linestatus) AS t FROM lineitem)""",
    "op_point_uuid5": f"""SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(CAST('0x' || h[17:17] AS INTEGER) % 4 AS INTEGER) + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id
        FROM (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk://' || chunk_id)) AS h FROM ({i.CHUNKS}))""",
    "op_content_hash": "SELECT page_id, sha256(html) AS content_hash FROM pages",
    "op_document_totals": f"SELECT doc_id, count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS char_count, CAST(sum(page_number % 2) AS BIGINT) AS table_count FROM ({CLEAN}) GROUP BY doc_id",
    "op_adjacent_distance": f"SELECT label, vec_id, round(d, 6) AS distance FROM ({DISTANCES})",
    "op_breakpoint_percentile": f"SELECT label, round(quantile_cont(d, 0.85), 6) AS threshold FROM ({DISTANCES}) GROUP BY label",
}
