"""Questions, prompts, answers, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions import answers as a
from velith.functions import lexicon as lx
from velith.operators.context import remembered, within_budget
from velith.operators.fusion import single
from velith.plans import answering
from velith.plans.catalog import inputs as i
from velith.plans.catalog import retrieval as r
from velith.sources.models import generator
from velith.sources.scratch import materialise


def op_expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = i.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.element_at(F.array(*map(F.lit, ["How many ", "Wie lange ist ", "§ ", "Welcher Absatz und Satz "])), (F.col("turn") % 4 + 1).cast("int")), "text", F.lit("?")).alias("text"))
    return asked.select("conv_id", "turn", F.array_join(a.expansions("text"), "\x1f").alias("variants"))


def op_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "documents").select("doc_id", a.detect_language("text").alias("language"))


def op_extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("So it is ["), "l_linenumber", F.lit("]["), F.col("l_quantity").cast("int"), F.lit(" , 2] and [see 4] or [0, "), F.col("l_suppkey") % 9, F.lit(", § "), "l_partkey", F.lit("]."))
    return i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(a.extract_citations(text, 6), ",").alias("cites"))


def op_is_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" I DON'T know."))).when(F.col("turn") % 5 == 1, F.concat(F.lit("Das kann ich nicht beantworten: "), "text")).otherwise(F.col("text"))
    return i.table(spark, sf_dir, "conversations").select("conv_id", "turn", a.is_refusal(said).alias("refusal"))


def op_strip_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" Yes [1]. It is [1, 2] "), "c_name", F.lit(" [23]\n"))
    return i.table(spark, sf_dir, "customer").select("c_custkey", a.strip_citations(text).alias("answer"))


def op_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(a.claims("text")).alias("k", "claim"))


def op_memory_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = i.table(spark, sf_dir, "conversations").withColumn("refused", F.length("text") % 4 == 0)
    return remembered(turns, ["conv_id"], ["turn", "text"]).select("conv_id", "turn", "turn_rank")


def op_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "documents").select("doc_id", a.excerpt("text").alias("excerpt"))


def op_payload_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "documents").select("doc_id", a.preview("text").alias("preview"))


def op_citation_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.table(spark, sf_dir, "lineitem").join(i.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    title, section = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("§ "), "p_size"))
    last = F.when(F.col("l_suppkey") % 3 == 0, F.lit(None)).otherwise(F.col("l_linenumber") + F.col("l_suppkey") % 2)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.citation(title, F.col("p_brand"), section, F.col("l_linenumber"), last).alias("citation"))


def op_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark item within the prompt's budget."""
    best = materialise(single(r.sparse_list(spark, sf_dir), "item_id", "sparse"), "best")
    texts = best.join(answering.found_in(i.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), best), "id")
    listed = texts.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("s"))
    kept = listed.select("item_id", within_budget(F.transform("s", lambda x: x["text"])).alias("kept"))
    return kept.select("item_id", F.size("kept").alias("n_kept"), F.md5(F.array_join("kept", "\x1f").cast("binary")).alias("kept_md5"))


def op_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the built-in stand-in model, citations checked."""
    docs = i.table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "text")
    results = single(r.sparse_list(spark, sf_dir), "item_id", "sparse")
    found = answering.answer(r.questions(spark, sf_dir), results, chunks, "item_id", "sparse", generator())
    return found.select("item_id", "answer", "confidence", "refused", "cited", F.size("sources").alias("n_sources"))


def op_valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of conversation turns, with the reason why one is turned away."""
    rows = i.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.repeat(F.lit("s"), F.col("conv_id").cast("int") * 2).alias("session_id"), F.element_at(F.array(*map(F.lit, ["dense", "sparse", "hybrid", "other"])), (F.col("turn") % 4 + 1).cast("int")).alias("mode"), (F.col("turn") * 7).alias("top_k"))
    return rows.select("conv_id", "turn", a.request_error("question", "session_id", "mode", F.lit(None).cast("string"), "top_k").alias("error"))


def op_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Sure: "), "props", F.lit(" - done"))).when(kind == 2, F.concat(F.lit("["), "props")).otherwise("none at all")
    return i.table(spark, sf_dir, "events").select("event_id", a.repaired_json(said).alias("json"))


SAID = "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text || ' I DON''T know.' WHEN 1 THEN 'Das kann ich nicht beantworten: ' || text ELSE text END AS said FROM conversations"
CUT = r"regexp_replace(left(text, {n}), '(?s) [^ ]*$', '') || ' […]'"
#: Tables up to f: the five best documents of each item, of which ``kept`` is what fits the budget.
KEPT = f"""WITH RECURSIVE {r.SPARSE}, x AS (SELECT item_id, rank, text FROM s JOIN documents ON doc_id = id WHERE rank <= 5),
        f AS (SELECT DISTINCT item_id, 0 AS rank, 0::BIGINT AS used, false AS over, NULL::VARCHAR AS kept FROM x
            UNION ALL SELECT item_id, rank, CASE WHEN ended THEN used ELSE used + length(piece) END, ended, CASE WHEN ended THEN NULL ELSE piece END FROM
            (SELECT x.item_id, x.rank, f.used, CASE WHEN length(text) <= 8000 - used THEN text ELSE {CUT.format(n='CAST(8000 - used AS BIGINT)')} END AS piece, over OR (length(text) > 8000 - used AND 8000 - used < 200) AS ended FROM f JOIN x ON x.item_id = f.item_id AND x.rank = f.rank + 1))"""
FIRST = i.q(rf"(?s)^(.*?[.!?]){lx.WS}")
LANGUAGE = f"""(SELECT CASE WHEN g > e OR (g = e AND regexp_matches(p, '[äöüß§]')) THEN 'German' ELSE 'English' END FROM (SELECT p, len(list_filter({i.sql_list(lx.GERMAN_MARKERS)}, lambda m: contains(p, m))) AS g,
    len(list_filter({i.sql_list(lx.ENGLISH_MARKERS)}, lambda m: contains(p, m))) AS e FROM (SELECT ' ' || lower({{text}}) || ' ' AS p)))"""

SQL = {
    "op_expand_query": f"""SELECT conv_id, turn, coalesce(array_to_string({r.expansion_sql('text')}, chr(31)), '') AS variants
        FROM (SELECT conv_id, turn, ['How many ', 'Wie lange ist ', '§ ', 'Welcher Absatz und Satz '][turn % 4 + 1] || text || '?' AS text FROM conversations)""",
    "op_detect_language": f"""SELECT doc_id, CASE WHEN g > e OR (g = e AND regexp_matches(p, '[äöüß§]')) THEN 'German' ELSE 'English' END AS language
        FROM (SELECT doc_id, p, len(list_filter({i.sql_list(lx.GERMAN_MARKERS)}, lambda m: contains(p, m))) AS g, len(list_filter({i.sql_list(lx.ENGLISH_MARKERS)}, lambda m: contains(p, m))) AS e FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS p FROM documents))""",
    "op_extract_citations": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_sort(list_distinct(list_filter([l_linenumber, CAST(l_quantity AS INTEGER), 2, CAST(l_suppkey % 9 AS INTEGER)], lambda x: x BETWEEN 1 AND 6))), ',') AS cites FROM lineitem""",
    "op_is_refusal": f"SELECT conv_id, turn, len(list_filter({i.sql_list(lx.REFUSALS)}, lambda m: contains(lower(said), m))) > 0 AS refusal FROM ({SAID})",
    "op_strip_citations": "SELECT c_custkey, 'Yes . It is [1, 2] ' || c_name AS answer FROM customer",
    "op_claims": f"""SELECT conv_id, turn, CAST(k AS INTEGER) AS k, claim FROM (SELECT conv_id, turn, unnest(c) AS claim, unnest(range(len(c))) AS k
        FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace({i.sql_strip("regexp_replace(text, '\\[\\d+\\]', '', 'g')")}, {i.q(rf'([.!?]){lx.WS}+')}, '\\1' || chr(30), 'g'), chr(30)), lambda s: {i.sql_strip('s')}), lambda s: length(s) > 15) AS c FROM conversations WHERE role = 'assistant'))""",
    "op_memory_last3": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS INTEGER) AS turn_rank FROM conversations WHERE length(text) % 4 <> 0 QUALIFY turn_rank <= 3",
    "op_excerpt": f"SELECT doc_id, CASE WHEN length(text) > 600 THEN {CUT.format(n=600)} ELSE coalesce(text, '') END AS excerpt FROM documents",
    "op_payload_preview": "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS preview FROM documents",
    "op_citation_string": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_name END || CASE WHEN p_size % 3 <> 0 THEN ', § ' || p_size ELSE '' END
        || CASE WHEN l_suppkey % 3 <> 0 AND l_suppkey % 2 = 1 THEN ', pp. ' || l_linenumber || '-' || (l_linenumber + 1) ELSE ', p. ' || l_linenumber END AS citation FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "op_ask": f"""{KEPT}, c AS ({r.confidence_sql('sparse').removeprefix(f'WITH {r.SPARSE}')}),
        pieces AS (SELECT item_id, rank, {i.sql_strip('split_part(kept, chr(10) || chr(10), 1)')} AS t FROM f WHERE kept IS NOT NULL AND rank <= 2),
        said AS (SELECT item_id, string_agg(CASE WHEN regexp_matches(t, {FIRST}) THEN regexp_extract(t, {FIRST}, 1) ELSE t END || ' [' || rank || ']', ' ' ORDER BY rank) AS said FROM pieces GROUP BY item_id),
        g AS (SELECT b.item_id, confidence, results, results = 0 OR confidence < 0.3::DOUBLE AS gated, said, {LANGUAGE.format(text='b.text')} AS language FROM benchmark b JOIN c USING (item_id) LEFT JOIN said USING (item_id)),
        a AS (SELECT *, CASE WHEN gated THEN CASE language WHEN 'German' THEN 'Ich weiß es nicht.' ELSE 'I don''t know.' END ELSE coalesce(said, 'I don''t know.') END AS answer FROM g)
        SELECT item_id, answer, confidence, gated OR len(list_filter({i.sql_list(lx.REFUSALS)}, lambda m: contains(lower(answer), m))) > 0 AS refused,
            NOT gated AND said IS NOT NULL AS cited, CAST(results AS INTEGER) AS n_sources FROM a""",
    "op_context_budget": f"""{KEPT}
        SELECT item_id, CAST(count(kept) AS INTEGER) AS n_kept, md5(coalesce(string_agg(kept, chr(31) ORDER BY rank), '')) AS kept_md5 FROM f GROUP BY item_id""",
    "op_valid_requests": f"""SELECT conv_id, turn, CASE WHEN length(question) NOT BETWEEN 3 AND 1000 THEN 'question length' WHEN {i.sql_strip('question')} = '' THEN 'question blank' WHEN conv_id * 2 > 128 THEN 'session_id length' WHEN turn % 4 = 3 THEN 'mode' WHEN turn * 7 NOT BETWEEN 1 AND 20 THEN 'top_k' END AS error
        FROM (SELECT conv_id, turn, text AS question FROM conversations)""",
    "op_json_repair": """SELECT event_id, CASE WHEN event_id % 4 = 2 THEN NULL WHEN event_id % 4 = 3 THEN NULL ELSE props END AS json FROM events""",
}
