"""Shared inputs of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.operators.sizes import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table for work that is heavy a row: dealt to all cores if its files give too few tasks."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


HEADS = {1: "§ 7a  Rest periods", 2: "Artikel 3", 3: "Abschnitt IV General rules", 4: " Seite 3 von 9", 5: "12", 6: "3.1 Scope Of Rules"}


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_number, raw): a page per order line, with headings, furniture, abbreviations and blanks to clean."""
    kind = F.col("l_linenumber") % 7
    head = F.when(kind == 0, "- Seite 1 von 2 -")
    for k, text in HEADS.items():
        head = head.when(kind == k, text)
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page_number"),
        F.concat(head, F.lit("\n\n\n\nPart  "), F.col("l_partkey"), F.lit(" of supplier "), F.col("l_suppkey"), F.lit(" is due.   See Abs. "), F.col("l_linenumber"), F.lit(" and Nr. A"), F.col("l_suppkey"), F.lit(".\nThe line costs: (Net) "), F.col("l_partkey") * 7, F.lit(" cents!\tNo more.  \n"), F.col("l_partkey") % 50).alias("raw"),
    )


RAW_PAGES = (
    "SELECT l_orderkey AS doc_id, l_linenumber AS page_number, concat(CASE l_linenumber % 7 WHEN 0 THEN '- Seite 1 von 2 -' "
    + " ".join(f"WHEN {k} THEN '{t}'" for k, t in HEADS.items())
    + " END, chr(10), chr(10), chr(10), chr(10), 'Part  ', l_partkey, ' of supplier ', l_suppkey, ' is due.   See Abs. ', l_linenumber, ' and Nr. A', l_suppkey, '.', chr(10), 'The line costs: (Net) ', l_partkey * 7, ' cents!', chr(9), 'No more.  ', chr(10), l_partkey % 50) AS raw FROM lineitem"
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned pages of :func:`raw_pages` with their own section."""
    from velith.functions.text import clean_text, first_section

    return raw_pages(spark, sf_dir).select("doc_id", "page_number", first_section("raw").alias("section"), clean_text("raw").alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows mapped from order lines."""
    strategy = F.when(F.col("l_returnflag") == "A", "fixed").when(F.col("l_returnflag") == "N", "sentence").otherwise("semantic")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        strategy.alias("strategy"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk_id"),
        F.col("l_linenumber").alias("chunk_index"),
        F.col("l_quantity").cast("int").alias("token_count"),
        (F.col("l_linestatus") == "F").alias("embedded"),
    )


CHUNKS = """SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'fixed' WHEN 'N' THEN 'sentence' ELSE 'semantic' END AS strategy,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS chunk_id, l_linenumber AS chunk_index, CAST(l_quantity AS INTEGER) AS token_count, l_linestatus = 'F' AS embedded FROM lineitem"""


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows mapped from orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("language"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("content_hash"))


DOC_ROWS = "SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey AS title, o_orderstatus AS category, o_orderpriority AS language, sha256(CAST(o_custkey AS VARCHAR)) AS content_hash FROM orders"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation samples mapped from orders."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (key % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("question_id"),
        pick(["fixed", "sentence", "semantic"], 3).alias("strategy"),
        F.element_at(F.array(*map(F.lit, ["dense", "sparse", "hybrid"])), (F.floor(key / 3) % 3 + 1).cast("int")).alias("mode"),
        (F.col("o_orderstatus") != "P").alias("answerable"),
        (cust % 4 == 0).alias("refused"),
        (cust % 3 != 0).alias("cited"),
        (F.floor(F.col("o_totalprice") % 1000) / 1000).alias("confidence"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("latency_ms"),
        F.when(key % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(text(cust % 10))).alias("expected_docs"),
        F.array(text(key % 10), text((key + 3) % 10), text((key + 6) % 10)).alias("retrieved_docs"),
    )


SAMPLES = """SELECT o_orderkey AS question_id, ['fixed', 'sentence', 'semantic'][o_orderkey % 3 + 1] AS strategy, ['dense', 'sparse', 'hybrid'][o_orderkey // 3 % 3 + 1] AS mode,
    o_orderstatus <> 'P' AS answerable, o_custkey % 4 = 0 AS refused, o_custkey % 3 <> 0 AS cited, floor(o_totalprice % 1000) / 1000 AS confidence, CAST(floor(o_totalprice / 1000) AS BIGINT) AS latency_ms,
    CASE WHEN o_orderkey % 7 = 0 THEN [] ELSE [CAST(o_custkey % 10 AS VARCHAR)] END AS expected_docs,
    [CAST(o_orderkey % 10 AS VARCHAR), CAST((o_orderkey + 3) % 10 AS VARCHAR), CAST((o_orderkey + 6) % 10 AS VARCHAR)] AS retrieved_docs FROM orders"""


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(rf'^{lx.WS}+')}, ''), {q(rf'{lx.WS}+$')}, '')"


def sql_noise(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in lx.NOISE_PATTERNS) + ")"


def sql_section(x: str) -> str:
    own = sql_strip(x)
    cases = []
    for k, p in enumerate(lx.SECTION_PATTERNS):
        label = sql_strip(f"regexp_replace(regexp_extract({own}, {q(p)}, 1), {q(lx.WS + '+')}, ' ', 'g')")
        head = sql_strip(f"regexp_extract({own}, {q(p)}, 2)") if k < 4 else "''"
        cases.append(f"WHEN regexp_matches({own}, {q(p)}) THEN {label} || CASE WHEN {head} = '' THEN '' ELSE ' ' || {head} END")
    return f"CASE WHEN {own} = '' OR length({own}) > {lx.MAX_HEADING} THEN NULL {' '.join(cases)} END"


def sql_lines(x: str) -> str:
    return f"regexp_split_to_array({x}, {q(lx.LINE_END)})"


def sql_clean(x: str) -> str:
    kept = f"array_to_string(list_transform(list_filter({sql_lines(x)}, lambda y: NOT {sql_noise('y')}), lambda z: regexp_replace(z, {q(lx.WS + '+$')}, '')), chr(10))"
    short = "regexp_replace(regexp_replace(" + kept + r", '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')"
    return sql_strip(short)


def sql_terms(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), {q(lx.TERM)}), lambda t: lower(t)), lambda t: NOT list_contains({sql_list(lx.STOPWORDS)}, t) AND (length(t) > 1 OR t = '§'))"


def sql_sentences(x: str) -> str:
    """Cut first, glue after abbreviations: the other way round than the engine does it."""
    short = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)
    cut = f"regexp_replace({x}, {q(rf'([{lx.SENTENCE_MARKS}]){lx.WS}+([{lx.SENTENCE_STARTS}])')}, '\\1' || chr(30) || '\\2', 'g')"
    glued = f"regexp_replace({cut}, '((?:{short})\\.)\\x1e', '\\1 ', 'g')"
    return f"list_filter(list_transform(string_split({glued}, chr(30)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_count(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), {q(lx.NOT_WS + '+')}))"
