"""BM25: an index of two tables, and search for whole tables of questions at once.

The corpus is tokenised once, into a written table of postings; document counts of terms, the number of texts and their mean
length come from its columns, each read alone.  A search joins the postings with the questions' terms before anything else.
Each step is dealt to as many tasks as its own size asks for, so a task's memory doesn't grow with the corpus.

Okapi weights with k1 1.5, b 0.75; a term in more than half of the texts would weigh less than nothing and gets a quarter
of the mean weight instead.  All arithmetic is in double; scores are rounded to six decimals, so equal texts tie
whatever the order in which their terms are added up.

Defined cases: ids name one text each; null texts have no terms and length 0 but count as texts; a question without known terms finds nothing; an
empty corpus raises ValueError; columns other than id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.text import is_term, term_words, terms
from velith.operators.sizes import TASK_ROWS, TASK_TEXT, bounded, tasks
from velith.sources.scratch import materialise


def term_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t): the array of search terms of each text."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(terms(text_col), F.array().cast("array<string>")).alias("t"))


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl)"""
    return term_rows(docs, id_col, text_col).select("id", F.size("t").alias("dl"))


def text_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Texts and their bytes."""
    found = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("bytes")).first()
    return found["n"], found["bytes"] or 0


def term_rows_long(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(id, term): a row a term, sifted after the explosion, where it is compiled code; texts without one give none.

    Texts are dealt by id first, so all that is counted inside a text is counted where it lies.  The outer form of explode
    keeps the optimizer from splitting every text a second time, below the shuffle, to drop the empty ones.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(parts, "id")
    return own.select("id", F.explode_outer(term_words("text")).alias("w")).select("id", F.lower("w").alias("term")).filter(is_term(F.col("term")))


def term_counts(counted: DataFrame, parts: int) -> DataFrame:
    """(term, df, all) of rows (id, term, tf): summed up by term and a share of the ids, so that no term is one task's, then by term."""
    dealt = counted.select("term", "tf", F.pmod(F.xxhash64("id"), F.lit(64)).alias("share")).repartition(parts, "term", "share")
    shares = dealt.groupBy("term", "share").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    return shares.repartition(parts, "term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all"))


def _counted(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(id, term, tf)"""
    return term_rows_long(docs, id_col, text_col, parts).groupBy("id", "term").agg(F.count("*").alias("tf"))


def _parts(docs: DataFrame, size: int) -> int:
    return tasks(docs.sparkSession, size, TASK_TEXT)


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df): texts that hold each term."""
    parts = _parts(docs, text_size(docs, text_col)[1])
    return term_counts(_counted(docs, id_col, text_col, parts), parts).select("term", "df")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, term, tf, dl): texts are shuffled once, by id; counts and lengths need no other shuffle."""
    counted = _counted(docs, id_col, text_col, parts or _parts(docs, text_size(docs, text_col)[1]))
    return counted.withColumn("dl", F.sum("tf").over(Window.partitionBy("id")).cast("int"))


def raw_idf(df: Column, n: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


@dataclass
class Index:
    """postings (id, term, tf, dl), weights (term, df, idf), the number of texts and their mean length."""

    postings: DataFrame
    weights: DataFrame
    n: int
    mean_length: float

    def write(self, path: str) -> None:
        """The index as Parquet in a folder of the caller's."""
        spark = self.postings.sparkSession
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(self.n, self.mean_length)], "n long, mean_length double").write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        stats = spark.read.parquet(f"{path}/stats").first()
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/weights"), stats["n"], stats["mean_length"])


def weigh(frequencies: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) with weights below nothing replaced by a quarter of the mean over all terms."""
    raw = frequencies.withColumn("idf", raw_idf(F.col("df"), F.lit(float(n))))
    mean = raw.agg(F.avg("idf").alias("m")).first()["m"] or 0.0
    return raw.withColumn("idf", F.when(F.col("idf") < 0, F.lit(lx.BM25_EPSILON * mean)).otherwise(F.col("idf")))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index over all texts, its tables written to the shared folder."""
    n, size = text_size(docs, text_col)
    if not n:
        raise ValueError("there is no text to index")
    parts = _parts(docs, size)
    own = materialise(postings(docs, id_col, text_col, parts), "postings")
    df = materialise(term_counts(own, parts), "term-counts")
    total = df.agg(F.sum("all").alias("m")).first()["m"] or 0
    return Index(own, weigh(df.select("term", "df"), n), n, total / n)


def search(index: Index, questions: DataFrame, limit: int, keys: list[str], text_col: str = "text", within: DataFrame | None = None) -> DataFrame:
    """(keys, rank, id, score) of the best ``limit`` texts a question; equal scores in id order, only scores above 0.

    ``within`` holds the ids that may be found; weights are those of the whole index whatever it holds.
    """
    asked = questions.select(*keys, F.explode(terms(text_col)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("times"))
    asked = materialise(asked.join(index.weights.select("term", "idf", "df"), "term"), "asked")
    met = asked.agg(F.sum("df").alias("n")).first()["n"] or 0  # the very number of postings that meet a question
    parts = tasks(asked.sparkSession, met, TASK_ROWS)
    norm = lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * F.col("dl") / F.lit(max(index.mean_length, 1e-9)))
    gain = F.col("times") * F.col("idf") * F.col("tf") * (lx.BM25_K1 + 1) / (F.col("tf") + norm)
    gains = index.postings.join(bounded(asked.drop("df")), "term").select(*keys, "id", gain.alias("gain")).repartition(parts, "id")
    if within is not None:  # an inner join, which the optimizer leaves where it is, after the postings have met the questions
        gains = gains.join(bounded(within.select("id").repartition(parts, "id").distinct()), "id")
    scored = gains.groupBy(*keys, "id").agg(F.round(F.sum("gain"), 6).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(*keys, "rank", "id", "score")
