"""Removal of repeated line runs, with DataFrame functions only.

The corpus is one long sequence of line ids, cut at document ends.  A run of lines counts when it has at least
``min_words`` words; of equal runs the first in (doc_id, line) order stays, later copies are deleted.

* Lines get order-preserving numbers: distinct lines (by a 128-bit hash) that occur twice are sorted over the cluster and
  numbered in that order.  Lines that occur once end every run, so the text is cut into islands of repeated lines.
* Prefix doubling: the rank of the 2^(k+1) lines from a position is the number of the pair (rank here, rank 2^k lines on)
  among all distinct pairs in sorted order; past the island's end stands -1.  So after round k positions are ordered by
  their first 2^k lines: the suffix array of all islands, read off by :func:`suffix_array`.  A line that counts has a word,
  so runs of ``min_words`` lines suffice and doubling stops at log2 of that, whatever the input's size.
* A longest-common-prefix interval of depth m is the set of suffixes that share their first m lines; they stand together
  in the suffix array.  It is named by the ranks of the two blocks of 2^k lines, k = floor(log2 m), that cover the m lines.
  Of each position two intervals are looked at: that of the shortest stretch with enough words that starts there and that
  of the one that ends there.  A maximal repeated run is exactly the union of the repeated stretches inside it: any
  line of it has enough words of the run either before or after it.  So the intervals' later members, merged where they
  touch, are the maximal runs' later copies.

Neighbours in a document are met by window functions over its rows, which spill; nothing is gathered in an array but the
ranges to delete.  Ranks and intervals are found by aggregates that combine before the shuffle, and joined by a broadcast
behind a row count or by a join that Spark can split at a hot key.

Defined cases: null text stays null and has no line; blank lines are no part of the sequence, those between two deleted
lines go with them; rows equal in doc_id and text count as one document and all get its result; rows with one doc_id but other texts
are documents of their own, in the order of their text hash; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velith.llm.common import materialise
from velith.operators.sizes import bounded

KEY = ["_doc", "_hash"]
ISLAND = [*KEY, "island"]
#: Ranks (three numbers each) up to which they are sent to all executors; beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def _name(*parts: Column) -> Column:
    """128-bit name of a sequence of columns."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def ranked(rows: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """(by, rank) of the distinct values that occur ``least`` times: rank grows with the order of the values."""
    found = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return materialise(found.select(*by).orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _without(text: Column, runs: Column) -> Column:
    """The text without the line ranges in ``runs`` (ordered, disjoint): what lies between them, joined again."""
    lines, m = F.split(text, "\n"), F.size(runs)

    def between(j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.get(runs, j - 1)["last"] + 1)
        return F.slice(lines, start + 1, F.when(j == m, F.size(lines)).otherwise(F.get(runs, j)["first"]) - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), m), between)), "\n")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines that occur at least twice: key, line (its number), k (its number without blank lines), words, r0 (its rank)."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("t"), F.regexp_count(x, F.lit(r"\S+")).alias("words")))
    lines = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.posexplode(F.filter(numbered, lambda x: x["words"] > 0)).alias("k", "l"))
    lines = lines.select(*KEY, "k", "l.line", "l.words", _name(F.col("l.t")).alias("id"))
    names = ranked(lines, "id", least=2)
    return lines.join(bounded(names, BROADCAST_ROWS), "id").select(*KEY, "k", "line", "words", F.col("rank").alias("r0"))


def islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Positions of islands of enough words: key, island, k, line, before (words of the document's repeated lines before it), upto, r0."""
    in_doc = lines.repartition(*KEY).dropDuplicates([*KEY, "k"])
    by_k = Window.partitionBy(*KEY).orderBy("k")
    in_doc = in_doc.withColumn("upto", F.sum("words").over(by_k)).withColumn("island", F.col("k") - F.row_number().over(by_k))
    in_doc = in_doc.withColumn("_all", F.sum("words").over(Window.partitionBy(*ISLAND)))
    return in_doc.filter(F.col("_all") >= min_words).select(*ISLAND, "k", "line", (F.col("upto") - F.col("words")).alias("before"), "upto", "r0")


def doubled(positions: DataFrame, rounds: int) -> DataFrame:
    """Positions with r1 .. r<rounds>: ranks of the 2, 4, ... lines from there on."""
    order = Window.partitionBy(*ISLAND).orderBy("k")
    for k in range(rounds):
        own, on = f"r{k}", F.coalesce(F.lead(f"r{k}", 1 << k).over(order), F.lit(-1).cast("long"))
        paired = materialise(positions.withColumn("_on", on), "positions")
        names = ranked(paired, own, "_on").withColumnRenamed("rank", f"r{k + 1}")
        positions = paired.join(bounded(names, BROADCAST_ROWS), [own, "_on"]).select(*positions.columns, f"r{k + 1}")
    return positions


def rounds_for(min_words: int) -> int:
    return max(0, min_words.bit_length() - 1)


def suffix_array(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Suffixes of all islands with their rank by the first 2^rounds lines (equal ones share it), to be read in rank order."""
    rounds = rounds_for(min_words)
    found = doubled(islands(repeated_lines(docs), min_words), rounds)
    return found.select(*ISLAND, "k", "r0", F.col(f"r{rounds}").alias("rank"))


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of just enough words under the names of their intervals: key, name, k and line number of the first line (k, first) and the last (end, last)."""
    rounds = rounds_for(min_words)
    rows = doubled(islands(lines, min_words), rounds)
    order = Window.partitionBy(*ISLAND).orderBy("k")
    levels = range(rounds + 1)
    rows = rows.withColumn("r", F.array(*(F.col(f"r{k}") for k in levels)))
    rows = rows.withColumn("q", F.array(*(F.lag(f"r{k}", (1 << k) - 1).over(order) for k in levels)))  # blocks that end here
    ahead = Window.partitionBy(*ISLAND).orderBy("before").rangeBetween(0, min_words - 1)  # the shortest stretch from here, if the island holds it
    behind = Window.partitionBy(*ISLAND).orderBy("upto").rangeBetween(1 - min_words, 0)
    level = lambda size: F.floor(F.log2(size.cast("double") + 1e-6)).cast("int")

    def stretch(whole: Column, size: Column, r: Column, q: Column, k: Column, end: Column, first: Column, last: Column) -> Column:
        name = F.struct(size.alias("size"), F.get(r, level(size)).alias("x"), F.get(q, level(size)).alias("y"))
        return F.when(whole, F.struct(name.alias("name"), k.alias("k"), end.alias("end"), first.alias("first"), last.alias("last")))

    f = [F.max("upto").over(ahead) >= F.col("before") + min_words, F.count("*").over(ahead), F.last("q").over(ahead), F.max("k").over(ahead), F.max("line").over(ahead)]
    b = [F.min("before").over(behind) <= F.col("upto") - min_words, F.count("*").over(behind), F.first("r").over(behind), F.min("k").over(behind), F.min("line").over(behind)]
    rows = rows.select(*KEY, "k", "line", "r", "q", *(c.alias(f"f{i}") for i, c in enumerate(f)), *(c.alias(f"b{i}") for i, c in enumerate(b)))
    c = F.col
    forward = stretch(c("f0"), c("f1"), c("r"), c("f2"), c("k"), c("f3"), c("line"), c("f4"))
    backward = stretch(c("b0"), c("b1"), c("b2"), c("q"), c("b3"), c("k"), c("b4"), c("line"))
    each = rows.select(*KEY, F.explode(F.array_distinct(F.array_compact(F.array(forward, backward)))).alias("x"))
    return each.select(*KEY, "x.name", "x.k", "x.end", "x.first", "x.last")


def intervals(found: DataFrame) -> DataFrame:
    """Longest-common-prefix intervals of two or more suffixes: name, earliest member."""
    at = F.struct(*KEY, "k")
    members = found.groupBy("name").agg(F.min(at).alias("earliest"), F.max(at).alias("_latest"))
    return members.filter(F.col("earliest") != F.col("_latest")).select("name", "earliest")


def later_copies(found: DataFrame) -> DataFrame:
    """Maximal line ranges to delete: key and ``runs``, an ordered array of disjoint (first, last).

    Stretches that touch but for blank lines become one range, which takes those with it.
    """
    at = F.struct(*KEY, "k")
    found = materialise(found, "stretches")
    firsts = materialise(intervals(found), "intervals")
    later = found.join(firsts, "name").filter(at > F.col("earliest")).select(*KEY, "k", "end", "first", "last")
    order = Window.partitionBy(*KEY).orderBy("k", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("k") <= reach + 1, 0).otherwise(1)
    runs = later.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Per document: doc_id, text without later copies, n_lines, n_removed (lines), runs, emptied.

    emptied says that no line with a word is left of a text that had one.
    """
    base = docs.select("doc_id", "text")
    runs = later_copies(stretches(repeated_lines(base), min_words))
    keyed = base.withColumn("_doc", F.col("doc_id")).withColumn("_hash", F.xxhash64("text"))
    same = (F.col("d._doc").eqNullSafe(F.col("r._doc"))) & (F.col("d._hash") == F.col("r._hash"))
    joined = keyed.alias("d").join(runs.alias("r"), same, "left").select("doc_id", "text", "runs")
    lines = F.split("text", "\n")
    cleaned = F.when(F.col("runs").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("runs")))
    gone = F.aggregate("runs", F.lit(0), lambda acc, r: acc + r["last"] - r["first"] + 1)
    return joined.select(
        "doc_id",
        cleaned.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(gone, F.lit(0)).alias("n_removed"),
        F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")).alias("runs"),
    ).withColumn("emptied", F.coalesce((F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S"), F.lit(False)))


def clean(docs: DataFrame, min_words: int = 50, text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, texts without later copies; a document of which nothing is left is dropped.

    n_chars, where it is there, follows the text.
    """
    text, found = F.col(text_col), F.col("_velith_runs")
    runs = later_copies(stretches(repeated_lines(docs.select("doc_id", text.alias("text"))), min_words))
    side = runs.select(F.col("_doc").alias("_velith_doc"), F.col("_hash").alias("_velith_hash"), F.col("runs").alias("_velith_runs"))
    joined = docs.join(side, F.col("doc_id").eqNullSafe(F.col("_velith_doc")) & (F.xxhash64(text) == F.col("_velith_hash")), "left")
    out = joined.withColumn(text_col, F.when(found.isNull(), text).otherwise(_without(text, found))).filter(found.isNull() | text.rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found.isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
