"""Questions and answers: language, query variants, citations, refusals, cuts, confidence, JSON repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.text import col, strip, terms


def filled(x: Column | str) -> Column:
    """Null where the value is empty."""
    return F.when(col(x) != "", col(x))


def citation(title: Column | str, doc_id: Column | str, section: Column | str, page_start: Column | str, page_end: Column | str) -> Column:
    """'title, section, p. n' or 'pp. a-b'; the id where there is no title."""
    first, last = col(page_start), col(page_end)
    pages = F.when(last.isNull() | (last == first), F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.concat_ws(", ", F.coalesce(filled(title), col(doc_id)), filled(section), pages)


def cut_at_space(text: Column, size: Column) -> Column:
    """The first ``size`` characters, back to their last blank if they have one, with the cut mark."""
    return F.concat(F.regexp_replace(F.substring(text, F.lit(1), size), r"(?s) [^ ]*\z", ""), F.lit(lx.CUT_MARK))


def excerpt(text: Column | str, size: int = lx.EXCERPT) -> Column:
    own = F.coalesce(col(text), F.lit(""))
    return F.when(F.length(own) > size, cut_at_space(own, F.lit(size))).otherwise(own)


def preview(text: Column | str, size: int = lx.PREVIEW) -> Column:
    return F.when(F.length(col(text)) > size, F.concat(F.substring(col(text), 1, size), F.lit("…"))).otherwise(col(text))


def detect_language(text: Column | str) -> Column:
    """German or English, by the number of distinct markers; a tie is German if the text has one of its letters."""
    padded = F.concat(F.lit(" "), F.lower(col(text)), F.lit(" "))
    count = lambda marks: reduce(lambda x, y: x + y, [F.contains(padded, F.lit(m)).cast("int") for m in marks])
    german, english = count(lx.GERMAN_MARKERS), count(lx.ENGLISH_MARKERS)
    letters = padded.rlike("[" + "".join(lx.GERMAN_LETTERS) + "]")
    return F.when((german > english) | ((german == english) & letters), "German").otherwise("English")


def section_forms(text: Column | str) -> Column:
    """Word forms of section, article, paragraph and sentence replaced by their signs, wherever they stand."""
    return reduce(lambda x, form: F.regexp_replace(x, rf"(?iu){form[0]}", form[1].replace("$", r"\$")), lx.SECTION_FORMS, strip(text))


def without_frame(text: Column | str) -> Column:
    """Without question word and the auxiliaries after it, blanks and question marks at the ends."""
    frame = rf"(?iu)^(?:{lx.QUESTION_WORDS}){lx.SPACE}+(?:(?:{lx.FRAME_WORDS}){lx.SPACE}+)*"
    return F.regexp_replace(F.regexp_replace(strip(text), frame, ""), r"^[ ?]+|[ ?]+\z", "")


def expansions(text: Column | str, variants: int = lx.VARIANTS) -> Column:
    """Up to ``variants`` rewritings of a question, in order, none equal to it or to an earlier one but for case."""
    own = strip(text)
    forms, bare, keys = section_forms(text), without_frame(text), F.array_join(terms(own), " ")
    low = F.lower(own)
    a = F.when(forms != own, forms)
    b = F.when((bare != "") & (F.lower(bare) != F.regexp_replace(low, r"^[ ?]+|[ ?]+\z", "")), bare)
    c = F.when((keys != "") & (F.lower(keys) != low), keys)
    fresh = lambda x, *before: F.when(reduce(lambda p, q: p & ~F.lower(x).eqNullSafe(F.lower(q)), before, strip(x) != ""), x)
    return F.slice(F.array_compact(F.array(fresh(a, own), fresh(b, own, a), fresh(c, own, a, b))), 1, variants)


def extract_citations(answer: Column | str, sources: Column | str | int) -> Column:
    """Sorted distinct source numbers that brackets start with and that exist."""
    most = F.lit(sources) if isinstance(sources, int) else col(sources)
    numbers = F.regexp_extract_all(col(answer), F.lit(lx.CITED.replace(lx.WS, lx.SPACE)), F.lit(1)).try_cast("array<int>")
    return F.sort_array(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= most))))


def is_refusal(answer: Column | str) -> Column:
    low = F.lower(col(answer))
    return reduce(lambda x, y: x | y, [F.contains(low, F.lit(m)) for m in lx.REFUSALS])


def strip_citations(answer: Column | str) -> Column:
    """Without [n] marks; brackets with more in them stay."""
    return strip(F.regexp_replace(col(answer), r"\[\d+\]", ""))


def claims(answer: Column | str, least: int = 15) -> Column:
    """Sentences of an answer of more than ``least`` characters, citations taken out."""
    parts = F.transform(F.split(strip_citations(answer), rf"(?<=[.!?]){lx.SPACE}+"), strip)
    return F.filter(parts, lambda x: F.length(x) > least)


def repaired_json(text: Column | str) -> Column:
    """The JSON value in a text as a string: the text itself, or what its outermost brackets hold; null if neither parses."""
    own = strip(text)
    inner = F.regexp_extract(own, r"(?s)[{\[].*[}\]]", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    return F.when(valid(own), own).when(valid(inner), inner)


def confidence(mode: Column | str, dense: Column | str, sparse: Column | str, both: Column | str, results: Column | str) -> Column:
    """0 to 1: strength of the best score and, in hybrid mode, the share of results that both retrievers found.

    dense and sparse are the best scores among the final results (null if none), both counts results with both ranks.
    """
    top_dense, top_sparse, n = col(dense), col(sparse), col(results)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (top_dense - lx.DENSE_FLOOR) / lx.DENSE_BAND))
    halved = F.when(top_sparse > 0, top_sparse / (top_sparse + lx.SPARSE_HALF)).otherwise(0.0)
    strength = F.when(top_dense.isNotNull(), scaled).otherwise(halved)
    agreement = col(both) / F.when(n > 0, n)
    score = F.when(col(mode) == "hybrid", lx.STRENGTH_SHARE * strength + lx.AGREEMENT_SHARE * agreement).otherwise(strength)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.round(score, 4))


def refused(confidence_: Column | str, results: Column | str, below: float = lx.REFUSE_BELOW) -> Column:
    """Too little found to answer."""
    return (F.coalesce(col(results), F.lit(0)) == 0) | (col(confidence_) < below)


STRATEGIES, MODES = ("fixed", "sentence", "semantic"), ("dense", "sparse", "hybrid")


def request_error(question: Column | str, session_id: Column | str, mode: Column | str, strategy: Column | str, top_k: Column | str) -> Column:
    """What is wrong with a request, else null; optional parts may be null."""
    size = F.length(col(question))
    bad = F.when(size.isNull() | (size < 3) | (size > 1000), "question length").when(strip(question) == "", "question blank")
    bad = bad.when(F.length(col(session_id)) > 128, "session_id length").when(~col(mode).isin(*MODES), "mode")
    return bad.when(~col(strategy).isin(*STRATEGIES), "strategy").when((col(top_k) < 1) | (col(top_k) > 20), "top_k")
