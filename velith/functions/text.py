"""Cleaning of raw page text, headings, tables, sentences and tokens."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from velith.functions import lexicon as lx


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(col(x), F.lit(lx.SPACES))


def lines(text: Column | str) -> Column:
    """Lines of a text, at any line end."""
    return F.split(col(text), lx.ANY_LINE_END)


def is_noise(line: Column | str) -> Column:
    """Page furniture: page numbers, publisher and site lines."""
    found = F.lit(False)
    for pattern in lx.NOISE_PATTERNS:
        found = found | col(line).rlike(pattern.replace(lx.WS, lx.SPACE))
    return found


def detect_section(line: Column | str) -> Column:
    """The normalised heading that a line is, else null; lines of more than 120 characters are none."""
    own = strip(line)
    found = []
    for pattern in (p.replace(lx.WS, lx.SPACE) for p in lx.SECTION_PATTERNS):
        label = strip(F.regexp_replace(F.regexp_extract(own, pattern, 1), rf"{lx.SPACE}+", " "))
        words = strip(F.regexp_extract(own, pattern, 2)) if re.compile(pattern.replace(lx.SPACE, " ")).groups > 1 else F.lit("")
        found.append(F.when(own.rlike(pattern), F.when(words == "", label).otherwise(F.concat(label, F.lit(" "), words))))
    return F.when(own.rlike(lx.HEADING_START) & (F.length(own) <= lx.MAX_HEADING), F.coalesce(*found))


def _furniture() -> str:
    """One pattern for whole noise lines with their line end, in a text whose lines end in \\n."""
    bodies = [p.replace("(?i)", "").removeprefix(f"^{lx.WS}*").removesuffix("$").replace(lx.WS, lx.LINE_SPACE) for p in lx.NOISE_PATTERNS]
    return rf"(?imd)^{lx.LINE_SPACE}*+(?:{'|'.join(bodies)})$\n?"


def _headings() -> str:
    """One pattern for a whole line that some heading pattern fits, not longer than a heading may be."""
    bodies = []
    for pattern in lx.SECTION_PATTERNS:
        body = pattern.replace("(?i)", "").removeprefix(f"^{lx.WS}*").removesuffix("$").replace(lx.WS, lx.LINE_SPACE)
        body = re.sub(r"\((?!\?)", "(?:", body)
        bodies.append(f"(?i:{body})" if pattern.startswith("(?i)") else body)
    return rf"(?md)^{lx.LINE_SPACE}*+(?={lx.HEADING_START[1:]})(?=.{{1,{lx.MAX_HEADING}}}?{lx.LINE_SPACE}*$)(?:{'|'.join(bodies)})$"


def without_noise(raw: Column | str) -> Column:
    """The text without page furniture, its lines ended by \\n: two patterns over the whole text, no list of lines."""
    return F.regexp_replace(F.regexp_replace(col(raw), lx.OTHER_LINE_END, "\n"), _furniture(), "")


def first_line(text: Column | str) -> Column:
    """What stands before a text's first line end."""
    return F.get(F.split(col(text), lx.ANY_LINE_END, 2), F.lit(0))


def clean_text(raw: Column | str) -> Column:
    """Without page furniture and trailing blanks; runs of blank lines and of blanks shortened."""
    bare = F.regexp_replace(without_noise(raw), rf"(?md){lx.LINE_SPACE}(?<!{lx.LINE_SPACE}{{2}}){lx.LINE_SPACE}*+$", "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def first_section(raw: Column | str) -> Column:
    """First heading among the lines that aren't furniture, else null."""
    return detect_section(F.regexp_extract(without_noise(raw), _headings(), 0))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it and in whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table_to_markdown(rows: Column | str) -> Column:
    """array<array<string>> as a Markdown table: null cells empty, empty rows dropped, short rows padded."""
    clean = F.transform(
        F.filter(col(rows), lambda r: r.isNotNull() & (F.size(r) > 0)),
        lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))),
    )
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def lines_of(kept: Column, width: Column) -> Column:
        rule = F.concat(F.lit("\n"), row(F.array_repeat(F.lit("---"), width)))
        return F.transform(kept, lambda r, i: F.concat(row(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))), F.when(i == 0, rule).otherwise("")))

    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    return _bound(kept, lambda k: _bound(F.array_max(F.transform(k, F.size)), lambda w: F.array_join(lines_of(k, w), "\n")))


def split_sentences(text: Column | str) -> Column:
    """Sentences of a text.

    A cut falls on white space between a mark and a capital, section sign or bracket.  After an abbreviation's full stop
    the white space becomes one blank instead; since pieces end where the text before a cut ends, looking back from the
    cut is all that gluing them again would do, and no fold over pieces is needed.  Cuts are first replaced by a character
    that texts don't have, so that abbreviations are looked for at cuts only and the split itself needs no pattern; a text
    that has it is cut by the pattern for both.  No piece is empty: each ends in a mark or starts behind a cut.
    """
    short = "|".join(re.escape(a) for a in sorted(lx.ABBREVIATIONS))
    own, cut = strip(text), rf"{lx.SPACE}+(?=[{lx.SENTENCE_STARTS}])"
    marked = F.regexp_replace(own, rf"(?<=[{lx.SENTENCE_MARKS}]){cut}", lx.CUT)
    pieces = F.split(F.regexp_replace(marked, rf"{lx.CUT}(?<=(?:{short})\.{lx.CUT})", " "), lx.CUT)
    glued = F.regexp_replace(own, rf"(?<=\.)(?<=(?:{short})\.){cut}", " ")
    other = F.split(glued, rf"(?<=[{lx.SENTENCE_MARKS}])(?<!(?:{short})\.){cut}")
    return F.when(own == "", F.array().cast("array<string>")).when(F.contains(own, F.lit(lx.CUT)), other).otherwise(pieces)


def words(text: Column | str) -> Column:
    """Tokens at white space."""
    return F.filter(F.split(col(text), rf"{lx.SPACE}+"), lambda x: x != "")


def count_tokens(text: Column | str) -> Column:
    """Number of tokens at white space; 0 for null and blank texts.

    Where blanks are the only white space, they are cut at without a pattern, which takes a fraction of the time.
    """
    own = col(text)
    has = lambda chars: reduce(lambda x, y: x | y, [F.contains(own, F.lit(c)) for c in chars])
    other = has([c for c in lx.SPACES if c < "\x7f" and c != " "]) | ((F.octet_length(own) > F.length(own)) & has([c for c in lx.SPACES if c > "\x7f"]))
    plain = F.size(F.array_remove(F.split(own, " "), ""))
    return F.coalesce(F.when(other, F.size(F.array_remove(F.split(own, rf"{lx.SPACE}+"), ""))).when(own.isNotNull(), plain), F.lit(0))


def is_term(t: Column) -> Column:
    """Whether a lower-cased word is searched for: no stopword, no single character but the section sign."""
    return ~t.isin(lx.STOPWORDS) & ((F.length(t) > 1) | (t == "§"))


def term_words(text: Column | str) -> Column:
    """The words that :func:`terms` lower-cases and sifts."""
    return F.regexp_extract_all(col(text), F.lit(lx.TERM), F.lit(0))


def terms(text: Column | str) -> Column:
    """Search terms: lower-cased, without stopwords and single characters other than the section sign."""
    return F.filter(F.transform(term_words(text), F.lower), is_term)
