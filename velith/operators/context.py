"""What a language model is given: conversation memory, sources within a budget, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.answers import cut_at_space, detect_language
from velith.functions.text import col


def remembered(turns: DataFrame, keys: list[str], order: list[str], count: int = lx.MEMORY_TURNS) -> DataFrame:
    """The last ``count`` turns of each session that weren't refused, with ``turn_rank`` 1 for the latest."""
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return turns.filter(~F.coalesce("refused", F.lit(False))).withColumn("turn_rank", F.row_number().over(last)).filter(F.col("turn_rank") <= count)


def within_budget(texts: Column | str, budget: int = lx.CONTEXT, least: int = lx.LEAST_CONTEXT) -> Column:
    """The texts that fit a budget of characters, in order; the one that overflows is cut at a blank.

    A text that overflows when fewer than ``least`` characters are left ends the list.  Lengths are folded, texts are
    not copied but for the last.
    """
    own = F.transform(col(texts), lambda t: F.coalesce(t, F.lit("")))
    none = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), none.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        left = budget - acc["used"]
        fits = F.length(t) <= left
        cut = cut_at_space(t, left)
        kept = F.when(fits, t).otherwise(cut)
        ended = acc["over"] | (~fits & (left < least))
        return F.when(ended, F.struct(acc["used"].alias("used"), F.lit(True).alias("over"), acc["out"].alias("out"))).otherwise(
            F.struct((acc["used"] + F.length(kept)).alias("used"), F.lit(False).alias("over"), F.array_append(acc["out"], kept).alias("out"))
        )

    return F.aggregate(own, state, step, lambda acc: acc["out"])


REFUSAL = {"German": "Ich weiß es nicht.", "English": "I don't know."}
RULES = (
    "Answer from the numbered sources only.",
    "Mark every statement with the number of its source in brackets, like [1].",
    "Name the section that a rule stands in where the source gives it.",
    "Do not cite a number that is not among the sources.",
    "Do not add what the sources do not say, and give no advice of your own.",
    "Say so where sources contradict one another.",
    "Keep to a few sentences.",
)


def system_prompt(question: Column | str, domain: str, language: str = "auto") -> Column:
    """Instructions in which language to answer, from what, and what to say when the sources don't tell."""
    found = detect_language(question) if language == "auto" else F.lit("German" if language.lower().startswith("de") else "English")
    refusal = F.when(found == "German", REFUSAL["German"]).otherwise(REFUSAL["English"])
    head = F.concat(F.lit(f"You answer questions about {domain} in "), found, F.lit(".\n"))
    rules = "\n".join(f"- {r}" for r in RULES)
    return F.concat(head, F.lit(f"{rules}\n- If the sources do not answer the question, say only: "), refusal)


def user_prompt(question: Column | str, citations: Column | str, texts: Column | str, history: Column | str | None = None, budget: int = lx.CONTEXT) -> Column:
    """Earlier turns, numbered sources within the budget, and the question last."""
    kept = within_budget(texts, budget)
    blocks = F.transform(kept, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(F.get(col(citations), i), F.lit("")), F.lit("\n"), t))
    past = F.lit("") if history is None else F.when(F.size(col(history)) > 0, F.concat(F.lit("Earlier:\n"), F.array_join(F.transform(col(history), lambda h: F.concat(F.lit("Q: "), h["question"], F.lit("\nA: "), h["answer"])), "\n"), F.lit("\n\n"))).otherwise("")
    return F.concat(past, F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), col(question))
