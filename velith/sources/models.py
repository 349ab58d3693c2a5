"""Seams for models: encoder, generator and judge, with deterministic stand-ins that need no network.

A real model is a function on a pandas series that is loaded once a worker; everything around it stays the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType

from velith.functions.text import split_sentences

Texts = Iterator[pd.Series]


def hash_encode(texts: list[str], dimension: int = 384) -> np.ndarray:
    """Unit vectors of signed word hashes; a text without a word is the zero vector."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", text.lower()):
            h = xxhash.xxh3_64_intdigest(word)
            row[(h >> 1) % dimension] += 1.0 if h & 1 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, prefix: str = "", dimension: int = 384) -> Callable[[Column], Column]:
    """A column function text -> array<float>; ``load`` makes the model, once a worker and task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Texts) -> Texts:
        model = load() if load else lambda texts: hash_encode(texts, dimension)
        for texts in batches:
            yield pd.Series(list(model([prefix + (t or "") for t in texts])))

    return encode


def token_counter(path: str) -> Callable[[Column], Column]:
    """A column function text -> number of tokens by a tokenizer file (the tokenizers library's JSON), loaded once a worker and task."""

    @F.pandas_udf(IntegerType())
    def count(batches: Texts) -> Texts:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in batches:
            yield pd.Series([len(x.ids) for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)], dtype="int32")

    return count


def first_sentences(prompt: str) -> str:
    """Stand-in for a language model: the first sentence of each of the first two sources in the prompt, cited."""
    sources = re.findall(r"^\[(\d+)\] .*?\n(.*?)(?=\n\n|\Z)", prompt, re.MULTILINE | re.DOTALL)[:2]
    return " ".join(f"{re.split(r'(?<=[.!?])\s', text.strip())[0]} [{n}]" for n, text in sources) or "I don't know."


def generator(load: Callable[[], Callable[[str], str]] | None = None) -> Callable[[Column], Column]:
    """A column function prompt -> completion."""

    @F.pandas_udf(StringType())
    def generate(batches: Texts) -> Texts:
        model = load() if load else first_sentences
        for prompts in batches:
            yield prompts.map(lambda p: None if p is None else model(p))

    return generate


def resolve_model(installed: list[str], wanted: str, fallback: str) -> str:
    """The installed model of this name or base name (before ':'), else the fallback, else the first."""
    if not installed:
        raise ValueError("no model is installed")
    for name in (wanted, fallback):
        for candidate in installed:
            if candidate == name or candidate.split(":")[0] == name.split(":")[0]:
                return candidate
    return installed[0]


def overlap_judge(claim: Column, context: Column, least: float = 0.5) -> Column:
    """Stand-in for a judge: whether at least that share of the claim's words stands in the context; null without words."""
    own, there = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))) for x in (claim, context))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, there)) >= least * F.size(own))


def recall_judge(truth: Column, context: Column, least: float = 0.5) -> Column:
    """Stand-in: struct of the sentences of a ground truth that the context holds (``overlap_judge``) and of all of them."""
    own = split_sentences(truth)
    held = F.filter(own, lambda s: F.coalesce(overlap_judge(s, context, least), F.lit(False)))
    return F.struct(F.size(held).alias("attributable"), F.size(own).alias("total"))


def tokens_per_second(tokens: Column, latency_ms: Column) -> Column:
    """Throughput of a completion; 0 where no time is known."""
    return F.when(latency_ms > 0, F.round(tokens * 1000.0 / latency_ms, 2)).otherwise(0.0)
