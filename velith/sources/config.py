"""Settings: defaults, then a mapping (from YAML or JSON), then the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any, get_type_hints

from velith.functions import lexicon as lx

# Fixed values. Vector sizes of known encoders.
DIMENSIONS = {"intfloat/multilingual-e5-small": 384, "intfloat/multilingual-e5-base": 768, "intfloat/multilingual-e5-large": 1024}
TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Chunking:
    strategy: str = "sentence"
    fixed_tokens: int = lx.FIXED_TOKENS
    fixed_overlap: int = lx.FIXED_OVERLAP
    sentence_tokens: int = lx.SENTENCE_TOKENS
    sentence_overlap: int = lx.SENTENCE_OVERLAP
    semantic_tokens: int = lx.SEMANTIC_TOKENS
    semantic_percentile: float = lx.SEMANTIC_PERCENTILE
    semantic_sentences: int = lx.SEMANTIC_SENTENCES


@dataclass(frozen=True)
class Embedding:
    model: str = "intfloat/multilingual-e5-small"
    dimension: int = 384
    batch: int = 32
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "


@dataclass(frozen=True)
class Retrieval:
    mode: str = "hybrid"
    top_k: int = lx.TOP_K
    candidates: int = lx.CANDIDATES
    rrf_k: int = lx.RRF_K
    expand: bool = True
    variants: int = lx.VARIANTS
    metric: str = "cosine"


@dataclass(frozen=True)
class Answering:
    refuse_below: float = lx.REFUSE_BELOW
    context_chars: int = lx.CONTEXT
    memory_turns: int = lx.MEMORY_TURNS
    language: str = "auto"


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    answering: Answering = field(default_factory=Answering)


def coerce(value: Any, kind: Any) -> Any:
    """A setting's text as bool, int, float, list (at commas) or str; other values as they are."""
    if not isinstance(value, str):
        return kind(value) if kind in (int, float) and not isinstance(value, bool) else value
    if kind is bool:
        return value.strip().lower() in TRUE
    if kind in (int, float):
        return kind(value)
    if kind in (list, list[str]):
        return [x.strip() for x in value.split(",") if x.strip()]
    return value


def _overlay(section: Any, values: Mapping[str, Any]) -> Any:
    kinds = get_type_hints(type(section))
    known = {f.name for f in fields(section)}
    return replace(section, **{k: coerce(v, kinds[k]) for k, v in values.items() if k in known and v is not None})


def load(values: Mapping[str, Mapping[str, Any]] | None = None, environ: Mapping[str, str] | None = None, prefix: str = "VELITH") -> Config:
    """Environment (VELITH_RETRIEVAL_TOP_K) over values over defaults; a known model sets its own dimension."""
    environ = os.environ if environ is None else environ
    config = Config()
    for f in fields(config):
        section = getattr(config, f.name)
        if not is_dataclass(section):
            continue
        section = _overlay(section, (values or {}).get(f.name) or {})
        named = {x.name: environ[key] for x in fields(section) if (key := f"{prefix}_{f.name}_{x.name}".upper()) in environ}
        config = replace(config, **{f.name: _overlay(section, named)})
    if config.embedding.model in DIMENSIONS:
        config = replace(config, embedding=replace(config.embedding, dimension=DIMENSIONS[config.embedding.model]))
    return config
