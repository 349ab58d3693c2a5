"""Byte-level BPE ids by the tokenizers library, with a bounded memo over pre-tokens.

The library cuts a text into pre-tokens before it merges, so the ids of a text are those of its pre-tokens in turn.
Each worker keeps the ids of pre-tokens it has met in two generations of bounded size; what neither holds goes to the
library.  Texts with characters outside the range in which the cut below was compared with the library's own, or
with an added token's string in them, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼½¾"
_S = r"\t-\r\x1c-\x20\x85\xa0"
#: Library's white space has no \x1c-\x1f, so texts with them, or with anything past the ranges here, take the slow way.
OTHER = re.compile(r"[^\t-\r\x20-\x7e\x85\xa0-ɏ‐-‧‰-⁞€]")
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _printable() -> dict[int, str]:
    """The public byte alphabet of byte-level BPE: printable bytes stand for themselves, others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_PRINTABLE = _printable()


class ByteBpe:
    """One loaded tokenizer file of the kind with a byte-level pre-tokenizer; other kinds are run over whole texts."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        pre = setup.get("pre_tokenizer") or {}
        self.plain = setup.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = [re.escape(t["content"]) for t in setup.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, segments: list[str]) -> list[bytes]:
        """Pre-tokens straight to the library's merge model, which takes each byte as one printable character."""
        tokenize, table = self.lib.model.tokenize, _PRINTABLE
        return [array("I", [t.id for t in tokenize(s.encode().decode("latin-1").translate(table))]).tobytes() for s in segments]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text the ids as little-endian uint32 bytes, without special tokens."""
        whole = [not self.plain or OTHER.search(t) is not None or (self.added is not None and self.added.search(t) is not None) for t in texts]
        cuts = [[] if w else CUT.findall(t) for t, w in zip(texts, whole, strict=True)]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, met = self.young, self.old, set()
        for cut in cuts:
            met.update(cut)
        new = []
        for s in met.difference(young):
            if (known := old.get(s)) is not None:
                young[s] = known
            else:
                new.append(s)
        if new:
            young.update(zip(new, self._pieces(new), strict=True))
        slow = iter(self._library([t for t, w in zip(texts, whole, strict=True) if w]))
        return [next(slow) if w else b"".join(map(young.__getitem__, cut)) for w, cut in zip(whole, cuts, strict=True)]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """Loaded once per Python worker."""
    return ByteBpe(path)
