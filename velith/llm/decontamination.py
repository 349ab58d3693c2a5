"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A benchmark item becomes windows of ``window`` consecutive words (one shorter window if it has fewer words), a window
becomes its set of word shingles.  Containment of the whole window is asked for, so the prefix of a window that must
meet the document is one shingle; shingles are ordered by their document frequency over the whole corpus, so that one
is the rarest.  A document is probed with its own shingles against these prefix shingles; a meeting fixes where the
window would have to start, the length and positional bounds drop what cannot fit, and the words themselves are then
compared.  No pair of rows is ever shuffled: the benchmark travels to the documents.  Its size is measured first; beyond
``block_bytes`` of text it goes in blocks of that size, one pass over the documents each, with what earlier passes
found carried along in a written table.

Defined cases: null texts and texts without words have no words, no hits and the digest of the empty string; a
benchmark row without words or with a null id can't be named and is ignored; repeated ids count once; rows that
repeat a doc_id are scanned each on its own; an empty benchmark hits nothing; columns other than those named are not
looked at; very long texts are probed whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm.common import materialise, slices

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
Window = tuple[bytes, ...]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters and digits and of anything beyond ASCII, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_WORD).split()


class Windows:
    """The distinct windows of a block of items, and after :meth:`order` their prefix index."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int):
        self.shingle, self.items = shingle, sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        found: dict[Window, set[int]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                found.setdefault(tuple(words[k : k + size]), set()).add(number[item])
        self.windows = [(w, tuple(sorted(i))) for w, i in found.items()]
        self.index: dict[Window, list[tuple[int, int]]] = {}

    def shingles(self, window: Window) -> list[Window]:
        size = min(self.shingle, len(window))
        return [window[k : k + size] for k in range(len(window) - size + 1)]

    def all_shingles(self) -> set[Window]:
        return {s for w, _ in self.windows for s in self.shingles(w)}

    def order(self, frequency: dict[Window, int]) -> None:
        """Index each window under its rarest shingle with the offset of that; windows with an absent shingle go."""
        for k, (window, _) in enumerate(self.windows):
            keys = self.shingles(window)
            rarest = min(range(len(keys)), key=lambda i: (frequency.get(keys[i], 0), keys[i], i))
            if frequency.get(keys[rarest], 0):
                self.index.setdefault(keys[rarest], []).append((k, rarest))

    def probe(self, words: list[bytes], keys: dict[int, set[bytes]], wanted) -> list[tuple[int, Window]]:
        """(position, shingle) wherever a wanted shingle stands in the document."""
        out = []
        for size, firsts in keys.items():
            last = len(words) - size
            for i in [i for i, w in enumerate(words) if w in firsts]:
                if i <= last and (key := tuple(words[i : i + size])) in wanted:
                    out.append((i, key))
        return out

    def hits(self, words: list[bytes], keys: dict[int, set[bytes]]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges covered by verified windows, and the numbers of their items."""
        ranges, items, n = [], set(), len(words)
        for at, key in self.probe(words, keys, self.index):
            for k, offset in self.index[key]:
                window, of = self.windows[k]
                start = at - offset
                if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                    ranges.append((start, start + len(window)))
                    items.update(of)
        return ranges, items


def _keys(shingles) -> dict[int, set[bytes]]:
    """First words of the shingles, by shingle size."""
    out: dict[int, set[bytes]] = {}
    for s in shingles:
        out.setdefault(len(s), set()).add(s[0])
    return out


def _frequencies(docs: DataFrame, text_col: str, shared: Broadcast) -> dict[Window, int]:
    """Documents that hold each shingle of the benchmark, over all documents; the result is as small as the benchmark."""

    def run(batches):
        windows: Windows = shared.value
        wanted = sorted(windows.all_shingles())
        number, keys, total = {s: k for k, s in enumerate(wanted)}, _keys(wanted), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update({number[s] for _, s in windows.probe(words_of(text), keys, number)})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["shingle", "n"])

    wanted = sorted(shared.value.all_shingles())
    rows = docs.select(text_col).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {wanted[r["shingle"]]: r["n"] for r in rows}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, str | None]]]]:
    """(is last, items) of blocks of about ``block_bytes`` of text; a block is all that is held and sent at once."""
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield k == n - 1, [(r["item"], r["text"]) for r in part.collect()]


def _index(docs: DataFrame, text_col: str, items: list[tuple[str, str | None]], window: int, shingle: int) -> Broadcast:
    """The block's windows under their rarest shingles, sent to the executors."""
    context, windows = docs.sparkSession.sparkContext, Windows(items, window, shingle)
    plain = context.broadcast(windows)
    windows.order(_frequencies(docs, text_col, plain))
    plain.unpersist()
    return context.broadcast(windows)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 2, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: its id and RESULT."""
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("mask"), F.lit(None).cast("array<string>").alias("items"))

    def scan(shared: Broadcast, last: bool):
        def run(batches):
            windows: Windows = shared.value
            keys = _keys(windows.index)
            for batch in slices(batches, 512):
                rows = []
                for text, bits, known in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    words = words_of(text)
                    ranges, numbers = windows.hits(words, keys)
                    mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool) if bits else np.zeros(len(words) if ranges else 0, bool)
                    for a, b in ranges:
                        mask[a:b] = True
                    rows.append((len(words), mask, sorted({*(known or ()), *(windows.items[i] for i in numbers)})))
                if last:
                    columns = [[r[0] for r in rows], [int(r[1].sum()) for r in rows], [len(r[2]) for r in rows], [hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows], [bool(r[1].any()) for r in rows]]
                    kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)
                else:
                    found = [pa.array([np.packbits(r[1]).tobytes() if r[1].any() else None for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["id", "text", "mask", "items"])

        return run

    for last, items in _blocks(benchmark, item_col, text_col, block_bytes):
        shared = _index(docs, text_col, items, window, shingle)
        state = state.mapInArrow(scan(shared, last), f"{id_col} {kind}, {RESULT}" if last else state.schema)
        if not last:
            state = materialise(state, "contamination")
    return state


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 2, item_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    at, state = docs.columns.index(text_col), docs

    def clean(shared: Broadcast):
        def run(batches):
            windows: Windows = shared.value
            keys = _keys(windows.index)
            for batch in slices(batches, 512):
                yield batch.filter(pa.array([not windows.hits(words_of(t), keys)[0] for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    for last, items in _blocks(benchmark, item_col, text_col, block_bytes):
        state = state.mapInArrow(clean(_index(docs, text_col, items, window, shingle)), docs.schema)
        if not last:
            state = materialise(state, "decontaminated")
    return state
