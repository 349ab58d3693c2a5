"""SentencePiece encoding with source offsets, and decoding.

The model's compiled character map (a double-array trie followed by NUL-ended replacements) is walked by longest
prefix.  Each normalised byte remembers the source bytes it came from, so every piece can be projected back to a
byte span of the original text.  Segmentation and decoding are the library's, over
whole texts.

Defined cases: a null text is the empty text; an empty text gives only the begin and end ids and decodes to '';
repeated rows give repeated results; extra columns are left out of the result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from velith.llm.common import slices, texts_of

MARK = "▁"
MARK_BYTES = MARK.encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : (at := at + size)]
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : (at := at + size)]


class NormalizerSpec:
    """The normaliser's settings from a serialised model (field 3) or from a serialised spec."""

    def __init__(self, spec: bytes):
        found = dict(_fields(spec))
        self.charsmap = found.get(2, b"")
        self.add_dummy_prefix = bool(found.get(3, 1))
        self.remove_extra_whitespaces = bool(found.get(4, 1))
        self.escape_whitespaces = bool(found.get(5, 1))

    @classmethod
    def of_model(cls, model: bytes) -> NormalizerSpec:
        return cls(next((v for k, v in _fields(model) if k == 3), b""))


class CharsMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""

    def longest_prefix(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes consumed, replacement) of the longest entry that ``text[at:]`` starts with."""
        if not self.units:
            return None
        units, node, best = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.replacements.index(b"\0", best[1])
        return best[0], self.replacements[best[1] : end]


def normalize(text: str, spec: NormalizerSpec, charsmap: CharsMap) -> tuple[bytes, np.ndarray]:
    """The normalised text and, for each of its bytes and its end, the source byte it stands at."""
    source = text.encode("utf-8", "replace")
    if not charsmap.units and not spec.remove_extra_whitespaces:
        return _normalize_identity(source, spec)
    out, align = bytearray(), []
    space = MARK_BYTES if spec.escape_whitespaces else b" "
    at, end = 0, len(source)

    def step(at: int) -> tuple[int, bytes]:
        if (found := charsmap.longest_prefix(source, at)) is not None:
            return found
        lead = source[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, source[at : at + size]

    if spec.remove_extra_whitespaces:
        while at < end and (found := step(at))[1] == b" ":
            at += found[0]
    if at == end:
        return b"", np.array([end])
    if spec.add_dummy_prefix:
        out += space
        align += [at] * len(space)
    after_space = spec.remove_extra_whitespaces
    while at < end:
        size, piece = step(at)
        while after_space and piece.startswith(b" "):
            piece = piece[1:]
        for byte in piece:
            put = space if byte == 32 else bytes([byte])
            out += put
            align += [at] * len(put)
        if piece:
            after_space = spec.remove_extra_whitespaces and piece.endswith(b" ")
        at += size
    if spec.remove_extra_whitespaces:
        while out.endswith(space):
            del out[-len(space) :]
            end = align[len(out)]
            del align[len(out) :]
    return bytes(out), np.array([*align, end])


def _normalize_identity(source: bytes, spec: NormalizerSpec) -> tuple[bytes, np.ndarray]:
    """Vectorised case without a map: only blanks change, from one byte to the three of the word mark."""
    if not source:
        return b"", np.zeros(1, np.int64)
    space = MARK_BYTES if spec.escape_whitespaces else b" "
    wide = np.where(np.frombuffer(source, np.uint8) == 32, len(space), 1)
    align = np.repeat(np.arange(len(source)), wide)
    prefix = len(space) if spec.add_dummy_prefix else 0
    return (space if prefix else b"") + source.replace(b" ", space), np.concatenate([np.zeros(prefix, np.int64), align, [len(source)]])


class OffsetCodec:
    """One loaded model: ids exactly as the library's, byte spans of the original text, and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            blob = file.read()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.spec = NormalizerSpec.of_model(blob)
        self.charsmap = CharsMap(self.spec.charsmap)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(k) for k in range(size)]
        self.widths = np.array([1 if sp.is_byte(k) else 0 if sp.is_control(k) else len(p.encode()) for k, p in enumerate(pieces)], np.int64)
        self.bos, self.eos = (struct.pack("<I", k) if k >= 0 else b"" for k in (sp.bos_id(), sp.eos_id()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text the ids with begin and end, as little-endian uint32 bytes."""
        return [self.bos + np.array(x, "<u4").tobytes() + self.eos for x in self.sp.encode(texts, num_threads=1)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte in the original text of each id; begin, end and other control ids have empty spans."""
        normal, align = normalize(text, self.spec, self.charsmap)
        widths = self.widths[ids]
        if (unknown := ids == self.sp.unk_id()).any():  # without byte fallback an unknown piece takes what the others leave
            widths = self._unknown_widths(text, ids, unknown)
        ends = np.minimum(np.cumsum(widths), len(normal))
        return align[ends - widths], align[ends]

    def _unknown_widths(self, text: str, ids: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        proto = self.sp.encode(text, out_type="immutable_proto", add_bos=True, add_eos=True)
        return np.array([len(p.piece.encode()) if u else w for p, u, w in zip(proto.pieces, unknown, self.widths[ids], strict=True)])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=4)
def codec(path: str) -> OffsetCodec:
    """Loaded once per Python worker."""
    return OffsetCodec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, begins array<int>, ends array<int>): pieces with byte spans of the original text."""

    def run(batches):
        c = codec(model)
        for batch in slices(batches, 64):
            texts = texts_of(batch.column(1))
            ids = [np.frombuffer(x, "<u4") for x in c.encode(texts)]
            spans = [c.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            many = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], many), *(pa.array([s[k].astype(np.int32) for s in spans], many) for k in (0, 1))], names=[id_col, "ids", "begins", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of a table with an ``ids`` column, as the library decodes them; null ids give null."""

    def run(batches):
        c = codec(model)
        for batch in slices(batches, 64):
            ids = batch.column(1).to_pylist()
            out = iter(c.decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(out) for x in ids], pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, aligned boolean"


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with offsets and decode in one pass, returning digests instead of arrays that would cross to the JVM.

    n_bytes is the source length in UTF-8; aligned says that the spans tile it from first to last byte.
    """

    def run(batches):
        c = codec(model)
        for batch in slices(batches, 64):
            texts = texts_of(batch.column(1))
            raw = c.encode(texts)
            ids = [np.frombuffer(x, "<u4") for x in raw]
            decoded = c.decode([x.tolist() for x in ids])
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            aligned = []
            for text, x, size in zip(texts, ids, sizes, strict=True):
                begins, ends = c.spans(text, x)
                aligned.append(bool(begins[0] == 0 and ends[-1] == size and (begins[1:] == ends[:-1]).all()))
            columns = [[len(x) for x in ids], [hashlib.sha256(x).hexdigest() for x in raw], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in decoded], sizes, aligned]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "aligned"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {DIGEST}")
