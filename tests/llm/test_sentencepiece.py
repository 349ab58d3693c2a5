"""Ids and decoding against the library, spans against the source bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from velith.llm import sentencepiece_codec as sc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world", "", " ", "  two  blanks \n\n\ttabs\r\n", "naïve café — “quotes” ½ ﬁ Ａ", "😀👩‍👩‍👧 你好 العربية", "▁ mark ▁▁", "<s> </s> <unk> <0x41>", "é é ​ x", "\x00\x01 control", "a" * 3000, "word " * 50_000, "�\U0010ffff"]


def test_query_equals_the_library(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(TEXTS), (100, None), (0, TEXTS[0]), (None, "null id")]
    got = {}
    for r in sc.round_trip(documents(rows), MODEL).collect():
        got.setdefault(repr(r["doc_id"]), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        ids = [library.bos_id(), *library.encode(t or ""), library.eos_id()]
        for r in got[repr(i)]:
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
            assert r["aligned"]


def test_spans_cover_their_pieces(documents):
    rows = list(enumerate(TEXTS[:11]))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = sc.encode(documents(rows), MODEL)
    for r in encoded.collect():
        data, mark = TEXTS[r["doc_id"]].encode(), "▁".encode()
        prefix = mark  # the first piece starts with the mark that the library puts before every text
        for k, a, b in zip(r["ids"], r["begins"], r["ends"], strict=True):
            piece = library.id_to_piece(k)
            if library.is_control(k):
                assert a == b
            elif not library.is_byte(k) and not library.is_unknown(k):
                assert prefix + data[a:b].replace(b" ", mark) == piece.encode()
            if not library.is_control(k):
                prefix = b""
    back = {r["doc_id"]: r["text"] for r in sc.decode(encoded, MODEL).collect()}
    assert back == {i: library.decode(library.encode(t)) for i, t in rows}


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisation_equals_the_library(rule):
    """The compiled character map of the library's own rules, walked by longest prefix."""
    options = {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    spec = sc.NormalizerSpec(library.serialized_model_proto()) if hasattr(library, "serialized_model_proto") else None
    if spec is None:
        pytest.skip("this build doesn't hand out the compiled map")
    spec = sc.NormalizerSpec.of_model(library.serialized_model_proto())
    charsmap = sc.CharsMap(spec.charsmap)
    for text in [*TEXTS[:11], "①②③ ㌔ ｶﾞ ﷺ", "ABC İstanbul ẞ"]:
        normal, align = sc.normalize(text, spec, charsmap)
        assert normal.decode() == library.normalize(text)
        assert len(align) == len(normal) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_empty_table(documents):
    assert sc.round_trip(documents([]), MODEL).count() == 0
