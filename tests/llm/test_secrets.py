"""Base rules against a second writing of them, and what the network adds."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import regex

from velith.llm import secrets_scan as ss


def base(text):
    out = []
    for m in regex.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", regex.ASCII):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in regex.finditer(r"AKIA[A-Z0-9]+", text or ""):
        if len(m.group()) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in regex.finditer(r"[0-9a-f]+", text or ""):
        if len(m.group()) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    plain = ["the cat sat on a mat", "élan vital, naïve 😀 words", "1234567890123456789012 is a number", "see /usr/local/lib/python3/site-packages/x1", "2024-01-01-release-candidate-12"]
    out = []
    for k in range(150):
        parts = [plain[int(rng.integers(len(plain)))] for _ in range(3)]
        kind = k % 9
        secret = [
            lambda: f"PassWord: \"{pick('abcXYZ019', 8)}\"", lambda: "token = abc", lambda: f"AKIA{pick('ABC123', 16)}", lambda: "AKIA123", lambda: pick("0123456789abcdef", 40),
            lambda: pick("abcdef012", 20), lambda: f"ghp_{pick('abcdefGHIJ0123', 36)}", lambda: f"API_KEY='{pick('0123456789abcdef', 32)}'", lambda: "passwordsecret=token=abcdef",
        ][kind]()
        parts.insert(int(rng.integers(0, 4)), secret)
        out.append((k, " ".join(parts)))
    return [*out, (500, None), (501, ""), (502, "AKIA" + "B" * 200_000), (503, "secret=aaaaaa" * 2000), (0, out[0][1]), (None, "apikey:abcdef1"), (504, "ſecret=abcdefg toKen=abcdefg İ")]


def test_base_findings_and_digests(documents, rows):
    docs = documents(rows)
    found = ss.scan(docs, ss.train(docs, made_up=80)).collect()
    assert len(found) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(repr(i), base(t))
    for r in found:
        own = by[repr(r["doc_id"])]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in own) for k in ("assign:", "access:", "hex:"))
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("cnn:")] == own
        starts = [(int(x.split(":")[1]), ss.KINDS.index(x.split(":")[0])) for x in spans]
        assert starts == sorted(starts)
        assert r["n_cnn"] == len(spans) - len(own)


def test_network_finds_other_makers_keys_and_leaves_words_alone(spark):
    net = ss.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = np.random.default_rng(3)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = [f"the deploy of monday used {lead}{''.join(rng.choice(letters, 36))} and went well" for lead in ("ghp_", "", "sk_live_", "key ") for _ in range(25)]
    found, _ = ss.spans_of(keys, net)
    assert np.mean([any(k == 3 for _, k, _ in f) for f in found]) >= 0.85
    clean = ["see /usr/local/lib/python3/site-packages/x1 and 2024-01-01-release-candidate-12", "order 1234567890123456789 was paid"]
    assert all(not f for f in ss.spans_of(clean, net)[0])


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = ss.Net.fresh(rng, 3, 4)
    x, y, w = rng.integers(0, 20, (6, ss.WIDTH)), np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6)
    loss = lambda: float((w * (np.logaddexp(0, net.forward(x)[0]) - y * net.forward(x)[0])).mean())
    grads = net.step(x, y, w)
    for name, g in zip(["embed", "filters", "bias", "out"], grads, strict=False):
        value = getattr(net, name)
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]:
            old, eps = value[at], 1e-5
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            down = loss()
            value[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[at], abs=1e-6)


def test_nothing_to_learn_from(documents):
    docs = documents([(1, None), (2, "plain words")])
    assert [r["spans"] for r in ss.scan(docs, ss.train(docs, made_up=30)).collect()] == ["", ""]
    assert ss.scan(documents([]), ss.train(documents([]), made_up=30)).count() == 0


def test_spans_of_the_network_by_kind(spark):
    """Recall on keys planted in texts that training didn't see, and what it marks among harmless tokens, by kind."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = ss.train(docs.filter("doc_id % 2 = 0"))
    plain = [r["text"] for r in docs.filter("doc_id % 2 = 1 and length(text) > 400").orderBy("doc_id").limit(60).collect()]
    rng = np.random.default_rng(99)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    planted = {"ghp": lambda: f"ghp_{pick(low + up + digits, 34)}1a", "live": lambda: f"sk_live_{pick(low + up + digits, 22)}2B", "base64": lambda: pick(low + up + digits + "+/", 36) + "7q", "slack": lambda: f"xoxb-{pick(digits, 12)}-{pick(low + up + digits, 24)}"}
    harmless = {"path": lambda: f"{pick(low, 8)}/{pick(low, 9)}/{pick(digits, 3)}", "number": lambda: pick(digits, 18), "slug": lambda: f"{pick(low, 7)}-{pick(low, 8)}-{pick(digits, 2)}", "name": lambda: f"{pick(low, 9)}_{pick(low, 9)}_{pick(digits, 1)}"}
    marked = {}
    for kind, make in {**planted, **harmless}.items():
        texts, places = [], []
        for text in plain:
            at, token = text.find(" ", 150) + 1, make()
            texts.append(f"{text[:at]}{token} {text[at:]}")
            places.append((at, at + len(token)))
        spans, _ = ss.spans_of(texts, net)
        marked[kind] = sum(any(k == 3 and s < end and e > start for s, k, e in own) for own, (start, end) in zip(spans, places, strict=True)) / len(texts)
    assert all(marked[k] >= 0.9 for k in planted), marked
    assert all(marked[k] <= 0.1 for k in harmless), marked


def test_the_sample_is_drawn_by_hash(documents):
    docs = documents([(k, f"text {k} password = zzz{k:06d}abc and token = aaa{k:06d}xyz here " + "plain words " * 60) for k in range(40)])
    found = ss.labelled(docs, 30, 1, 50)
    assert [r[0] for r in found] == sorted(r[0] for r in found) and {r[1] for r in found} == {1, 2}
    tokens = [r[3] for r in found if r[1] == 1]
    assert len(tokens) == 30 and tokens != sorted(tokens)
    assert all(len(r[2]) == 50 for r in found if r[1] == 2) and len({r[2][:20] for r in found if r[1] == 2}) > 2
