"""Secret scan: base rules, and a character convolutional network over every candidate in its context.

Candidates are what the base rules match, what they match and then drop, and every other token of 16 and more characters
of the secrets' alphabet that holds a digit.  Each candidate is read with 24 characters before and after it (a candidate
longer than 48 shows its first and last 24) as characters of a small alphabet; the network embeds them, convolves with
filters of width 5, keeps each filter's maximum and weighs the maxima.  It is trained here, in numpy, on labelled findings:

* positive: findings of the base rules in training documents, the same secrets moved into other documents' plain
  contexts, and made-up keys of other makers' shapes in such contexts;
* negative: matches that the rules drop, other long tokens (but those that mix upper case, lower case and digits: they may
  be what the scan is to find), and made-up numbers, addresses, paths, dates and words.

A logistic fit turns outputs into probabilities.  The threshold is the highest that still finds ``recall`` of the
positives held back from training.  Candidates above it that overlap no base finding are added as kind ``cnn``; findings
of the base rules are always kept.

Training reads a bounded sample, and only that: at most ``sample`` documents with a candidate, by hash of the id; of each at
most ``per_doc`` findings and ``per_doc`` other candidates, by hash of id and place; one plain context of ``context``
characters, at a place by hash; of all these at most ``most`` findings, moved findings and others each, by the same hash, and
``made_up`` invented ones of either kind.  All of them are parameters.  The scan reads every whole text.

Defined cases: a null text is the empty text; without a candidate there are no spans and the digest of the empty
string; repeated rows are scanned each; with no finding to learn from, made-up ones alone are used; an empty table gives an
empty result; very long texts are scanned whole, their candidates in blocks of 1,024; columns other than doc_id and text
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm.common import slices
from velith.llm.quality import platt

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
DOUBTFUL = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")
AROUND, INNER = 24, 48
WIDTH = 2 * AROUND + INNER
ALPHABET = "\0 \nabcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:;,\"'@#$%&*!?()[]{}<>|\\~^`"
_CODE = {c: k for k, c in enumerate(ALPHABET)}
OTHER = len(ALPHABET)
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(findings, dropped matches) of the base rules."""
    found, dropped = [], []
    for m in ASSIGN.finditer(text):
        (found if m.end(2) - m.start(2) >= 6 else dropped).append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found), dropped


def other_candidates(text: str, base: list[Span]) -> list[Span]:
    """Long tokens with a digit that overlap no finding."""
    out, k = [], 0
    for m in LONG.finditer(text):
        if DIGIT.search(m[0]) is None:
            continue
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        if not any(s < m.end() and e > m.start() for s, _, e in base[k : k + 4]) and not any(s < m.end() and e > m.start() for s, _, e in base[max(0, k - 4) : k]):
            out.append((m.start(), 3, m.end()))
    return out


def window(text: str, start: int, end: int) -> str:
    """WIDTH characters: context, candidate (its two ends if it is long), context; short ones are padded inside."""
    own = text[start:end]
    if len(own) > INNER:
        own = own[: INNER // 2] + own[-(INNER // 2) :]
    return text[max(0, start - AROUND) : start].rjust(AROUND, "\0") + own.ljust(INNER, "\0") + text[end : end + AROUND].ljust(AROUND, "\0")


def encode(windows: list[str]) -> np.ndarray:
    return np.array([[_CODE.get(c, OTHER) for c in w] for w in windows], np.int64).reshape(-1, WIDTH)


@dataclass
class Net:
    """embedding (symbols x e), filters (5e x f), filter bias, output weights and bias; logistic fit and threshold."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, rng: np.random.Generator, e: int = 8, f: int = 32) -> Net:
        return cls(rng.normal(0, 0.3, (OTHER + 1, e)), rng.normal(0, (2 / (5 * e)) ** 0.5, (5 * e, f)), np.zeros(f), rng.normal(0, 0.3, f), 0.0)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        return np.concatenate([e[:, k : WIDTH - 4 + k] for k in range(5)], axis=2)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        columns = self._columns(x)
        act = columns @ self.filters + self.bias
        at = act.argmax(axis=1)
        top = np.maximum(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0], 0)
        return top @ self.out + self.out_bias, top, at, columns

    def probability(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[k : k + 256])[0] for k in range(0, len(x), 256)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted logistic loss."""
        z, top, at, columns = self.forward(x)
        dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        dtop = dz[:, None] * self.out * (top > 0)
        chosen = columns[np.arange(len(x))[:, None], at]  # n x f x 5e
        dfilters = np.einsum("nf,nfd->df", dtop, chosen)
        dcolumn = dtop[:, :, None] * self.filters.T[None]
        dembed, e = np.zeros_like(self.embed), self.embed.shape[1]
        for k in range(5):
            np.add.at(dembed, x[np.arange(len(x))[:, None], at + k], dcolumn[:, :, k * e : (k + 1) * e])
        return [dembed, dfilters, dtop.sum(axis=0), top.T @ dz, np.array(dz.sum())]


def fit(x: np.ndarray, y: np.ndarray, recall: float, seed: int = 11, epochs: int = 12, rate: float = 0.01) -> Net:
    """Adam on four fifths of the rows; logistic fit and recall-constrained threshold on the last fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = len(x) * 4 // 5
    train, hold = order[:cut], order[cut:]
    net = Net.fresh(rng)
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    names = ["embed", "filters", "bias", "out", "out_bias"]
    m, v, t = [0.0] * 5, [0.0] * 5, 0
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 64):
            part, t = train[k : k + 64], t + 1
            for i, (name, g) in enumerate(zip(names, net.step(x[part], y[part], weight[part]), strict=True)):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                setattr(net, name, getattr(net, name) - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8))
    z = np.concatenate([net.forward(x[hold[k : k + 256]])[0] for k in range(0, len(hold), 256)])
    net.slope, net.offset = platt(z, y[hold].astype(float))
    p = net.probability(x[hold])
    good = np.sort(p[y[hold] == 1])
    net.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5
    return net


def _made_up(rng: np.random.Generator, n: int, contexts: list[str]) -> tuple[list[str], list[str]]:
    """(positive, negative) windows of invented tokens in plain contexts."""
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = low + up + digits

    def placed(token: str) -> str:
        text = contexts[rng.integers(len(contexts))]
        at = text.find(" ", rng.integers(max(1, len(text)))) + 1
        lead = rng.choice(["", "", "key ", "Authorization: Bearer ", "id ", "see "])
        text = f"{text[:at]}{lead}{token} {text[at:]}"
        start = at + len(lead)
        return window(text, start, start + len(token))

    secret = [lambda: f"ghp_{pick(every, 36)}", lambda: pick(every + "+/", int(rng.integers(24, 44))), lambda: f"sk_live_{pick(every, 24)}", lambda: f"xoxb-{pick(digits, 12)}-{pick(every, 24)}",
              lambda: f"eyJ{pick(every, 30)}", lambda: pick("0123456789abcdef", int(rng.choice([24, 32, 40]))), lambda: f"AKIA{pick(up + digits, 16)}"]
    harmless = [lambda: pick(digits, int(rng.integers(16, 22))), lambda: f"2024-{pick('01', 2)}-{pick('012', 2)}-{pick(low, 8)}", lambda: f"{pick(low, 9)}/{pick(low, 7)}/{pick(digits, 3)}", lambda: pick(low, 18) + pick(digits, 1),
                lambda: f"{pick(low, 7)}_{pick(low, 8)}_{pick(digits, 2)}", lambda: "-".join([pick(digits, 4)] * 4), lambda: pick("=-_", 20) + "1", lambda: f"{pick(low, 6)}-{pick(low, 7)}-{pick(low, 5)}-{pick(digits, 2)}"]
    return [placed(secret[k % len(secret)]()) for k in range(n)], [placed(harmless[k % len(harmless)]()) for k in range(n)]


def _draw(place: str) -> int:
    return xxhash.xxh3_64_intdigest(place) >> 1


def labelled(docs: DataFrame, sample: int, per_doc: int, context: int) -> list[tuple[int, int, str, str]]:
    """(draw, y, window, token) of the sample in the order of their draws: y 1 findings, 0 other candidates, 2 plain contexts."""

    def run(batches):
        for batch in slices(batches, 256):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base, dropped = base_spans(text)
                other = dropped + [x for x in other_candidates(text, base) if not DOUBTFUL.match(text, x[0], x[2])]
                rows = []
                for y, spans in ((1, base), (0, other)):
                    drawn = sorted((_draw(f"{doc}:{s}:{k}"), s, e) for s, k, e in spans)[:per_doc]
                    rows += [(h, y, window(text, s, e), text[s:e][:INNER] if y else "") for h, s, e in drawn]
                h = _draw(f"{doc}")
                at = h % max(1, len(text) - context + 1)
                rows.append((h, 2, text[at : at + context], ""))
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["h", "y", "w", "token"])

    hint = r"[A-Za-z0-9+/_=-]{16,}|AKIA|(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]"
    some = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.col("text").rlike(hint)).select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(some), "id", "left_semi")
    return sorted(tuple(r) for r in wanted.mapInArrow(run, "h long, y int, w string, token string").collect())


def train(docs: DataFrame, sample: int = 2000, recall: float = 0.98, made_up: int = 700, seed: int = 11, per_doc: int = 4, context: int = 400, most: int = 1400) -> Net:
    """Labelled windows of a bounded sample of documents with candidates, then :func:`fit`."""
    found = labelled(docs, sample, per_doc, context)
    rng = np.random.default_rng(seed)
    contexts = [w for _, y, w, _ in found if y == 2] or ["plain words of a text without anything to hide in it, at all"]
    positive, negative = ([w for _, y, w, _ in found if y == wanted][:most] for wanted in (1, 0))
    moved = []
    for token in [t for _, y, _, t in found if y == 1][:most]:
        text = contexts[rng.integers(len(contexts))]
        at = text.find(" ", rng.integers(max(1, len(text)))) + 1
        moved.append(window(f"{text[:at]}{token} {text[at:]}", at, at + len(token)))
    good, bad = _made_up(rng, made_up, contexts)
    positive, negative = positive + moved + good, negative + bad
    return fit(encode(positive + negative), np.r_[np.ones(len(positive)), np.zeros(len(negative))], recall, seed)


def spans_of(texts: list[str], net: Net) -> tuple[list[list[Span]], list[int]]:
    """All spans of each text, ordered by start and kind, and how many base findings the network holds for secrets too."""
    spans, agreed, where = [], [0] * len(texts), []
    for k, text in enumerate(texts):
        base, dropped = base_spans(text)
        spans.append(base[:])
        where += [(k, x) for x in base] + [(k, (s, 3, e)) for s, _, e in dropped] + [(k, x) for x in other_candidates(text, base)]
    for at in range(0, len(where), 1024):
        part = where[at : at + 1024]
        p = net.probability(encode([window(texts[k], x[0], x[2]) for k, x in part]))
        for (k, x), q in zip(part, (p >= net.threshold).tolist(), strict=True):
            if q and x[1] < 3:
                agreed[k] += 1
            elif q:
                spans[k].append(x)
    return [sorted(x) for x in spans], agreed


def scan(docs: DataFrame, net: Net) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_cnn, n_agreed (base findings that the network finds too), base_sha256, spans."""

    def run(batches):
        for batch in slices(batches, 256):
            found, agreed = spans_of([t or "" for t in batch.column(1).to_pylist()], net)
            text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            counts = [[sum(k == kind for _, k, _ in f) for f in found] for kind in range(4)]
            digests = [hashlib.sha256(text([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            columns = [*(pa.array(c, pa.int64()) for c in (*counts, agreed)), pa.array(digests, pa.string()), pa.array([text(f) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "n_agreed", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_cnn long, n_agreed long, base_sha256 string, spans string")
