"""Quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled 1; the unlabelled set is drawn from all training documents whatever
their label.  With class prior pi the non-negative risk

    pi * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi * E_P[l(g, -1)])

is minimised for a linear scorer over whole-text features (logistic loss, Adam; where the second part turns negative
its gradient is reversed, as the method asks).  pi is estimated from positives and unlabelled documents alone: a first
scorer (pi one half) ranks rows that it hasn't seen, and since the share of unlabelled rows above any margin is at least pi
times the share of positives above it, pi is the least ratio of the two, with an allowance for the sizes of the samples.
Scores are then calibrated on labelled training documents, by margins from scorers that haven't seen them (five folds): a
rising step function of the margin, with a tenth of a logistic fit so that ranks stay.

Training reads at most ``sample`` positives and ``sample`` unlabelled and ``sample`` calibration documents, by hash of
the id: the sample bound is the parameter, everything else sees every document.

Features of a whole text: root shares of each byte; shares of words equal to the word before, of lone marks, of distinct
words that end in two marks, of distinct shouted words, each plain and saturating at an eighth; the share of words met
before; the log of the length.  doc_id, lang and source are no features.

Defined cases: null texts are empty texts and have a score; repeated rows are scored each; without any positive label or
any unlabelled text every score is one half; labels other than 0 and 1, null labels and null ids are ignored in training; an
empty table gives an empty result; very long texts are read whole, in time proportional to their length; columns other
than doc_id, text and quality are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm.common import held_out, slices

WIDTH = 256 + 10
FOLDS = 5


def features(texts: list[str | None]) -> np.ndarray:
    """float64 features, one row a text."""
    out = np.zeros((len(texts), WIDTH))
    for row, text in zip(out, texts, strict=True):
        data = (text or "").encode("utf-8", "replace")
        if not data:
            continue
        row[:256] = np.sqrt(np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data))
        words = data.split()
        n = max(1, len(words))
        distinct = Counter(words)
        marks = [w for w in distinct if len(w) < 4 and w.isascii() and not any(48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 for c in w)]
        odd = [w for w in distinct if len(w) > 2 and w[-1] < 128 and w[-2] < 128 and not w[-2:].isalnum() and not chr(w[-2]).isalnum()]
        shares = (
            sum(a == b for a, b in pairwise(words)) / n,
            sum(distinct[w] for w in marks) / n,
            len(odd) / max(1, len(distinct)),
            sum(len(w) > 2 and w.isupper() for w in distinct) / max(1, len(distinct)),
        )
        row[256:260] = shares
        row[260:264] = [min(1.0, 8 * x) for x in shares]
        row[264] = 1 - len(distinct) / n
        row[265] = np.log1p(len(words)) / 10
    return out


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float
    prior: float
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.margin(x)
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))
        return smooth if self.knots is None else 0.9 * np.interp(margin, *self.knots) + 0.1 * smooth


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function closest to y, straight lines between its steps (pool adjacent violators)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first margin, last margin
    for at, value in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([value, 1, at, at])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            total, count, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
            blocks[-1][3] = last
    at = [x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    value = [b[0] / b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(at), np.array(value)


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, rate: float, decay: float) -> Model:
    """The linear scorer of least non-negative risk, uncalibrated."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    p, u = ((np.c_[(x - mean) / scale, np.ones(len(x))]) for x in (positive, unlabelled))
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        low = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        negative = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        grad = -prior * (p.T @ sigmoid(-gp)) / len(p) + negative if low >= 0 else -negative
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(w, mean, scale, 1.0, 0.0, prior)


Rows = tuple[np.ndarray, np.ndarray]  # features, and the fold of each row


def class_prior(positive: Rows, unlabelled: Rows, steps: int = 100, rate: float = 0.05, decay: float = 1e-2, least: int = 20) -> float:
    """Share of positives among the unlabelled rows, from margins of scorers that haven't seen the rows (two halves)."""
    (p, p_fold), (u, u_fold) = positive, unlabelled
    if len(p) < least or len(u) < least:
        return 0.5
    zp, zu = np.zeros(len(p)), np.zeros(len(u))
    for half in (0, 1):
        own_p, own_u = p_fold % 2 != half, u_fold % 2 != half
        if not own_p.any() or not own_u.any():
            return 0.5
        scorer = minimise(p[own_p], u[own_u], 0.5, steps, rate, decay)
        zp[~own_p], zu[~own_u] = scorer.margin(p[~own_p]), scorer.margin(u[~own_u])
    zp, zu = np.sort(zp), np.sort(zu)
    share_p = 1 - np.arange(len(zp)) / len(zp)
    share_u = 1 - np.searchsorted(zu, zp, side="left") / len(zu)
    doubt = np.sqrt(np.log(40) / 2 / len(zp)) + np.sqrt(np.log(40) / 2 / len(zu))
    best = int(np.argmin((share_u + doubt) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def fit(positive: Rows, unlabelled: Rows, known: Rows, quality: np.ndarray, prior: float | None = None, steps: int = 300, rate: float = 0.05, decay: float = 1e-2) -> Model:
    """nnPU risk minimisation, then calibration on ``known`` rows of either label.

    A known row's margin for calibration comes from a scorer that has not seen the rows of its fold, so that few training
    rows, which a scorer fits too well, don't move the scores of new ones.
    """
    (p, p_fold), (u, u_fold), (k, k_fold) = positive, unlabelled, known
    if prior is None:
        prior = class_prior(positive, unlabelled)
    if not len(p) or not len(u):
        logit = float(np.log(prior / (1 - prior)))
        return Model(np.zeros(WIDTH + 1), np.zeros(WIDTH), np.ones(WIDTH), 0.0, logit, prior)
    model = minimise(p, u, prior, steps, rate, decay)
    if len(np.unique(quality)) == 2:
        margin = model.margin(k)
        for fold in np.unique(k_fold):
            own_p, own_u = p[p_fold != fold], u[u_fold != fold]
            if len(own_p) and len(own_u):
                margin[k_fold == fold] = minimise(own_p, own_u, prior, steps, rate, decay).margin(k[k_fold == fold])
        model.slope, model.offset = platt(margin, quality)
        model.knots = isotonic(margin, quality.astype(float))
    return model


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps, with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = margin / max(1e-9, float(np.abs(margin).max()))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((q - target) * z).sum() + 1e-3 * a, (q - target).sum()])
        r = q * (1 - q)
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a / max(1e-9, float(np.abs(margin).max()))), float(b)


def _rows(docs: DataFrame, ids: DataFrame) -> dict[int, np.ndarray]:
    """Features of the documents in ``ids`` (a bounded sample), by id."""

    def run(batches):
        for batch in slices(batches, 256):
            x = features(batch.column(1).to_pylist()).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id", "left_semi")
    return {r["id"]: np.frombuffer(r["x"], "<f4").astype(np.float64) for r in wanted.mapInArrow(run, "id long, x binary").collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    """Fit on training documents only (crc32 of the id modulo 5 is not 0)."""
    order = lambda df: df.orderBy(F.xxhash64("id"), "id").limit(sample)
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).filter(~held_out("id") & F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y"))
    positive = {r["id"] for r in order(marked.filter("y = 1")).collect()}
    known = {r["id"]: r["y"] for y in (0, 1) for r in order(marked.filter(f"y = {y}")).limit(sample // 2).collect()}
    unlabelled = {r["id"] for r in order(docs.select(F.col("doc_id").cast("long").alias("id")).filter(~held_out("id"))).collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted(positive | unlabelled | known.keys())], "id long")
    x = _rows(docs, ids)

    def pick(which) -> Rows:
        own = [i for i in sorted(which) if i in x]
        return np.array([x[i] for i in own]).reshape(-1, WIDTH), np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in own], np.int64)

    y = np.array([known[i] for i in sorted(known) if i in x])
    return fit(pick(positive), pick(unlabelled), pick(known), y)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in slices(batches, 256):
            s = model.score(features(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, 256):
            yield batch.filter(pa.array(model.score(features(batch.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
