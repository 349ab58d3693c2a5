"""Language identification in two steps: the family, then the language inside it.

A linear support vector machine per family (one against the rest) picks the family; within it one machine per pair of
languages votes (ties: the larger sum of margins, then the name).  Features are the root shares of hashed byte n-grams
(one to three bytes) of the whole lower-cased text, scaled to unit length.  Machines minimise squared hinge loss; margins
become probabilities by a logistic fit, and the score is P(family) times the mean pairwise probability of the language.

Learned from text and non-null lang of training documents only (crc32 of the id modulo 5 is not 0), at most ``sample``
rows by hash of the id, dealt evenly to the ``languages`` most frequent languages; prediction reads whole texts and
nothing else.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with one language learned it is always
predicted; with none every prediction is ``und``; a lang value without known family is a family of its own; repeated rows are
predicted each; an empty table gives an empty result; very long texts are read whole, batches of them in parts of bounded
bytes; columns other than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm.common import by_bytes, held_out, slices
from velith.llm.quality import platt

WIDTH = 4096
LETTER = regex.compile(r"\p{L}")
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn ur pa gu mr ne si",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def features(texts: list[str]) -> np.ndarray:
    """float32 unit rows of root n-gram shares."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(data), WIDTH), np.float32)
    for start, end in by_bytes(data, 2 << 20):
        part = data[start:end]
        flat = np.frombuffer(b"".join(part), np.uint8).astype(np.uint32)
        doc = np.repeat(np.arange(len(part), dtype=np.int64), [len(p) for p in part])
        counts = np.zeros(len(part) * WIDTH)
        for n, factor in ((1, 2654435761), (2, 2246822519), (3, 3266489917)):
            if len(flat) < n:
                break
            gram = flat[: len(flat) - n + 1].copy()
            for k in range(1, n):
                gram = gram << np.uint32(8) | flat[k : len(flat) - n + 1 + k]
            slot = (gram * np.uint32(factor)) >> np.uint32(20)
            inside = doc[: len(gram)] == doc[n - 1 :]
            counts += np.bincount((doc[: len(gram)] * WIDTH + slot)[inside], minlength=len(counts))
        rows = np.sqrt(counts.reshape(len(part), WIDTH))
        out[start:end] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return out


@dataclass
class Machine:
    """One linear machine: weights (the bias last), and the logistic fit of its margin."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 150) -> Machine:
    """Squared hinge with quadratic penalty, by accelerated gradient steps; y is True or False, classes weigh the same."""
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    ones = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    w = z = np.zeros(ones.shape[1], np.float32)
    rate, t = 1 / (1 + 2 * cost * 2), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - sign * (ones @ z))
        grad = z - 2 * cost * (ones.T @ (weight * sign * slack))
        new = z - rate * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = (new + np.float32((t - 1) / t_new) * (new - w)).astype(np.float32), new.astype(np.float32), t_new
    out = Machine(w.astype(np.float64))
    out.slope, out.offset = platt(out.margin(x), y.astype(float))
    return out


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    rest: list[Machine] = field(default_factory=list)
    pairs: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        if len(self.families) == 1:
            chosen, trust = np.zeros(n, int), np.ones(n)
        else:
            margins = np.stack([m.margin(x) for m in self.rest], axis=1)
            likely = np.stack([m.probability(margins[:, k]) for k, m in enumerate(self.rest)], axis=1)
            chosen = margins.argmax(axis=1)
            trust = likely[np.arange(n), chosen] / np.maximum(likely.sum(axis=1), 1e-12)
        langs, score = np.empty(n, object), np.zeros(n)
        for k, family in enumerate(self.families):
            own, names = np.flatnonzero(chosen == k), self.languages[family]
            votes, sums, chance = (np.zeros((len(own), len(names))) for _ in range(3))
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                machine = self.pairs[a, b]
                margin = machine.margin(x[own])
                p = machine.probability(margin)
                votes[:, i] += margin > 0
                votes[:, j] += margin <= 0
                sums[:, i] += margin
                sums[:, j] -= margin
                chance[:, i] += p
                chance[:, j] += 1 - p
            best = (votes + 0.49 * np.tanh(sums)).argmax(axis=1) if len(names) > 1 else np.zeros(len(own), int)
            langs[own] = np.array(names, object)[best]
            score[own] = trust[own] * (chance[np.arange(len(own)), best] / (len(names) - 1) if len(names) > 1 else 1)
        return langs.tolist(), score


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = np.array(langs, object)
    families = sorted({family_of(a) for a in langs})
    model = Model(families, {f: sorted({a for a in langs if family_of(a) == f}) for f in families})
    kin = np.array([family_of(a) for a in langs], object)
    if len(families) == 2:  # the second machine would be the first one's mirror image
        one = svm(x, kin == families[0])
        model.rest = [one, Machine(-one.weights, one.slope, -one.offset)]
    elif len(families) > 2:
        model.rest = [svm(x, kin == f) for f in families]
    for family in families:
        for a, b in combinations(model.languages[family], 2):
            own = (names == a) | (names == b)
            model.pairs[a, b] = svm(x[own], names[own] == a)
    return model


def _chosen(docs: DataFrame, sample: int, languages: int) -> DataFrame:
    """(id, lang) of the training rows: per language the share of the range of hashes that holds its part of the sample.

    Languages are counted with a combined aggregate and no row is shuffled, however unevenly they are spread.
    """
    spark, parts = docs.sparkSession, 1 << 30
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang")).filter(~held_out("id") & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()
    each = max(2, sample // max(1, len(counts)))
    below = spark.createDataFrame([(r["lang"], min(parts, int(1.3 * each / r["count"] * parts) + 1)) for r in counts], "lang string, below long")
    hashed = known.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(parts)))
    rows = hashed.join(F.broadcast(below), "lang").filter("h < below").select("lang", "h", "id").collect()
    met: dict[str, int] = {}
    picked = []
    for lang, _, i in sorted({tuple(r) for r in rows}):
        met[lang] = met.get(lang, 0) + 1
        if met[lang] <= each:
            picked.append((i, lang))
    return spark.createDataFrame(picked, "id long, lang string")


def train(docs: DataFrame, sample: int = 4000, languages: int = 256) -> Model:
    """Fit on at most ``sample`` rows (two a language at least) of the ``languages`` most frequent languages."""
    chosen = _chosen(docs, sample, languages)

    def run(batches):
        for batch in slices(batches, 128):
            x = features([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    rows = wanted.select("lang", "text", "id").mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows]).reshape(-1, WIDTH)
    return fit(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            langs, score = m.predict(features(texts))
            blank = np.array([LETTER.search(t) is None for t in texts], bool)
            langs = ["und" if b else a for a, b in zip(langs, blank, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(np.where(blank, 0.0, np.clip(score, 0, 1)))], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
