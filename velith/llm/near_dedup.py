"""MinHash near-duplicates with HyperMinHash registers.

A document is its set of distinct word shingles, as 64-bit hashes.  Each of ``BUCKETS`` buckets keeps the least hash that falls
into it, compressed to its count of leading zeros (6 bits) and the ``MANTISSA`` bits after the leading one; an empty
bucket takes the register of the first filled bucket in an order of its own, so that registers of small sets agree as
often as those of large ones.  Four registers make a band (one 64-bit value), 32 bands cover all buckets: a pair at
similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.

1. Documents with equal sets are one class, found by a combined aggregate on a 128-bit set digest.
2. In each band bucket the classes are held against its least and its greatest member (candidates linear in the
   bucket), filtered by set sizes and by the collision-corrected estimate from registers, and confirmed on full sets.
3. Links give components.  What is left are pairs of one bucket in different components: they meet in blocks of bounded
   size, where set sizes and register estimates sort out most and full sets decide the rest; no pair leaves its block.

So no group is collected or turned into all its pairs, yet every pair that shares a band and isn't connected otherwise
is decided.  The estimate drops a pair only five standard errors below the threshold.

Defined cases: null texts and texts without words have an empty set, link with nothing and are kept; rows that share
a doc_id are one node; null ids have a null component and are kept; an empty table gives an empty result; columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm.common import grouped, materialise, slices
from velith.llm.components import components, local_roots

BUCKETS, ROWS, MANTISSA = 128, 4, 10
BANDS = BUCKETS // ROWS
BLOCK = 256
#: Ids up to which a table may be sent to all executors; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Words(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than ``size`` are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    x = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        x = _mix(x * _M1 + h[k : len(h) - size + 1 + k])
    return np.unique(_mix(x + np.uint64(size)))


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each bucket the order in which an empty one looks for a filled one."""
    rng = np.random.default_rng(20240601)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers (sets x BUCKETS); all zero for an empty set."""
    least = np.zeros((len(sets), BUCKETS), np.uint64)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    for k, s in enumerate(sets):
        if len(s):
            bucket = (s >> shift).astype(np.int64)
            filled = np.zeros(BUCKETS, bool)
            filled[bucket] = True
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            row = np.zeros(BUCKETS, np.uint64)
            row[bucket[first]] = s[first]
            if not filled.all():
                source = _probes()[np.arange(BUCKETS), filled[_probes()].argmax(1)]
                row = np.where(filled, row, row[source])
            least[k] = row
    rest = least << np.uint64(BUCKETS.bit_length() - 1) >> np.uint64(11)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = 53 - exponent
    mantissa = np.floor((2 * fraction - 1) * (1 << MANTISSA)).clip(0).astype(np.uint16)
    out = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa
    out[[len(s) == 0 for s in sets]] = 0
    return out


@lru_cache(maxsize=4096)
def chance(n: int) -> float:
    """Probability that two unlike registers of about ``n`` hashes a bucket agree: equal zero count and equal mantissa."""
    total = 0.0
    for zeros in range(1, 54):
        for part in range(8):  # mantissas in eight steps, each taken as even inside
            low, high = (1 + part / 8) * 2.0**-zeros, (1 + (part + 1) / 8) * 2.0**-zeros
            total += ((1 - low) ** n - (1 - high) ** n) ** 2 / (1 << (MANTISSA - 3))
    return total


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for chance agreement of sets of about ``n`` shingles."""
    same = (a == b).mean(axis=-1)
    by = np.vectorize(lambda x: chance(max(1, int(x) // BUCKETS)), otypes=[float])(n) if np.size(n) else np.zeros(np.shape(n))
    return (same - by) / (1 - by)


def _floor(threshold: float) -> float:
    return threshold - 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (set size), hi, lo (set digest; null for the empty set), bands (registers, four to a value)."""

    def run(batches):
        for batch in slices(batches, 256):
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            bands = registers(sets).view("<i8")
            digests = [np.frombuffer(hashlib.blake2b(s, digest_size=16).digest(), "<i8").tolist() if len(s) else (None, None) for s in sets]
            values = pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), values],
                names=["doc_id", "n", "hi", "lo", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, bands array<long>")


def _could(n: str, m: str, percent: int):
    """Set sizes that allow the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose registers don't rule the threshold out."""
    a, b = (classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}")) for x in "ab")
    floor = _floor(percent / 100)

    def run(batches):
        for batch in batches:
            x, y = (np.array(batch.column(k).flatten()).reshape(-1, BANDS).view("<u2") for k in (2, 3))
            good = estimate(x, y, np.array(batch.column(4))) >= floor if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "bands_a", "bands_b", F.greatest("n_a", "n_b").alias("n"))
    return joined.mapInArrow(run, "a long, b long")


def sets_of(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of the documents named in ``ids``, written as a table."""
    ids = materialise(ids, "ids")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def run(batches):
        for batch in slices(batches, 256):
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return materialise(wanted.mapInArrow(run, "id long, set array<long>"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of doc ids whose full sets reach the threshold."""
    pairs = materialise(pairs, "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, shingle)
    a, b = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    reach = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    return pairs.join(a, "a").join(b, "b").filter(reach).select("a", "b")


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Sizes of the intersections of every left with every right set.

    Sets of more than ``most`` hashes together are taken in parts by the hashes' low bits, so memory doesn't follow the
    length of the texts.
    """
    own = np.concatenate([left, right])
    parts = 1 << max(0, (sum(len(sets[k]) for k in own) // most).bit_length())
    out = np.zeros((len(left), len(right)), np.int64)
    for part in range(parts):
        out += _products([sets[k] if parts == 1 else sets[k][(sets[k] & (parts - 1)) == part] for k in own], len(left))
    return out


def _products(own: list[np.ndarray], n_left: int) -> np.ndarray:
    """The same for sets of bounded size, left ones first: a product of 0/1 matrices, columns in chunks."""
    row = np.repeat(np.arange(len(own)), [len(s) for s in own])
    _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((n_left, len(own) - n_left), np.float32), 4096
    for start in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        chunk = np.zeros((len(own), width), np.float32)
        chunk[row[lo:hi], column[lo:hi] - start] = 1
        out += chunk[:n_left] @ chunk[n_left:].T
    return out.astype(np.int64)


def _decide(rep, comp, n, regs, sets, left, right, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x of left, y of right) that reach the threshold, among pairs of different components whose first common band is this."""
    small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    x, y = np.nonzero((comp[left][:, None] != comp[right]) & (100 * small >= percent * large) & (rep[left][:, None] != rep[right]))
    keep = []
    for k in range(0, len(x), 1 << 14):
        p, q = left[x[k : k + (1 << 14)]], right[y[k : k + (1 << 14)]]
        same = regs[p] == regs[q]
        first = same.reshape(len(p), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        by = np.array([chance(max(1, int(v) // BUCKETS)) for v in np.maximum(n[p], n[q])])
        keep.append(first & ((same.mean(axis=1) - by) / (1 - by) >= _floor(percent / 100)))
    if not keep:
        return x, y
    keep = np.concatenate(keep)
    x, y = x[keep], y[keep]
    if not len(x):
        return x, y
    a, b = np.unique(x), np.unique(y)
    if len(x) * 8 < len(a) * len(b):
        both = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in zip(x, y, strict=True)])
    else:
        both = shared(sets, left[a], right[b])[np.searchsorted(a, x), np.searchsorted(b, y)]
    reach = 100 * both >= percent * (n[left[x]] + n[right[y]] - both)
    return left[x[reach]], right[y[reach]]


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links between different components within a bucket, as one edge per row towards the least row of its part.

    Blocks of a bucket meet pairwise, each meeting is one group of at most 2 x BLOCK rows with registers and full sets; a
    pair is looked at in the first band that it shares, and never leaves its group.
    """
    key = ("band", "value", "i", "j")

    def run(batches):
        for group in grouped(batches, 4):
            group = group.combine_chunks()
            rep, comp, n, side = (np.asarray(group.column(k)) for k in (4, 5, 6, 7))
            regs = np.asarray(group.column(8).combine_chunks().flatten()).reshape(-1, BANDS).view("<u2")
            lists = group.column(9).combine_chunks()
            offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            sets = [flat[a:b] for a, b in pairwise(offsets)]
            left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
            x, y = _decide(rep, comp, n, regs, sets, left, right, int(np.asarray(group.column(0))[0]), percent)
            if len(x):
                root, met = local_roots(rep, x, y), np.unique(np.concatenate([x, y]))
                yield pa.RecordBatch.from_arrays([pa.array(rep[met]), pa.array(root[met])], names=["a", "b"])

    # A row of block i meets blocks 0..n-1: it goes to the tasks (i, j), left where it is the lower, right where the higher.
    dealt = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    dealt = dealt.select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp", "n", side.alias("side"), "bands", "set")
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").filter("a != b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signed = materialise(signatures(docs, shingle), "signatures")
    classes = materialise(signed.filter("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")).filter("rep is not null"), "classes")

    rows = classes.select("rep", "n", F.posexplode("bands").alias("band", "value"))
    one = F.struct("rep", "n")
    buckets = rows.groupBy("band", "value").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("size")).filter("size > 1")
    members = materialise(rows.join(buckets, ["band", "value"]), "members")
    stars = [members.select(F.least("rep", f"{x}.rep").alias("a"), F.greatest("rep", f"{x}.rep").alias("b"), "n", F.col(f"{x}.n").alias("m")) for x in ("low", "high")]
    candidates = stars[0].union(stars[1]).filter("a != b").filter(_could("n", "m", percent)).select("a", "b").distinct()
    links = materialise(confirmed(likely(candidates, classes, percent), docs, shingle, percent), "links")
    found = materialise(components(links), "components")

    labelled = members.join(found, F.col("rep") == F.col("node"), "left").select("band", "value", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    split = labelled.groupBy("band", "value").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).filter("x != y")
    split = split.select("band", "value", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    left = materialise(labelled.join(split, ["band", "value"]), "undecided")
    sets = sets_of(left.select(F.col("rep").alias("id")).distinct(), docs, shingle)
    full = left.join(classes.select("rep", "bands"), "rep").join(sets, F.col("rep") == F.col("id"))
    more = _blocks(full, percent)
    bridges = more.union(found.select("node", "component"))
    final = components(bridges)

    named = classes.select("hi", "lo", "rep").join(final, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that are the first of their group."""
    gone = materialise(near_duplicates(docs, shingle, percent).filter("not kept").select(F.col("doc_id").alias("_velith_gone")).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_velith_gone"), "left_anti")
