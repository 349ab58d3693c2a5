"""Embedding near-duplicates by a forest of random-projection trees with spill.

A node is split at the median along a random direction; rows nearer to the median than ``spill`` times the length that a
link at the threshold has on a random direction (its distance over the root of the dimension) go to both sides.  A tight
cluster therefore stays together instead of being cut through, and a direction that would copy more than half of a node
is not taken: after four of those the node is a leaf.  Leaves are compared within, in double precision.

Two levels keep every task bounded and the work in proportion to the rows:

1. Routing.  While a node holds more than ``group`` rows, it is split over the cluster: a subtree is fitted on a sample
   of that very node (``node_sample`` rows by hash, fitted in a task of its own) and all of the node's rows go down it, in
   salted parts of bounded size.  So depth follows the row count, not the size of one sample.  Each of ``routes`` trees
   sends a vector on once, and only where a label has more than ``group`` vectors; others are routed by none.  A node that can't
   be split (more than ``group`` rows in one cluster) is cut into blocks that meet pairwise.
2. Inside a group ``trees`` trees are grown over all of its rows down to leaves of ``leaf`` rows.

A group gives out no pairs: its links are marked in one bit table of bounded size, so a pair counts once however many leaves share
it, and over groups it counts in the least that both rows share.  Each row's links become one number and one edge
towards the least row of its part of the group; edges of all groups are united.

Rows with equal label and equal vector are one class with a weight; copies are never paired with one another.  n_links counts
single links, so a cluster of m different vectors costs m x m comparisons; nothing else grows faster than the rows.

Defined cases: null label, null vector, null, NaN or infinite component, zero vector or null id: no link, a component
of its own, kept.  Vectors of different length never link.  Every row counts as a vector, also one that repeats another.
An empty table gives an empty result; columns other than vec_id, embedding and label are not looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm.common import grouped, materialise
from velith.llm.components import components

TREES, ROUTES, LEAF, GROUP, NODE_SAMPLE = 6, 2, 32, 8192, 4096
#: Margins in units of a threshold link's length on a random direction: inside groups, and where each copy is shuffled.
SPILL, ROUTE_SPILL = 0.75, 0.5
DEPTH, MIN_NODE, TRIES = 6, 64, 4


def margin(cosine: float, dim: int, spill: float) -> float:
    return spill * (2 * (1 - cosine)) ** 0.5 / dim**0.5


def split(rows: np.ndarray, around: float, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """Direction and median of a split that copies at most half of the rows; None if no tried direction gives one."""
    for _ in range(TRIES):
        direction = rng.standard_normal(rows.shape[1]).astype(rows.dtype)
        direction /= np.linalg.norm(direction)
        at = rows @ direction
        middle = float(np.median(at))
        left, right = int((at <= middle + around).sum()), int((at >= middle - around).sum())
        if left + right <= 1.5 * len(rows) and max(left, right) < len(rows):
            return direction, middle
    return None


def leaves(rows: np.ndarray, leaf: int, around: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of the leaves of one tree grown over all rows."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        own = todo.pop()
        found = split(rows[own], around, rng) if len(own) > leaf else None
        if found is None:
            out.append(own)
            continue
        at = rows[own] @ found[0]
        todo += [own[at <= found[1] + around], own[at >= found[1] - around]]
    return out


def subtree(rows: np.ndarray, depth: int, around: float, rng: np.random.Generator) -> dict[int, tuple[np.ndarray, float]]:
    """Splits of a heap (node k has children 2k+1 and 2k+2) fitted on a node's sample."""
    out, todo = {}, [(0, rows, 0)]
    while todo:
        node, own, level = todo.pop()
        if level < depth and len(own) >= MIN_NODE and (found := split(own, around, rng)):
            out[node] = found
            at = own @ found[0]
            todo += [(2 * node + 1, own[at <= found[1]], level + 1), (2 * node + 2, own[at > found[1]], level + 1)]
    return out


def descend(rows: np.ndarray, tree: dict[int, tuple[np.ndarray, float]], around: float) -> list[tuple[int, np.ndarray]]:
    """(node, row numbers) of the ends that the rows reach."""
    out, todo = [], [(0, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node not in tree:
            out.append((node, own))
            continue
        at = rows[own] @ tree[node][0]
        todo += [(2 * node + 1, own[at <= tree[node][1] + around]), (2 * node + 2, own[at >= tree[node][1] - around])]
    return out


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(flat.flatten()).astype(np.float64).reshape(-1, dim)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


NODE = ["label", "dim", "code"]


def _sizes(rows: DataFrame, group: int) -> DataFrame:
    """Nodes of more than ``group`` rows with their counts, written: at most one for ``group`` rows."""
    return materialise(rows.groupBy(*NODE).agg(F.count("*").alias("count")).filter(F.col("count") > group), "large-nodes")


def _routed(rows: DataFrame, large: DataFrame, cosine: float, group: int, node_sample: int) -> DataFrame:
    """One round of routing: rows of large nodes go down a subtree fitted on a sample of their node."""
    parts = 1 << 30
    sized = rows.join(large, NODE, "left")
    drawn = sized.filter(F.pmod(F.xxhash64("rep", "code"), F.lit(parts)) < float(parts * node_sample) / F.col("count"))

    def fit(key, table):
        label, dim, code = (k.as_py() for k in key)
        x, n = _unit(table.column("v"), dim), table.column("count")[0].as_py()
        order = np.argsort(np.asarray(table.column("rep")), kind="stable")
        depth = min(DEPTH, int(np.ceil(np.log2(n / group))))
        tree = subtree(x[order], depth, margin(cosine, dim, ROUTE_SPILL), np.random.default_rng([abs(label), dim, code]))
        return pa.table({"label": [label], "dim": [dim], "code": [code], "count": [n], "tree": [pickle.dumps(tree)]})

    kind = rows.schema["v"].dataType.simpleString()
    fitted = materialise(drawn.select(*NODE, "rep", "v", "count").groupBy(*NODE).applyInArrow(fit, "label long, dim long, code long, count long, tree binary"), "subtrees")
    salts = F.ceil(F.col("count") / group).cast("long")
    models = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    salted = sized.filter("count is not null").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), salts)).drop("count")

    def down(key, left, right):
        tree = pickle.loads(right.column("tree")[0].as_py()) if right.num_rows else {}
        if not tree or not left.num_rows:
            return left.drop_columns(["salt"])
        dim, code = key[1].as_py(), key[2].as_py()
        ends = descend(_unit(left.column("v"), dim), tree, margin(cosine, dim, ROUTE_SPILL))
        codes = np.concatenate([np.full(len(own), code << 7 | node) for node, own in ends])
        out = left.take(pa.array(np.concatenate([own for _, own in ends]))).drop_columns(["salt"])
        return out.set_column(out.column_names.index("code"), "code", pa.array(codes.astype(np.int64)))

    key = [*NODE, "salt"]
    moved = salted.select(*rows.columns, "salt").groupBy(*key).cogroup(models.select(*key, "tree").groupBy(*key)).applyInArrow(down, f"label long, dim long, code long, rep long, weight long, v {kind}")
    return materialise(sized.filter("count is null").select(*rows.columns).union(moved.select(*rows.columns)), "routed")


def route(classes: DataFrame, cosine: float, group: int, routes: int, node_sample: int, rounds: int = 8) -> DataFrame:
    """(label, dim, code, rep, weight, v, codes): a row for each group that a vector is compared in, with all of its groups."""
    rows = classes.select("label", "dim", F.lit(1).cast("long").alias("code"), "rep", "weight", F.col("embedding").alias("v"))
    large = _sizes(rows, group)
    if not large.head(1):
        return rows.withColumn("codes", F.array("code"))
    many = rows.join(large.select(*NODE, F.lit(True).alias("many")), NODE, "left").withColumn("code", F.explode(F.when(F.col("many"), F.sequence(F.lit(1).cast("long"), F.lit(routes).cast("long"))).otherwise(F.array("code"))))
    rows = many.select(*rows.columns)
    for _ in range(rounds):
        before = rows
        rows = _routed(rows, _sizes(rows, group), cosine, group, node_sample)
        large = _sizes(rows, group)
        if not large.head(1) or large.join(before.select(*NODE).distinct(), NODE, "left_anti").isEmpty():
            break  # nothing is large, or what is large was not split by this round
    return rows.join(rows.groupBy("rep").agg(F.array_sort(F.collect_list("code")).alias("codes")), "rep")


def _earlier(codes: list[np.ndarray], code: int) -> list[np.ndarray]:
    """For each group of a smaller code that at least two rows share, which rows those are."""
    own = [c[c < code] for c in codes]
    row = np.repeat(np.arange(len(codes)), [len(c) for c in own])
    flat = np.concatenate(own) if own else np.zeros(0, np.int64)
    shared = [row[flat == c] for c, n in zip(*np.unique(flat, return_counts=True), strict=True) if n > 1]
    out = np.zeros((len(shared), len(codes)), bool)
    for mask, members in zip(out, shared, strict=True):
        mask[members] = True
    return list(out)


def _parts(met: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Per row the least id of its part of a symmetric link table; every row is expanded once."""
    root, seen = rep.copy(), ~met.any(axis=1)
    for start in np.argsort(rep, kind="stable").tolist():
        if seen[start]:
            continue
        part = np.zeros(len(rep), bool)
        part[start] = True
        edge = np.array([start])
        while len(edge):
            reached = np.zeros(len(rep), bool)
            for k in range(0, len(edge), 1024):
                reached |= met[edge[k : k + 1024]].any(axis=0)
            edge = np.flatnonzero(reached & ~part)
            part[edge] = True
        seen |= part
        root[part] = rep[start]
    return root


def compare(code: int, rep: np.ndarray, weight: np.ndarray, side: np.ndarray, codes: list[np.ndarray], rows: np.ndarray, cosine: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> pa.RecordBatch | None:
    """Links inside one group by a forest over its rows: per row its count of linked vectors here and the least row of its part."""
    n, dim = rows.shape
    order, norm = np.argsort(rep, kind="stable"), np.linalg.norm(rows, axis=1)
    unit = rows / norm[:, None]
    rng, around = np.random.default_rng([code & 0x7FFFFFFF, n]), margin(cosine, dim, spill)
    single, met = unit.astype(np.float32)[order], np.zeros((n, n), bool)
    for _ in range(trees):
        for own in (order[x] for x in leaves(single, leaf, around, rng)):
            for k in range(0, len(own), 256):
                part = own[k : k + 256]
                met[np.ix_(part, own)] |= unit[part] @ unit[own].T >= cosine - 1e-9
    links, earlier, within = np.zeros(n, np.int64), _earlier(codes, code), bool((side == 0).all())
    for k in range(0, n, 256):
        x, y = np.nonzero(met[k : k + 256])
        x += k
        allowed = (x != y) & (within | (side[x] != side[y]))
        x, y = x[allowed], y[allowed]
        sure = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", rows[x[j : j + 65536]], rows[y[j : j + 65536]]) / (norm[x[j : j + 65536]] * norm[y[j : j + 65536]]) >= cosine for j in range(0, len(x), 65536))])
        x, y = x[sure], y[sure]
        met[k : k + 256] = False
        met[x, y] = True
        once = np.ones(len(x), bool)
        for members in earlier:
            once &= ~(members[x] & members[y])
        np.add.at(links, x[once], weight[y[once]])
    linked = np.flatnonzero(met.any(axis=1))
    if not len(linked):
        return None
    root = _parts(met, rep)
    return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(links[linked]), pa.array(root[linked])], names=["rep", "links", "root"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, trees: int = TREES, leaf: int = LEAF, group: int = GROUP, routes: int = ROUTES, node_sample: int = NODE_SAMPLE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    raw = F.col("embedding").cast("array<double>")
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(raw, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.col("label").cast("long")).alias("label"), F.when(sound, F.xxhash64(F.col("embedding"))).alias("hi"), F.when(sound, F.xxhash64(F.lit(1), F.col("embedding"))).alias("lo"), "embedding")
    classes = rows.filter("hi is not null").groupBy("label", "hi", "lo").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.withColumn("dim", F.size("embedding").cast("long")), "vector-classes")

    placed = route(classes, cosine, group, routes, node_sample)
    # A group that routing couldn't make small enough is cut into blocks; each pair of blocks is a group of its own.
    blocks = placed.groupBy(*NODE).agg(F.count("*").alias("count")).filter("count > 1").select(*NODE, F.when(F.col("count") <= group, 1).otherwise(F.ceil(F.col("count") * 2 / group)).cast("long").alias("blocks"))
    dealt = placed.join(materialise(blocks, "groups"), NODE).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    dealt = dealt.select(*NODE, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "weight", side.alias("side"), "codes", "v")

    def inside(batches):
        for rows in grouped(batches, 5):
            rows = rows.combine_chunks()
            rep, weight, sides = (np.asarray(rows.column(k)).astype(np.int64) for k in (5, 6, 7))
            lists = rows.column(8).combine_chunks()
            offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            codes = [flat[offsets[k] : offsets[k + 1]] for k in range(len(rep))]
            x = np.asarray(rows.column(9).combine_chunks().flatten()).astype(np.float64).reshape(len(rep), -1)
            if (out := compare(int(np.asarray(rows.column(2))[0]), rep, weight, sides, codes, x, cosine, trees, leaf)) is not None:
                yield out

    by = [*NODE, "i", "j"]
    found = materialise(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(inside, "rep long, links long, root long"), "leaf-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("label", "hi", "lo", "rep", "weight").join(linked, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "hi", "lo", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "label", "hi", "lo").join(named, ["label", "hi", "lo"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
