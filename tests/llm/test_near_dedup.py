"""HyperMinHash near-duplicates against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tests.llm.conftest import groups
from velith.llm import near_dedup as nd


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return groups(links, {i for i, _ in sets})


def noisy(rng, base, share):
    words = base.split()
    for k in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[k] = f"w{rng.integers(1_000_000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    bases = [" ".join(f"b{g}x{k}" for k in rng.integers(0, 400, n)) for g, n in enumerate((60, 200, 40, 500))]
    out = [(None, bases[0])]
    i = 0
    for base in bases:
        for share in (0.0, 0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.3):
            for _ in range(4):
                out.append((i, noisy(rng, base, share) if share else base))
                i += 1
    chain = [f"c{k}" for k in range(300)]
    out += [(1000 + k, " ".join(chain[4 * k : 4 * k + 100])) for k in range(40)]
    out += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "One  Two"), (2007, " "), (2008, "É é"), (2009, "é é")]
    out += [(2010, "long " * 30000), (2011, "long " * 29000), (3000, bases[1]), (3000, bases[1])]
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_equals_all_pairs(documents, rows, size):
    found = nd.near_duplicates(documents(rows), size, 80).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert got == brute(rows, size)
    counts = {i: len(shingles(t, size)) for i, t in rows}
    assert all(r["n_shingles"] == counts[r["doc_id"]] for r in found)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)


def test_large_group_with_many_parts(documents):
    """One band bucket with many texts that don't all link: what the stars leave is decided block by block."""
    rng = np.random.default_rng(8)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(300):
        words = base[:]
        for at in rng.choice(120, int(rng.integers(3, 22)), replace=False):
            words[at] = f"x{rng.integers(40)}"
        rows.append((k, " ".join(words)))
    old, nd.BLOCK = nd.BLOCK, 16
    try:
        got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(documents(rows), 2, 80).collect()}
    finally:
        nd.BLOCK = old
    assert got == brute(rows, 2)


def test_keep_one_keeps_columns(documents, rows):
    docs = documents(rows)
    kept = nd.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    roots = brute(rows, 5)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == sorted([i for i, _ in rows if i is not None and roots[i] == i])


def test_empty_table(documents):
    assert nd.near_duplicates(documents([]), 2, 80).count() == 0
    assert nd.keep_one(documents([])).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
            n = int(len(both) * share)
            rest = len(both) - n
            x, y = np.unique(both[: n + rest // 2]), np.unique(np.concatenate([both[:n], both[n + rest // 2 :]]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            r = nd.registers([x, y])
            errors.append(float(nd.estimate(r[0], r[1], np.array(max(len(x), len(y))))) - true)
        assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.06


def test_registers_of_the_empty_set():
    assert not nd.registers([np.zeros(0, np.uint64)]).any()


def test_block_products_equal_set_operations():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, 30)) for _ in range(9)]
    left, right = np.arange(4), np.arange(2, 9)
    for most in (1 << 21, 50, 7):
        assert nd.shared(sets, left, right, most).tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]
