"""Repeated line runs against all runs."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pytest

from velith.llm import line_dedup


def brute(rows, least):
    """Line numbers to delete by row: later copies of every run with enough words, in (doc_id, line) order."""
    docs = {}
    for i, t in rows:
        if t is not None:
            docs.setdefault((i is not None, i or 0, t), [(k, x) for k, x in enumerate(t.split("\n")) if re.search(r"\S", x)])
    first, gone = {}, {}
    for key in sorted(docs):
        seq = docs[key]
        words = [len(re.findall(r"\S+", x)) for _, x in seq]
        for s in range(len(seq)):
            total = 0
            for e in range(s, len(seq)):
                total += words[e]
                if total >= least:
                    run = tuple(x for _, x in seq[s : e + 1])
                    if first.setdefault(run, (key, s)) != (key, s):
                        gone.setdefault(key, set()).update(range(seq[s][0], seq[e][0] + 1))
    for key, lines in gone.items():  # blank lines between two deleted ones
        for (a, _), (b, _) in pairwise(docs[key]):
            if a in lines and b in lines:
                lines.update(range(a, b))
    return {key: gone.get(key, set()) for key in docs}


def rows_of(seed):
    rng = np.random.default_rng(seed)
    lines = [f"l{k} " + " ".join(f"w{k}x{j}" for j in range(rng.integers(0, 6))) for k in range(12)]
    shared = [f"shared {k} a b c" for k in range(9)]
    rows = []
    for i in range(25):
        own = [lines[k] if rng.random() < 0.7 else f"own {i} {k}" for k in rng.integers(0, 12, rng.integers(0, 14))]
        if i % 3 == 0:
            at, cut = int(rng.integers(0, len(own) + 1)), int(rng.integers(0, 4))
            own[at:at] = shared[cut : cut + 6]
        if i % 4 == 0:
            own.insert(len(own) // 2, "  ")
        rows.append((i, "\n".join(own)))
    return [*rows, (100, None), (101, ""), (102, "\n \n"), (103, "\n".join(shared)), (103, "\n".join(shared)), (104, "\n".join(shared * 3)), (None, "\n".join(shared)), (105, "one line " * 40), (106, "one line " * 40), (107, "\n".join(["again and again"] * 60))]


@pytest.mark.parametrize(("seed", "least"), [(1, 10), (2, 7), (3, 16), (4, 1), (5, 20)])
def test_equals_all_runs(documents, seed, least):
    rows = rows_of(seed)
    expected = brute(rows, least)
    order = {}
    for i, t in rows:
        if t is None:
            order.setdefault((i, t), (None, 0, 0, False))
            continue
        gone = expected[(i is not None, i or 0, t)]
        left = [x for k, x in enumerate(t.split("\n")) if k not in gone]
        text = "\n".join(left)
        order[(i, t)] = (text, t.count("\n") + 1, len(gone), bool(gone) and not re.search(r"\S", text))
    found = line_dedup.dedup_lines(documents(rows), least).collect()
    got = sorted(repr((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["emptied"])) for r in found)
    assert got == sorted(repr((i, *order[(i, t)])) for i, t in rows)


@pytest.mark.parametrize("least", [1, 7, 12])
def test_suffix_array_and_intervals_equal_naive_ones(documents, least):
    docs = documents(rows_of(7))
    found = line_dedup.suffix_array(docs, least).collect()
    seqs = {}
    for r in found:
        seqs.setdefault((r["_doc"], r["_hash"], r["island"]), {})[r["k"]] = r["r0"]
    depth = 1 << line_dedup.rounds_for(least)
    prefix = {(*key, k): tuple(seq.get(k + j, -1) for j in range(depth)) for key, seq in seqs.items() for k in seq}
    ranks = {(r["_doc"], r["_hash"], r["island"], r["k"]): r["rank"] for r in found}
    assert len(ranks) == len(found) > 20
    for a, b in pairwise(sorted(prefix, key=lambda p: (prefix[p], repr(p)))):
        assert (ranks[a] == ranks[b]) == (prefix[a] == prefix[b]) and ranks[a] <= ranks[b]
    named, naive = {}, {}
    for r in line_dedup.stretches(line_dedup.repeated_lines(docs), least).collect():
        place = (r["_doc"], r["_hash"], r["k"])
        island = next(i for d, h, i in seqs if (d, h) == place[:2] and r["k"] in seqs[d, h, i])
        run = tuple(seqs[(*place[:2], island)][k] for k in range(r["k"], r["end"] + 1))
        assert len(run) == r["name"]["size"]
        named.setdefault(tuple(r["name"]), set()).add(place)
        naive.setdefault(run, set()).add(place)
    assert {frozenset(x) for x in named.values()} == {frozenset(x) for x in naive.values()} and len(named) == len(naive)


def test_long_text_of_one_repeated_line(documents):
    out = line_dedup.dedup_lines(documents([(1, "\n".join(["ten words stand in this very line of the text"] * 3000))]), 50).collect()
    assert [(r["n_lines"], r["n_removed"]) for r in out] == [(3000, 2999)]


def test_clean_keeps_columns_and_drops_emptied(documents):
    copy = "\n".join(f"line {k} of ten words that all the copies share now" for k in range(6))
    docs = documents([(1, copy), (2, copy), (3, "head\n" + copy + "\ntail"), (4, None), (5, "")])
    out = line_dedup.clean(docs, 50)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (copy, len(copy)), 3: ("head\ntail", 9), 4: (None, None), 5: ("", 0)}


def test_no_python_in_the_plan(documents):
    out = line_dedup.clean(documents([(1, "a b"), (2, "a b")]), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(documents):
    assert line_dedup.dedup_lines(documents([]), 50).count() == 0
    assert line_dedup.clean(documents([]), 50).count() == 0
