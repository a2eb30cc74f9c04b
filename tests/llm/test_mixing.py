"""Mixing against plain Python: targets by repeated sharing, sums by exhaustive search."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import SCHEMA

from millrace.llm.mixing import fit_budget, mix_sources


def plain_targets(sizes: dict, percent=150):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, held = sum(sizes.values()) * percent / 100, {}
    while True:
        free = [s for s in order if s not in held]
        left = budget - sum(held.values())
        part = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if part[s] > 2 * sizes[s] + 1e-6]
        if not above:
            return held | part
        held |= {s: 2.0 * sizes[s] for s in above}


def check(docs, rows):
    texts = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in docs]
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sorted((d is None, d or 0, n) for d, s, n in texts)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, s, n in texts:
        sizes[s] += n
        longest[s] = max(longest[s], n)
    targets = plain_targets(sizes)
    for r in rows:
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], abs=1e-6)
        taken[r.source] += r.taken
    return {s: (taken[s], targets[s], longest[s]) for s in sizes}


def test_documents(spark, documents):
    rows = mix_sources(documents).collect()
    docs = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    for taken, target, _ in check(docs, rows).values():
        assert abs(taken - target) <= max(1, 0.01 * target)
    assert sorted(map(str, mix_sources(documents.repartition(7)).collect())) == sorted(map(str, rows))


def test_edge_rows(spark, edge_rows):
    rows = [(d, t, [None, "a", "Z", "é", "\U0001f600"][i % 5]) for i, (d, t) in enumerate(edge_rows * 3)]
    df = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], SCHEMA)
    for name in ("size", "target", "__place", "n", "s", "copies", "__drawn"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    for taken, target, longest in check(rows, mix_sources(df).collect()).values():
        assert abs(taken - target) <= max(longest, 1)


def test_without_words_and_without_rows(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = mix_sources(spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 0)], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_a_hot_source_is_met_exactly(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 97 AS INT)) AS text", "'en' AS lang", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "0L AS n_chars")
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert all(abs(taken - target) <= 1 for taken, target, _ in check(docs, mix_sources(df).collect()).values())


@pytest.mark.parametrize("copies", [1, 2])
@pytest.mark.parametrize("room", [1, 40, 1 << 16])
def test_sums_are_the_nearest(copies, room):
    rng = np.random.default_rng(copies)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 60, 4))
        counts = rng.integers(1, 3, len(lengths))
        most = counts * copies
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        got = fit_budget(lengths, counts, budget, copies, rng.random(), room)
        assert (got >= 0).all() and (got <= most).all()
        best = min(abs(budget - sum(a * b for a, b in zip(k, lengths))) for k in itertools.product(*[range(m + 1) for m in most]))
        error = abs(budget - int((got * lengths).sum()))
        # The even share goes before the program; with it all is exact unless a length is used up.
        assert best <= error <= max(int(lengths.max()), best)


def test_the_program_alone_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = np.unique(rng.integers(20, 90, 5))
        counts = np.ones(len(lengths), dtype=np.int64)
        budget = int(rng.integers(1, lengths.sum()))
        from millrace.llm.mixing import _nearest_sum

        got = _nearest_sum(lengths, counts, np.zeros_like(counts), budget, 1, 2 * budget)
        best = min(abs(budget - sum(k * lengths)) for k in itertools.product(range(2), repeat=len(lengths)))
        assert abs(budget - int((got * lengths).sum())) == best and set(got) <= {0, 1}
