"""The Jaccard join against all pairs in plain Python."""

import random
import re
from collections import Counter

import pytest
from llm_helpers import words

from millrace.llm import packets as P
from millrace.llm.components import connected_components
from millrace.llm.jaccard import near_duplicates


def sets_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def engine(df):
    return Counter(tuple(r) for r in df.collect())


def families(seed):
    """Copies, near copies with chains of edits, and a passage that all share."""
    rng = random.Random(seed)
    shared = words(30, 99, "s")
    rows = []
    for f in range(12):
        base = words(rng.choice([3, 6, 40, 120]), seed * 100 + f, f"f{f}_")
        for _ in range(rng.choice([1, 3, 9])):
            rows.append(" ".join(base + shared * rng.randrange(2)))
            if len(base) > 10:
                base = list(base)
                base[rng.randrange(len(base))] = f"edit{rng.randrange(10**6)}"
        rows.append(" ".join(base).upper())
    return [(1000 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("direct_share", [2, 0.01])
def test_families(make_docs, direct_share):
    rows = families(1) + families(2)
    assert engine(near_duplicates(make_docs(rows).repartition(4), direct_share=direct_share)) == brute(rows)


def test_edge_cases(make_docs, edge_rows):
    assert engine(near_duplicates(make_docs(edge_rows).repartition(3))) == brute(edge_rows)


def test_whole_small_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert engine(near_duplicates(documents)) == brute(rows)


def test_nothing_to_link(make_docs, empty_docs):
    assert near_duplicates(empty_docs).count() == 0
    assert engine(near_duplicates(make_docs(["a b c d e", "v w x y z"]))) == brute([(0, "a b c d e"), (1, "v w x y z")])


def test_components_of_a_long_path(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = dict(connected_components(links).collect())
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_many_slices(documents, monkeypatch):
    monkeypatch.setattr(P, "SLICE_BITS", 15)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert engine(near_duplicates(documents.repartition(5))) == brute(rows)
