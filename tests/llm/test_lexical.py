"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SCHEMA, SF_DIR, words

from millrace.llm import lexical
from millrace.llm.lexical import Best, Segment, rank_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    queries = {}
    for i, text in items:
        if terms(text):
            queries.setdefault(i, set()).update(terms(text))
    out = []
    for item, query in queries.items():
        rows = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in query if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_documents_and_benchmark(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    got = rank_documents(documents, items).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()], 50)


@pytest.mark.parametrize("shape", [{}, {"segment_docs": 7, "size": 3}, {"block_terms": 9, "segment_docs": 50, "size": 8}])
def test_edge_rows_ties_and_blocks(spark, make_docs, edge_rows, shape, monkeypatch):
    monkeypatch.setattr(lexical, "TEXT_PART", 100)
    long_term = "x" * 500
    docs = [*edge_rows, *((100 + i, " ".join(words(12, i % 9, "q"))) for i in range(120)), (7000, long_term + " q1"), (7001, "y" * 500)]
    items = [(1, "one A b c no"), (2, " ".join(words(30, 4, "q"))), (2, "Ünïcode école"), (None, "ÉCOLE tail"), (None, "one"), (3, None), (4, "!?"), (5, long_term.upper()), (6, "nothing here is known zzz"), (7, " ".join(words(900, 8, "q")))]
    items += [(8, " ".join(f"w{i}" for i in range(200)))]
    queries = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, term string")
    got = rank_documents(make_docs(docs).repartition(4), queries, k=6, **shape).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items, 6)


def test_empty_tables(spark, empty_docs, make_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rank_documents(empty_docs, items).collect() == []
    assert rank_documents(make_docs([None, "", " !"]), items).collect() == []
    assert rank_documents(make_docs(["a b"]), items.limit(0)).collect() == []


def test_skipping_loses_nothing_and_reads_less():
    rng = np.random.default_rng(4)
    n_docs, n_lists = 3000, 40
    shares = np.append(rng.uniform(0.2, 0.9, 12), rng.uniform(0.0005, 0.03, n_lists - 12))
    held = [np.sort(rng.choice(n_docs, max(1, int(s * n_docs)), replace=False)).astype(np.int32) for s in shares]
    dfs = np.array([len(h) for h in held])
    tfs = rng.integers(1, 5, dfs.sum())
    lengths = rng.integers(20, 400, n_docs)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * dfs + 1))).astype(np.int64)
    body = lexical.join_parts(*(lexical.squeeze(a.tobytes()) for a in (np.arange(n_docs), lengths, np.concatenate(held), tfs)))
    segment = Segment(np.arange(n_lists), dfs, body, weights, n_docs, int(lengths.sum()))
    for seed in range(30):
        query = sorted(np.random.default_rng(seed).choice(n_lists, 14, replace=False).tolist())
        whole = np.zeros(n_docs, np.int64)
        for t in query:
            np.add.at(whole, segment.docs[segment.lists[t]], segment.scores[segment.lists[t]])
        order = [i for i in np.lexsort((np.arange(n_docs), -whole)) if whole[i] > 0][:10]
        for size in (64, 500, 4096):
            best = Best(10)
            segment.search(query, best, size)
            assert best.ids.tolist() == order and best.scores.tolist() == whole[order].tolist()
