"""Retrieval for tables of queries against plain Python."""

import random

import numpy as np
import pytest

from millrace.operators import corpus, retrieval


def plain_keywords(chunks, queries, k):
    import re

    out = set()
    chunks = sorted(chunks, key=lambda c: (c[0].encode(), c[1]))
    for number, query in queries:
        if not query or not query.strip():
            continue
        terms = {t.lower() for t in re.findall("[a-zA-Z0-9_]{3,}", query)}
        scored = [(sum(t in (text or "").lower() for t in terms), s, n) for s, n, text in chunks]
        best = sorted([c for c in scored if c[0]], key=lambda c: -c[0])[:k] or [(0, *c[1:]) for c in scored[:k]]
        out |= {(number, i + 1, *c) for i, c in enumerate(best)}
    return out


@pytest.mark.parametrize("shape", [{}, {"block_terms": 500}])
def test_ten_thousand_queries(spark, monkeypatch, shape):
    monkeypatch.setattr(retrieval, "HELD", 3000)
    rng = random.Random(3)
    words = [f"w{i:03}" for i in range(150)] + ["The", "she", "ÉCOLE", "x_y"]
    chunks = [(rng.choice("abcé") + str(i % 7), i, " ".join(rng.choices(words, k=rng.randrange(0, 12))) or None) for i in range(60)]
    n = 10_000 if not shape else 300
    queries = [(i, " ".join(rng.choices([*words, "zzz", "he", "the"], k=rng.randrange(0, 5))) or rng.choice([None, " ", "?"])) for i in range(n)]
    df = spark.createDataFrame(chunks, "source string, chunk_no int, text string").repartition(4)
    got = retrieval.keyword_top(df, spark.createDataFrame(queries, "query_id long, query string"), 3, **shape)
    assert {(r.query_id, r["rank"], r.score, r.source, r.chunk_no) for r in got.collect()} == plain_keywords(chunks, queries, 3)


@pytest.mark.parametrize("block_terms", [1 << 20, 700])
def test_chunks_behind_the_head(spark, monkeypatch, block_terms):
    """The first chunks are searched for all queries, the others must beat what was found there."""
    monkeypatch.setattr(retrieval, "HEAD", 16)
    rng = random.Random(5)
    words = ["the", "other", "and", *[f"w{i:02}x" for i in range(40)], "x" * 70, "Straße"]
    chunks = [(rng.choice("abcdé"), i, " ".join(rng.choices(words, k=rng.randrange(0, 15))) or None) for i in range(400)]
    queries = [(i, " ".join(rng.choices([*words, "zzz", "heth"], k=rng.randrange(0, 7))) or None) for i in range(300)]
    df = spark.createDataFrame(chunks, "source string, chunk_no int, text string").repartition(5)
    got = retrieval.keyword_top(df, spark.createDataFrame(queries, "query_id long, query string"), 4, block_terms=block_terms)
    assert {(r.query_id, r["rank"], r.score, r.source, r.chunk_no) for r in got.collect()} == plain_keywords(chunks, queries, 4)


def test_lists_of_common_terms_are_not_walked_through():
    class Walked:
        def __init__(self, cells):
            self.cells, self.n = cells, 0

        def __getitem__(self, at):
            self.n += len(at)
            return self.cells[at]

    n = 500
    words = ["common", *[f"w{i:03}" for i in range(n)]]
    known = retrieval._Terms(words)
    found = [known.of(f"common w{i:03} w{(i + 1) % n:03} COMMONLY") for i in range(n)]
    search = retrieval._Search(np.arange(0, 2 * n + 1, 2), np.array([t for i in range(n) for t in (0, i + 1)]), np.zeros((n, 2), np.int32))
    best = {}
    for a, b in ((0, 4), (4, n)):
        segment = retrieval._Segment(found[a:b], len(words))
        segment.chunks = walked = Walked(segment.chunks)
        for part in search.into(segment):
            for q, chunk, score in zip(*part):
                best.setdefault(int(q), []).append((-int(score), a + int(chunk)))
    for i in range(n):
        both = sorted({(i - 1) % n, i})
        assert sorted(best[i])[:2] == [(-2, c) for c in both]
    assert walked.n <= 2 * n


def test_no_chunks_and_no_queries(spark):
    chunks = spark.createDataFrame([], "source string, chunk_no int, text string")
    assert corpus.keyword_top(chunks, [("a", "some words")]).collect() == []
    full = spark.createDataFrame([("s", 0, "some words")], chunks.schema)
    assert corpus.retrieve(full, [("a", " ")]).collect() == []
    assert [r.passage for r in corpus.retrieve(full, [("a", "none")]).collect()] == ["[s] some words"]


@pytest.mark.parametrize("block_bytes", [1 << 25, 4000])
def test_any_number_of_query_vectors(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(retrieval, "PRODUCT_CELLS", 20_000)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (500, 6)).astype(float)
    queries = np.concatenate([rng.integers(-2, 3, (1400 if block_bytes > 4000 else 150, 6)), np.zeros((1, 6))]).astype(float)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(900, None)], "id int, v array<double>").repartition(3)
    asked = spark.createDataFrame([(int(i), q.tolist()) for i, q in enumerate(queries)], "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.embedding_top(df, asked, "id", "v", 5, block_bytes).collect()}
    norm = lambda m: m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    similar = np.round(norm(queries) @ norm(vectors).T, 12)
    for i, row in enumerate(similar):
        assert [got[i, r + 1] for r in range(5)] == np.lexsort((np.arange(500), -row))[:5].tolist()


def test_vectors_first_then_terms(spark):
    chunks = spark.createDataFrame([(1, "a", 0, "red apple"), (2, "b", 0, "Red  apple"), (3, "c", 0, "green pear")], "chunk_id long, source string, chunk_no int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(1, "anything"), (2, "pear tree"), (3, " ")], "query_id long, query string")
    own = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0, 0.0])], "query_id long, vector array<double>")
    rows = sorted((r.query_id, r["rank"], r.passage) for r in corpus.retrieve(chunks, asked, 3, vectors, own).collect())
    assert rows == [(1, 1, "[a] red apple"), (1, 3, "[c] green pear"), (2, 1, "[c] green pear")]
