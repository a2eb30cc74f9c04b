"""Graph search against brute force."""

import numpy as np
import pytest
from llm_helpers import SF_DIR

from millrace.llm.hnsw import Graph, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, one_in=20, k=20):
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in valid:
        if q % one_in == 0:
            scored = sorted({(-float((x * v).sum()), i) for i, x in valid if i != q and len(x) == len(v)})
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def engine(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def recall(got, expected):
    return np.mean([len({i for _, i, _ in got.get(q, [])} & {i for _, i, _ in e}) / max(1, len(e)) for q, e in expected.items()])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [5.0, -1.0]), (40, [0.0, 0.0]), (60, None), (10, [-1.0, -2.0]),
    ]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "'x' AS score", "'y' AS shard")
    assert engine(nearest(df)) == brute(rows)
    assert nearest(df.limit(0)).count() == 0


def test_common_vector_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, (base[0] if i % 3 else base[i % 60]).tolist()) for i in range(400)]
    got = engine(nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5), shard_vectors=20))
    assert got == brute(rows)


@pytest.mark.parametrize("scale", [0.0, 1.5])
def test_recall_over_several_shards(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * np.exp(scale * rng.normal(size=(3000, 1)) / 3)
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = engine(nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), shard_vectors=800))
    expected = brute(rows)
    assert recall(got, expected) >= 0.95
    exact = {q: {i: s for _, i, s in e} for q, e in expected.items()}
    assert all(abs(s - exact[q][i]) < 1e-9 for q, found in got.items() for _, i, s in found if i in exact[q])


def test_given_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    got, expected = engine(nearest(df)), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert set(got) == set(expected) and recall(got, expected) >= 0.95


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(3, 5, 5, 9)[i % 4]).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    # Queries are divisible by 10 here, so that they have two of the lengths.
    assert engine(nearest(df, one_in=10, shard_vectors=60)) == brute(rows, one_in=10)


def test_vectors_in_doubles_are_scored_in_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(100, 4)).tolist())]
    got = engine(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == brute(rows)


def cloud(kind, n=4000, d=32):
    rng = np.random.default_rng(6)
    if kind == "uneven norms":
        x = rng.normal(size=(n, d)) * rng.lognormal(0, 1, size=(n, 1))
        return x, x[::20]
    centres = rng.normal(size=(100 if "100" in kind else 16, d))
    x = centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, d))
    return x, rng.normal(size=(200, d)) if "random" in kind else x[::20]


@pytest.mark.parametrize("kind", ["uneven norms", "100 clusters", "100 clusters, random queries", "16 clusters, random queries"])
def test_recall_of_one_graph(kind):
    x, queries = (a.astype(np.float32) for a in cloud(kind))
    found, _ = Graph.build(x).search(queries)
    best = np.argsort(-(queries @ x.T), axis=1)[:, :20]
    each = np.array([len(set(f[:20]) & set(b)) / 20 for f, b in zip(found, best)])
    assert each.mean() >= 0.95 and each.min() > 0


def test_every_node_is_reached():
    x = cloud("16 clusters")[0].astype(np.float32)[:1000]
    graph = Graph.build(x)
    found, _ = graph.search(x[:5], beam=1000)
    assert all(set(f) == set(range(1000)) for f in found)


def test_graph_is_kept_in_flat_arrays():
    x = np.random.default_rng(3).normal(size=(500, 6)).astype(np.float32)
    graph = Graph.build(x)
    again = Graph.load(graph.dump())
    links = [[[set(row[row < 500]) for row in table] for table in g.tables] for g in (graph, again)]
    assert links[0] == links[1] and graph.entry == again.entry and (graph.vectors == again.vectors).all()
    one, _ = Graph.build(x[:1]).search(x[:3])
    assert (one[:, 0] == 0).all()
