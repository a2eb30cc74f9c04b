"""Toxicity: exact search, held-out accuracy, edge cases."""

import zlib

import numpy as np
from llm_helpers import words
from pyspark.sql import functions as F

from millrace.llm.common import held_out
from millrace.llm.toxicity import BlockMaxIndex, add_scores, features, fit

SF = "/root/testdata/sf0.1"


def test_block_max_search_equals_a_full_scan():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(700):
        t = np.unique(rng.zipf(1.5, rng.integers(1, 12)) % 90).astype(np.int32)
        w = rng.random(len(t)) + 0.01
        vectors.append((t, w / np.sqrt((w * w).sum())))
    vectors += vectors[:80]  # ties
    dense = np.zeros((len(vectors), 90))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = BlockMaxIndex(vectors, 90, block=16)
    for i in range(0, 300, 3):
        cosine = np.round(dense @ dense[i], 12)
        expected = np.lexsort((np.arange(len(cosine)), -cosine))[:25]
        expected = expected[cosine[expected] > 0]
        ids, scores = index.top(*vectors[i], 25)
        assert np.allclose(scores, cosine[expected]) and ids.tolist() == expected.tolist()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    scored = add_scores(docs.select("doc_id", "text"), fit(docs, labels)).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    hits = np.array([(r.score >= 0.5) == (r.toxic == 1) for r in scored])
    toxic = np.array([r.toxic == 1 for r in scored])
    assert len(scored) > 500 and hits.mean() > 0.96 and hits[toxic].mean() > 0.85 and hits[~toxic].mean() > 0.98
    brier = np.mean([(r.score - r.toxic) ** 2 for r in scored])
    assert brier < 0.04  # calibrated: the base rate alone gives about 0.1


def test_edge_cases(spark, make_docs, edge_rows, empty_docs):
    training = [(100 + i, " ".join(words(20, i)) + (" grumbleworst, Grumblewort" if i % 4 == 0 else "")) for i in range(120)]
    docs = make_docs(edge_rows + training + [(500, "you GRUMBLEWURST!!")])
    labels = spark.createDataFrame([(d, int(i % 4 == 0)) for i, (d, _) in enumerate(training)] + [(100, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    assert all(zlib.crc32(str(d).encode()) % 5 for d in model.doc_ids)
    rows = add_scores(docs, model).collect()
    assert len(rows) == len(edge_rows) + len(training) + 1 and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[500].score > 0.5 and by_id[500].evidence[0].toxic == 1
    assert by_id[1].score < 0.5 and by_id[2].score == by_id[1].score and by_id[1].evidence == []
    assert add_scores(empty_docs, model).count() == 0
    nothing = fit(docs, labels.limit(0))
    assert {r.score for r in add_scores(docs, nothing).collect()} == {0.0}


def test_features():
    assert features("%%Idiot!") == {"idiot", "idi-", "idio-", "idiot-"} and features("&&") == set()
