"""PPM code lengths against a plain tree, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ppm
from millrace.llm.common import held_out
from millrace.llm.ppm import LEAD, ORDER, Trees, add_languages, fit, grams, prepared

SF = "/root/testdata/sf0.01"
TEXTS = {"xx": ["the cat sat on the mat", "then the cat ate"], "yy": ["der hund und die katze", "und der hund"]}


def counts(texts):
    out = {}
    for lang, own in texts.items():
        g = np.concatenate([grams(np.frombuffer(LEAD + prepared(t), np.uint8)) for t in own])
        u, n = np.unique(g, return_counts=True)
        out[lang] = (u, n.astype(float))
    return out


def plain_bits(texts, text):
    tree = defaultdict(Counter)
    for t in texts:
        data = LEAD + prepared(t)
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                tree[data[i - k : i]][data[i]] += 1

    def chance(context, b):
        below = (lambda: chance(context[1:], b)) if context else (lambda: 1 / 256)
        c = tree.get(context)
        if not c:
            return below()
        total = sum(c.values()) + len(c)
        return c[b] / total if c[b] else len(c) / total * below()

    data = LEAD + prepared(text)
    return sum(-math.log2(chance(data[i - ORDER : i], data[i])) for i in range(ORDER, len(data)))


def test_code_lengths_are_those_of_plain_trees(monkeypatch):
    trees = Trees(counts(TEXTS))
    probes = ["the hund", "xyzzy 漢字", "", "DER Cat\n\nund", "und die katze " * 30]
    for segment in (1 << 20, 7, 2):
        monkeypatch.setattr(ppm, "SEGMENT", segment)
        got = trees.code_lengths([prepared(p) for p in probes])
        for p, row in zip(probes, got):
            for k, lang in enumerate(trees.languages):
                assert math.isclose(row[k], plain_bits(TEXTS[lang], p), rel_tol=1e-5, abs_tol=1e-6)


def test_every_context_of_the_sample_counts():
    rng = np.random.default_rng(3)
    alphabet = np.array([chr(c) for c in range(33, 127) if not chr(c).isupper()])
    texts = {"large": ["".join(alphabet[rng.integers(len(alphabet), size=120_000)])], "small": TEXTS["xx"]}
    trees = Trees(counts(texts))
    for probe in ("the cat sat", texts["large"][0][-300:]):
        row = trees.code_lengths([prepared(probe)])[0]
        for k, lang in enumerate(trees.languages):
            assert math.isclose(row[k], plain_bits(texts[lang], probe), rel_tol=1e-5)


def test_fewer_contexts_fall_back_to_shorter_ones():
    trees = Trees(counts(TEXTS), cells=600)
    assert trees.n * trees.width <= 600 + trees.width and np.isfinite(trees.code_lengths([b"the unknown"])).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = add_languages(docs, fit(docs)).filter(held_out(F.col("doc_id"))).collect()
    fair = [r for r in rows if r.lang_pred != "und"]
    assert len(fair) > 100 and np.mean([r.lang_pred == r.lang for r in fair]) > 0.97


def test_edge_cases(spark, make_docs, edge_rows, empty_docs):
    docs = make_docs(edge_rows + [(50, "123 !? %%"), (51, "été")]).withColumn("lang_pred", F.lit("clash"))
    training = spark.createDataFrame([(i + 60, t, lang) for lang, own in TEXTS.items() for i, t in enumerate(own * 4)], "doc_id long, text string, lang string")
    learned = fit(training)
    assert set(learned) == {"xx", "yy"}
    rows = {r.doc_id: r for r in add_languages(docs, learned).collect()}
    assert all(r.lang_pred in ("xx", "yy", "und") and 0 <= r.score <= 1 for r in rows.values())
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 50)) and rows[51].lang_pred != "und"
    assert add_languages(empty_docs, learned).count() == 0
    assert {r.lang_pred for r in add_languages(docs, fit(training.limit(0))).collect()} == {"und"}
