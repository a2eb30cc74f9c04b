"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import SCHEMA

from millrace.llm import collocations as colloc
from millrace.llm.collocations import collocations, tile_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top, covered=80):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in held.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    most[p[i : i + size]] = max(most[p[i : i + size]], a)
        rows = []
        for p, a in held.items():
            if 100 * most[p] >= covered * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "Hall", "été", "漢字", "a\x00b", "it's"] + [f"w{i}" for i in range(40)]
    for i in range(n):
        words = [vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", " ; "]) for w in words)
        if rng.random() < 0.3:
            text += " new york city hall of fame"
        yield rng.choice(["en", "en", "en", "de", None, "und"]), text


@pytest.mark.parametrize("shape", ["small", "tiles", "joins"])
def test_all_phrases(spark, monkeypatch, shape):
    docs = [*texts(400, 3), ("fr", None), ("fr", ""), (None, None), ("en", " \t\n"), ("de", "x y " * 20000)] + [("es", "Same text again and again, twice.")] * 40
    df = spark.createDataFrame([(i, t, lang, None, 0) for i, (lang, t) in enumerate(docs)], SCHEMA)
    for name in ("packet", "word", "words", "id", "n", "left", "phrase", "body"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    options = {}
    if shape != "small":
        options = dict(packet_bytes=700, tile_bits=2, fan_in=2)
        monkeypatch.setattr(colloc, "BUCKET_WORDS", 500)
        monkeypatch.setattr(colloc, "HELD", 50)
        monkeypatch.setattr(colloc, "SENT", 200)
    if shape == "joins":
        options["limit"] = (0, 0)
    got = sorted(tuple(r) for r in collocations(df.repartition(5), least=5, top=60, **options).collect())
    assert got == plain(docs, 5, 60)


def test_documents(spark, documents):
    docs = [(r.lang, r.text) for r in documents.collect()]
    assert sorted(tuple(r) for r in collocations(documents).collect()) == plain(docs, 30, 2000)


def test_nothing_to_find(spark, empty_docs, make_docs, edge_rows):
    assert collocations(empty_docs).collect() == []
    assert collocations(make_docs(["a b c", None])).collect() == []
    docs = [("en", t) for _, t in edge_rows]
    assert sorted(tuple(r) for r in collocations(make_docs(edge_rows), least=2).collect()) == plain(docs, 2, 2000)


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 9 * 10**18)], "n long, x long, y long")
    from pyspark.sql import functions as F

    got = colloc._scored(rows, [(F.col("x").cast("decimal(20,0)"), F.col("y").cast("decimal(20,0)"))]).first()
    assert got.score == 1000000


def test_crowded_and_sparse_tiles_agree():
    rng = np.random.default_rng(1)
    left, right = (np.minimum(rng.geometric(0.003, 60000), 5000) for _ in range(2))
    codes = (left.astype(np.int64) << 32) | right
    expected = Counter(codes.tolist())
    for bits in (2, 4, 8, 12):
        found, counts = tile_counts(codes, None, bits)
        assert dict(zip(found.tolist(), counts.tolist())) == expected and len(found) == len(expected)
        again, sums = tile_counts(np.append(found, found), np.append(counts, counts), bits)
        assert dict(zip(again.tolist(), sums.tolist())) == {k: 2 * n for k, n in expected.items()}
