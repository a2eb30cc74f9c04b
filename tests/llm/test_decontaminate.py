"""Benchmark decontamination against plain Python, and its plan."""

import hashlib
import re
from collections import Counter

import pytest
from llm_helpers import SF_DIR, words

from millrace.llm import decontaminate
from millrace.llm.decontaminate import contamination


def split(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = split(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = Counter()
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in owners if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def engine(df):
    return Counter(tuple(r) for r in df.collect())


ITEMS = [
    (1, " ".join(words(30, 7, "bench"))), (10, "short item"), (2, "Word"), (3, None), (4, "  !! "), (None, " ".join(words(14, 8, "anon"))),
    (5, " ".join(words(13, 9, "exact"))), (5, "second row of five, with the same id"), (6, "the the the the the"), (7, "the the the the the the"),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def planted():
    bench, anon, exact = words(30, 7, "bench"), words(14, 8, "anon"), words(13, 9, "exact")
    noise = words(200, 11, "n")
    return [
        (1, " ".join(noise[:20] + bench + noise[20:40])), (2, " ".join(bench[:12] + noise)), (3, "; ".join(bench[3:17]).upper()),
        (4, " ".join(noise + anon + noise)), (5, " ".join(exact) + " short item"), (6, " ".join(noise * 5 + exact)), (7, "a Word."),
        (8, "the the the the the the the"), (9, "the the the the"), (10, "item short"), (11, "short, item"), (11, "short, item"),
        (12, " ".join(exact[1:] + exact + exact[:5])), (13, "SECOND row of five with the same id"), (14, " ".join(bench)),
    ]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_planted(make_docs, items, edge_rows, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rows = planted() + edge_rows
    assert engine(contamination(make_docs(rows).repartition(3), items)) == brute(rows, ITEMS)


def test_empty_tables(make_docs, items, empty_docs):
    assert contamination(empty_docs, items).count() == 0
    rows = planted()
    assert engine(contamination(make_docs(rows), items.limit(0))) == brute(rows, [])


def test_no_python_in_the_plan(spark, documents, capsys):
    contamination(documents, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
