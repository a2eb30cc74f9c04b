"""Every stage of the pipeline against brute force, on whole small tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline

from test_decontaminate import brute as contamination
from test_tokens import check_packing

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def cut(rows, window=13):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = {}
    for (d, t), w in zip(rows, split):
        gone = {p for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for p in range(i, i + window)}
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.written(stage(spark, out[-1], SF_DIR), "stage"))
    return [df.collect() for df in out]


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    assert all(list(rows[0].asDict()) == COLUMNS for rows in stages[:-1])


def test_toxicity_drops_only_rejected_rows(spark, stages):
    labels = dict(spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic").collect())
    before, after = stages[0], stages[1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert 0 < len(gone) < 0.3 * len(before) and sum(labels.get(d) == 0 for d in gone) <= 1
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    groups = near_groups([(r.doc_id, r.text) for r in before])
    first = {}
    for r, g in zip(before, groups):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    assert len(first) < len(before) and Counter(tuple(r) for r in after) == Counter(tuple(r) for r in before if r.doc_id in first.values())


def test_repeated_passages_go(stages):
    before, after = stages[2], stages[3]
    expected = cut([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == expected and expected != {r.doc_id: r.text for r in before}
    same = {r.doc_id: r for r in before}
    assert all(r.n_chars == (same[r.doc_id].n_chars if r.text == same[r.doc_id].text else len(r.text)) for r in after)


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3], stages[4]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k[0] for k in contamination([(r.doc_id, r.text) for r in before], items) if k[5]}
    assert bad and Counter(tuple(r) for r in after) == Counter(tuple(r) for r in before if r.doc_id not in bad)


def test_pieces_hold_every_id(stages):
    check_packing(stages[5], [(r.doc_id, r.text) for r in stages[4]], 4096)


def test_edge_cases(spark, make_docs, edge_rows, empty_docs):
    docs = make_docs(edge_rows)
    for rows in (docs, empty_docs):
        kept = rows
        for _, stage in pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF_DIR)
            assert kept.columns == rows.columns
        pieces = pipeline.STAGES[-1][1](spark, kept, SF_DIR).count()
        assert pieces == 0 if rows is empty_docs else pieces >= 8
