"""Packets, the sketch and substring removal against plain Python."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import packets as P
from millrace.llm import substrings as S
from millrace.llm.common import by_row
from millrace.llm.substrings import dedup_substrings

NONE = 1 << 63


def brute(rows, window=13):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, NONE), NONE if d is None else d)
    out = Counter()
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (NONE if d is None else d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def engine(df):
    rows = df.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return Counter(tuple(r) for r in rows.collect())


def test_edge_cases(make_docs, edge_rows):
    assert engine(dedup_substrings(make_docs(edge_rows).repartition(3))) == brute(edge_rows)


def test_whole_small_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = brute(rows)
    assert sum(k[2] for k in expected) > 1000
    assert engine(dedup_substrings(documents.repartition(5))) == expected


def test_small_packets_and_clashing_columns(make_docs, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i % 7 :] + [f"x{i}"])) for i in range(40)]
    docs = make_docs(rows).withColumn("n_words", F.lit("clash"))
    got = dedup_substrings(docs.repartition(4))
    assert set(docs.columns) | {"n_words", "n_removed"} == set(got.columns)
    assert engine(got) == brute(rows)


def test_text_without_loss_can_stay(make_docs):
    got = dedup_substrings(make_docs([(1, "a  b\nc")]), rejoin=False).first()
    assert got.text == "a  b\nc" and got.n_removed == 0


def test_empty_table(empty_docs):
    assert dedup_substrings(empty_docs).count() == 0


def test_sketch_never_underestimates(spark, documents):
    packets = P.pack_rows(documents.repartition(6), "t", packet_bytes=20_000)
    assert packets.count() > 10

    def hashes(batch):
        cache = P.WordHashes()
        return np.concatenate([cache.of((t or "").encode().split()) for t in batch.column("text").to_pylist()] + [np.zeros(0, np.uint64)])

    bits = P.cell_bits(packets)
    replies = {r["packet"]: P.replies_of(r["replies"]) for r in P.estimate_counts(packets, hashes, bits).collect()}
    found, true = defaultdict(set), Counter()
    for r in packets.collect():
        h = hashes(P.unpack(r["body"]))
        true.update(h.tolist())
        for x, n in zip(h.tolist(), P.Cells(h, bits).estimates(replies[r["packet"]]).tolist()):
            found[x].add(n)
    assert all(len(n) == 1 and min(n) >= min(true[x], P.MOST) for x, n in found.items())
    assert sum(min(n) != min(true[x], P.MOST) for x, n in found.items()) < 0.05 * len(found)


def test_gap_coding():
    rng = np.random.default_rng(3)
    for top in (10, 70_000, 1 << 27, (1 << 32) - 1):
        for n in (0, 1, 2, 500):
            values = np.unique(rng.integers(0, top, n, dtype=np.int64)).astype(np.uint64)
            assert P.decode_sorted(P.encode_sorted(values)).tolist() == values.tolist()
    values = np.array([0, 65535, 65536, 131071, 196606], dtype=np.uint64)
    assert P.decode_sorted(P.encode_sorted(values)).tolist() == values.tolist()


def test_many_slices(documents, monkeypatch):
    monkeypatch.setattr(P, "SLICE_BITS", 15)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert P.cell_bits(P.pack_rows(documents, "t")) >= 20
    assert engine(dedup_substrings(documents.repartition(5))) == brute(rows)


def test_a_packet_takes_little_memory():
    """Peaks of what a worker allocates for a packet, in bytes for each byte of text."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 2000)) for _ in range(25)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": texts + texts[:5]})
    cache, bits = P.WordHashes(), P.SLICE_BITS + 2
    first = lambda: dict(P.Cells(S._Windows(batch, 13, cache).first, bits).messages())
    messages = first()
    counts = {s: P._merge_counts([m, m])[0] for s, m in messages.items()}
    second = lambda: dict(S._Repeats(S._Windows(batch, 13, cache), counts, bits).messages())
    for work, most in ((first, 9), (second, 16)):
        tracemalloc.start()
        try:
            work()
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < most * sum(map(len, batch.column("text").to_pylist()))


def test_rows_of_a_batch_are_held_one_at_a_time():
    batch = pa.RecordBatch.from_pydict({"packet": list(range(8)), "body": [bytes(1 << 20)] * 8})

    def answer(row):
        assert len(row["body"]) == 1 << 20
        return pa.RecordBatch.from_pydict({"packet": [row["packet"]]})

    tracemalloc.start()
    try:
        out = [r.column(0)[0].as_py() for r in by_row(answer)([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out == list(range(8)) and peak < 4 << 20
