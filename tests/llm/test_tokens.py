"""Sharding, packing and token files against plain Python."""

import gc
import struct
import sys
import tracemalloc
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import tokens
from millrace.llm.packing import pack_block, pack_documents
from millrace.llm.sharding import longest_first, shard_documents
from millrace.llm.tokenfiles import document_ids, read_token_files, write_token_files
from millrace.llm.tokens import TextEncoder
from millrace.session import arrow_rows

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@lru_cache
def loaded(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def whole(path, text, end=True):
    return loaded(path).encode(text or "", add_special_tokens=False).ids + [2] * end


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_words_give_the_ids_of_the_whole_text(path, edge_rows, documents):
    encoder = TextEncoder(path)
    texts = [t or "" for _, t in edge_rows] + [r.text or "" for r in documents.limit(60).collect()]
    texts += ["a  b", " a", "a ", "a\n\nb", "a \n b", "a\tb", "x  y", "a  b", "x\x1c y", "don't  stop 's", "́a ́b", "tab\t", "a\r\nb"]
    texts += ["İstanbul ΣΑΣ, ΣΑΣ", "A,b A, a, a,, 3, 3,", "x'.s o'.", "Don'T, WE'LL.", "é, É,", "%%% ,, .", "ß. İ İ.", "ǅ ʰ."]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode_many(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole(path, text, False), text[:50]


def test_forgetting_words_changes_nothing(documents, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 500)
    texts = [r.text or "" for r in documents.limit(40).collect()]
    for path in (WORD, BYTE):
        assert TextEncoder(path).encode_many(texts) == [np.array(whole(path, t, False), "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_latin_letter_has_the_ids_of_the_whole_text(path):
    letters = [chr(c) for c in range(0x41, 0x260)]
    texts = [f"{a} x{a} {a}x. {a}{a}?! {a}'s\n{a}\n{a}b, {a} " for a in letters]
    texts += ["a\n", "\na", "\n", "a,\nb", "a\n b", "Ġ Ċ Ċa", "a \u0301b", "ı İ.", "x" * 3000 + ".", "a\vb\n\x1cc d"]
    for text, ids in zip(texts, TextEncoder(path).encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(path, text, False), text


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_are_not_handled_one_by_one(path):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(w) + end for w, end in zip(rng.choice(list("abcdeé"), (2000, 9)), ["", ",", "."] * 667)) for _ in range(15)]
    encoder, calls = TextEncoder(path), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event.endswith("call")

    sys.setprofile(count)
    try:
        encoder.encode_many(texts)
    finally:
        sys.setprofile(None)
    assert calls < 3000  # for 30,000 words, nearly all distinct


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_known_words_take_little_memory(path):
    encoder = TextEncoder(path)
    names = ["".join("abcdefghij"[int(d)] for d in f"{i:06d}") for i in range(60_000)]
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        encoder.encode_many([" ".join(names[i : i + 1000]) for i in range(0, len(names), 1000)])
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert held < 60_000 * 60


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_block_takes_little_memory(path):
    rng = np.random.default_rng(3)
    names = ["".join("abcdefghij"[int(d)] for d in f"{i:04d}") for i in range(5000)]
    texts = [" ".join(names[i] for i in rng.integers(0, 5000, 1000)) for _ in range(400)]
    encoder = TextEncoder(path)
    ids = sum(map(len, encoder.encode_many(texts))) // 4
    tracemalloc.start()
    try:
        encoder.encode_many(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 * ids


def test_batches_of_bounded_rows(spark):
    key, df = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 5000, 1, 1)
    sizes = lambda: [r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect()]
    before = spark.conf.get(key)
    with arrow_rows(spark, 1000):
        inside = sizes()
    assert sum(inside) == 5000 and max(inside) <= 1000 and spark.conf.get(key) == before and max(sizes()) > 1000
    spark.conf.set(key, "10")
    try:
        with arrow_rows(spark, 1000):
            assert max(sizes()) <= 10
        assert spark.conf.get(key) == "10"
    finally:
        spark.conf.set(key, before)


def test_shards_hold_groups_together_and_are_near_equal(make_docs, edge_rows, documents):
    rows = shard_documents(make_docs(edge_rows), shards=4).collect()
    assert len(rows) == len(edge_rows)
    by_text = defaultdict(set)
    texts = {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): t for d, t in edge_rows}
    for r in rows:
        by_text[texts[r.doc_id, r["size"], r.text_crc32] or ""].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    assert all(len(s) == 1 for s in by_text.values())

    rows = shard_documents(documents).collect()
    loads, slots, sizes = defaultdict(int), defaultdict(list), defaultdict(int)
    crc_of = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        sizes[crc_of[r.doc_id] or ""] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # On small tables every group is a unit of its own, so the loads are those of plain LPT.
    order = sorted(sizes.values(), reverse=True)
    expected = [0] * 16
    for n, s in zip(order, longest_first(order, 16)):
        expected[s] += n
    assert max(loads.values()) <= 4 / 3 * max(sum(order) / 16, order[0]) and sorted(loads.values()) == sorted(expected)


def test_bundles_bound_what_the_driver_sees(make_docs):
    docs = make_docs([f"text number {i} " + "x" * (i % 50) for i in range(3000)])
    from millrace.llm import sharding
    from millrace.llm.common import text_digest

    rows = docs.selectExpr("doc_id", "cast(length(text) + 1 as long) AS `__size_of`", "text").withColumn("digest", text_digest(docs.text)).drop("text")
    placed = sharding.assign_shards(rows, "digest", "__size_of", 4, large_per_shard=1, bundles=64)
    loads = [r[1] for r in placed.groupBy("shard").sum("__size_of").collect()]
    assert len(loads) == 4 and max(loads) < 1.1 * min(loads)


def test_empty_tables(empty_docs, tmp_path):
    assert shard_documents(empty_docs).count() == 0
    assert pack_documents(empty_docs, WORD).count() == 0
    assert read_token_files(write_token_files(empty_docs, f"file://{tmp_path}/t", BYTE)).count() == 0


def check_packing(rows, docs, capacity):
    total = sum(len(whole(WORD, t)) for _, t in docs)
    assert sum(r.length for r in rows) == total
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_sequence, by_doc, total


def test_packing_keeps_every_id_once(make_docs, edge_rows):
    docs = [r for r in edge_rows if r[0] not in (9, None)]
    rows = pack_documents(make_docs(docs), WORD, capacity=256, block_sequences=4).collect()
    _, by_doc, _ = check_packing(rows, docs, 256)
    for d, t in docs:
        ids, at = whole(WORD, t), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert len(pack_documents(make_docs(edge_rows), WORD).collect()) >= len(edge_rows)


def test_packing_pads_less_than_one_sequence(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = pack_documents(documents.repartition(7), WORD).collect()
    by_sequence, _, total = check_packing(rows, docs, 4096)
    assert len(by_sequence) == -(-total // 4096)


def test_block_goes_to_the_cheapest_sequence_with_room():
    pieces, over = pack_block([5, 4, 3, 2, 1], 3, capacity=5)
    assert not over and len(pieces) == 5
    assert {(i, s) for i, _, _, s, _ in pieces} == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 1)}
    pieces, over = pack_block([4, 4, 4], 2, capacity=5)
    assert over == [(2, 2)] and sum(p[2] for p in pieces) == 10


def test_token_files_round_trip(spark, make_docs, edge_rows, tmp_path):
    docs = [r for r in edge_rows if r[0] != 9]
    folder = f"file://{tmp_path}/tokens"
    files = write_token_files(make_docs(docs).repartition(3), folder, BYTE)
    got = read_token_files(files).collect()
    assert len(got) == len(docs)
    text = defaultdict(list)
    for d, t in docs:
        text[d].append(whole(BYTE, t))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in text[r.doc_id] and r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((d for d, _ in docs), key=lambda d: -1 if d is None else d)
    some = read_token_files(files, frozenset([5, 7])).collect()
    assert {r.doc_id for r in some} == {5, 7}
    name = next(f.file for f in files.collect())
    stored = document_ids(name, [2, 4])
    assert all(ids.tolist() == whole(BYTE, dict(docs)[d]) for d, ids in stored.items())


def test_damaged_frame_is_noticed(make_docs, tmp_path):
    files = write_token_files(make_docs([(1, "some words in a text " * 50)]), f"file://{tmp_path}/t", BYTE)
    path = files.first().file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        document_ids(path, [1])
