"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

Documents are indexed in segments: postings (document, term frequency) of the terms that any query has, with
each document's length. The counts of the whole table (documents, their terms, documents of each term) are
sums over the segments, so every text is read once. A query is then answered in every segment:

1. the postings of its short lists are added up per document (term at a time). The sums, in document order
   and with their maximum, are one more iterator beside the long lists;
2. documents are taken in order, a range at a time. Every iterator has an upper bound in a range. The
   iterators whose bounds together lie below the score of the best 50 so far can't bring a document in by
   themselves: their postings are skipped, and only looked up for documents that others bring in, largest
   bound first, as long as a document can still reach the limit. Where all bounds together are too low the
   range is skipped.

A task keeps the best of each query over all its segments, which are what is shuffled: at most (tasks x queries x
50) rows. Queries are handled in blocks of about ``BLOCK_TERMS`` (query, term) pairs, so what is broadcast has
a bound; each block reads the texts once. Terms longer than 64 bytes stand for themselves by a digest.

Defined cases: a null or empty text has no terms and is not counted; rows with one item_id are one query with the
terms of all of them, also those without item_id; documents without doc_id come last among equal scores;
rows with equal doc_id are documents like any other; texts of any length are read whole; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.packets import join_parts, split_parts, squeeze, unsqueeze

TOP = 50
#: A list is short if it has at most one posting for so many documents of the segment.
SHORT = 16
RANGE = 4096
SEGMENT_DOCS, SEGMENT_TERMS = 1 << 16, 1 << 22
BLOCK_TERMS = 400_000
TEXT_PART = 1 << 20
LONG_TERM = 64
NO_DOC = np.iinfo(np.int64).max

_TERM_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_LOWERED = bytes(range(256)).lower()
TRANSLATE = bytes(c if c in _TERM_BYTES else 32 for c in _LOWERED)


# Terms


def term_parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in parts that bound the memory of a very long one."""
    text = text.translate(TRANSLATE)
    at = 0
    while len(text) - at > TEXT_PART:
        to = text.find(b" ", at + TEXT_PART)
        if to < 0:
            break
        yield text[at:to].split()
        at = to
    yield text[at:].split() if at else text.split()


def term_key(term: bytes) -> bytes:
    return term if len(term) <= LONG_TERM else b" " + hashlib.md5(term).digest()


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct rows item, term of the queries."""
    kind = items.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for item, value in zip(batch.column(0), batch.column(1)):
                terms = sorted({term_key(t) for part in term_parts(value.as_buffer().to_pybytes()) for t in part})
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), batch.schema.field(0).type), pa.array(terms, pa.binary())], ["item", "term"])

    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text")).filter("text <> ''")
    return rows.mapInArrow(cut, f"item {kind}, term binary").distinct()


# Segments


def _segment(number: int, ids: list, lengths: list, terms: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    n = len(ids)
    pairs, tfs = np.unique(np.concatenate(terms).astype(np.int64) * n + np.concatenate(owners), return_counts=True)
    term, doc = np.divmod(pairs, n)
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    known, dfs = term[begins], np.diff(np.append(begins, len(term)))
    ids = np.array([NO_DOC if i is None else i for i in ids], np.int64)
    body = join_parts(*(squeeze(a.tobytes()) for a in (ids, np.array(lengths, np.int64), doc.astype(np.int32), tfs.astype(np.int64))))
    row = {"segment": [number], "n_docs": [n], "n_terms": [sum(lengths)], "terms": [known], "dfs": [dfs], "body": [body]}
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(row.items(), kinds)})


def build_segments(docs: DataFrame, vocabulary: list[bytes], segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Rows segment, n_docs, n_terms, terms, dfs, body: postings of the terms (by place in ``vocabulary``)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches):
        number = TaskContext.get().partitionId() << 24
        place = {term: i for i, term in enumerate(known.value)}
        digests = any(term.startswith(b" ") for term in place)
        ids, lengths, terms, owners, held = [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = 0
                for words in term_parts(text.as_buffer().to_pybytes()):
                    n += len(words)
                    found = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
                    if digests:
                        for i, w in enumerate(words):
                            if len(w) > LONG_TERM:
                                found[i] = place.get(term_key(w), -1)
                    found = found[found >= 0]
                    terms.append(found)
                    owners.append(np.full(len(found), len(ids), np.int64))
                    held += len(found)
                if n:
                    ids.append(doc)
                    lengths.append(n)
                if len(ids) >= segment_docs or (held >= SEGMENT_TERMS and n):
                    yield _segment(number, ids, lengths, terms, owners)
                    ids, lengths, terms, owners, held, number = [], [], [], [], 0, number + 1
        if ids:
            yield _segment(number, ids, lengths, terms, owners)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    schema = "segment long, n_docs long, n_terms long, terms array<int>, dfs array<long>, body binary"
    return written(rows.mapInArrow(build, schema), "lexical-segments")


# Search


class Best:
    """The ``k`` best documents of one query so far, by score and then by doc_id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def limit(self) -> int:
        """A document with a smaller score can't enter."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Segment:
    """Postings of one segment with the score each of them adds, in integers."""

    def __init__(self, terms: np.ndarray, dfs: np.ndarray, body: bytes, weights: np.ndarray, n_docs: int, n_terms: int):
        ids, lengths, docs, tfs = (unsqueeze(p) for p in split_parts(body))
        self.ids, lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
        self.docs, tfs = np.frombuffer(docs, np.int32), np.frombuffer(tfs, np.int64)
        m = 50 + (50 * lengths * n_docs) // n_terms
        self.scores = np.repeat(weights[terms], dfs) * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[self.docs]))
        ends = np.cumsum(dfs)
        self.lists = {int(t): slice(int(b - n), int(b)) for t, b, n in zip(terms, ends, dfs)}
        self.cuts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def ranged(self, term: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each range of documents begins in a list, and the largest score in each range."""
        if (term, size) not in self.cuts:
            own = self.lists[term]
            starts = np.arange(0, len(self.ids) + size, size)
            edges = own.start + np.searchsorted(self.docs[own], starts)
            most = np.zeros(len(edges) - 1, np.int64)
            full = np.flatnonzero(edges[1:] > edges[:-1])
            if len(full):
                most[full] = np.maximum.reduceat(self.scores[: edges[-1]], edges[full])
            self.cuts[term, size] = edges, most
        return self.cuts[term, size]

    def search(self, query: list[int], best: Best, size: int = RANGE, short: int = SHORT) -> None:
        terms = [t for t in query if t in self.lists]
        few = len(self.ids) / short
        summed = [self.lists[t] for t in terms if self.lists[t].stop - self.lists[t].start <= few]
        long = [t for t in terms if self.lists[t].stop - self.lists[t].start > few]
        docs, sums = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if summed:
            docs = np.concatenate([self.docs[s] for s in summed])
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            begins = np.flatnonzero(np.diff(docs, prepend=-1))
            sums = np.add.reduceat(np.concatenate([self.scores[s] for s in summed])[order], begins)
            docs = docs[begins]
        cuts = np.searchsorted(docs, np.arange(0, len(self.ids) + size, size))
        ranged = [self.ranged(t, size) for t in long]
        for r in range(len(cuts) - 1):
            a, b = cuts[r], cuts[r + 1]
            bounds = sorted(((int(most[r]), edges[r], edges[r + 1]) for edges, most in ranged if most[r]), reverse=True)
            rest = sum(x[0] for x in bounds)
            if (int(sums[a:b].max()) if b > a else 0) + rest < best.limit:
                continue
            found, score, i = docs[a:b], sums[a:b], 0
            if rest >= best.limit:  # the first long lists can bring in a document without the sums
                dense = np.zeros(size, np.int64)
                dense[found - r * size] = score
                while rest >= best.limit:
                    bound, x, y = bounds[i]
                    dense[self.docs[x:y] - r * size] += self.scores[x:y]
                    rest -= bound
                    i += 1
                found = np.flatnonzero(dense)
                score = dense[found]
                found = found + r * size
            for bound, x, y in bounds[i:]:
                near = score + rest >= best.limit
                found, score = found[near], score[near]
                if not len(found):
                    break
                own = self.docs[x:y]
                at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                score = score + np.where(own[at] == found, self.scores[x:y][at], 0)
                rest -= bound
            near = score >= best.limit
            if near.any():
                best.offer(score[near], self.ids[found[near]])


def search_segments(segments: DataFrame, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int = TOP, size: int = RANGE) -> DataFrame:
    """Rows query, doc_id, score: the ``k`` best of each query among a task's segments."""
    shared = segments.sparkSession.sparkContext.broadcast((queries, weights))

    def answer(batches):
        queries, weights = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for terms, dfs, body in zip(batch.column(0), batch.column(1), batch.column(2)):
                if len(terms.values):
                    segment = Segment(terms.values.to_numpy(), dfs.values.to_numpy(), body.as_py(), weights, n_docs, n_terms)
                    for query, own in zip(queries, best):
                        segment.search(query, own, size)
        for i, own in enumerate(best):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.ids), i), pa.int32()), pa.array(own.ids, pa.int64(), mask=own.ids == NO_DOC), pa.array(own.scores, pa.int64())], ["query", "doc_id", "score"])

    return segments.select("terms", "dfs", "body").mapInArrow(answer, "query int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, segment_docs: int = SEGMENT_DOCS, size: int = RANGE) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    wanted = written(query_terms(items), "query-terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    item_kind = wanted.schema["item"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        grouped: dict = {}
        for r in own.collect():  # about block_terms rows
            grouped.setdefault(r["item"], []).append(bytes(r["term"]))
        if not grouped:
            continue
        vocabulary = sorted({t for terms in grouped.values() for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        segments = build_segments(docs, vocabulary, segment_docs)
        n_docs, n_terms = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        pairs = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.dfs").alias("df"))
        dfs = np.zeros(len(vocabulary), np.float64)
        for term, df in pairs.collect():
            dfs[term] = df
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * dfs + 1))).astype(np.int64)
        names = sorted(grouped, key=lambda x: (x is None, str(x)))
        queries = [sorted(place[t] for t in grouped[name]) for name in names]
        found = search_segments(segments, queries, weights, n_docs, n_terms, k, size)
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        named = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"query int, item_id {item_kind}"))
        out = out.unionByName(found.join(named, "query").select("item_id", "rank", "doc_id", "score"))
    return out
