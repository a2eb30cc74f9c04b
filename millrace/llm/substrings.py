"""Removal of passages that an earlier document has, word for word.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a
smaller doc_id. Three passes over packets of documents:

1. a count-min sketch of all windows; its merged counters never underestimate, so a window whose counter
   is 1 occurs once and is left out of everything that follows, and none that repeats is lost;
2. the windows left are grouped exactly (by a 96-bit fingerprint of the 13 words) and each packet learns
   which of its windows start in a smaller document elsewhere;
3. each packet joins that with the order of its own documents and removes the covered words.

A passage in very many documents is one entry for each packet, so no group grows with its copies.

Defined cases: a null text has no words and stays null; a document of fewer words than a window keeps all;
a null doc_id is larger than every other, and equal doc_ids are not smaller than each other; an empty table
gives no rows; other columns are returned as they are, but for one that is named as a measure, which is
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm import packets as P
from millrace.llm.common import by_row, tidy
from millrace.session import cut_lineage

WINDOW = 13
_NO_ID = np.iinfo(np.int64).max


class _Windows:
    """All windows of a packet: two hashes, the document and the first word of each."""

    def __init__(self, batch: pa.RecordBatch, window: int, cache: P.WordHashes):
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        hashes = [cache.of((t.as_py() or b"").split()) for t in texts]
        self.texts, self.n_words = texts, np.array([len(h) for h in hashes], dtype=np.int64)
        words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        del hashes
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        self.doc_ids = np.array([_NO_ID if d is None else d for d in ids.to_pylist()], dtype=np.int64)
        ends = np.cumsum(self.n_words, dtype=np.int32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_words)
        left = ends[owner] - np.arange(len(words), dtype=np.int32)
        self.at = np.flatnonzero(left >= window).astype(np.int32)
        del left
        self.doc = owner[self.at]
        del owner
        self.first = P.window_hashes(words, window, 1)[self.at]
        self.words, self.window, self.n = words, window, len(words)

    def second(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chosen), dtype=np.uint64)
        for i, m in enumerate(P.multipliers(self.window, 2)):
            out += self.words[self.at[chosen] + i] * m
        return (out >> np.uint64(32)).astype(np.uint32)


class _Repeats:
    """The windows of a packet that the sketch reports as repeated, one entry for equal ones."""

    def __init__(self, w: _Windows, replies: dict[int, bytes], bits: int):
        self.chosen = np.flatnonzero(P.Cells(w.first, bits).estimates(replies) > 1).astype(np.int32)
        h1, h2, ids = w.first[self.chosen], w.second(self.chosen), w.doc_ids[w.doc[self.chosen]]
        order = np.lexsort((ids, h2, h1)).astype(np.uint32)
        h1, h2, ids = h1[order], h2[order], ids[order]
        new = P.starts(h1, h2)
        self.group = np.empty(len(order), dtype=np.int32)
        self.group[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        self.h1, self.h2, self.least = h1[new], h2[new], ids[new]
        n_slices = 1 << (bits - P.SLICE_BITS)
        self.edges = np.append(np.searchsorted(self.h1, np.arange(n_slices, dtype=np.uint64) << np.uint64(64 - (bits - P.SLICE_BITS))) if n_slices > 1 else [0], len(self.h1))

    def messages(self):
        for s in range(len(self.edges) - 1):
            a, b = self.edges[s], self.edges[s + 1]
            if b > a:
                base = int(self.least[a:b].min())
                near = self.least[a:b] - base
                kind = "<u4" if near.max() < 1 << 32 else "<i8"
                yield s, P.join_parts(self.h1[a:b].tobytes(), self.h2[a:b].tobytes(), kind.encode(), base.to_bytes(8, "little", signed=True), near.astype(kind).tobytes())

    def smaller_elsewhere(self, replies: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.h1), dtype=bool)
        for s, body in replies.items():
            a, b = self.edges[s], self.edges[s + 1]
            out[a:b] = np.unpackbits(np.frombuffer(body, "u1"), count=b - a)
        return out


def _least_elsewhere(bodies: list[bytes]) -> list[bytes]:
    h1, h2, least = [], [], []
    for body in bodies:
        a, b, kind, base, near = P.split_parts(body)
        h1.append(np.frombuffer(a, np.uint64))
        h2.append(np.frombuffer(b, np.uint32))
        least.append(np.frombuffer(near, kind.decode()).astype(np.int64) + int.from_bytes(base, "little", signed=True))
    ends = np.cumsum([len(x) for x in h1])
    h1, h2, least = np.concatenate(h1), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((least, h2, h1)).astype(np.uint32)
    new = P.starts(h1[order], h2[order])
    del h1, h2
    least = least[order]
    flag = np.empty(len(order), dtype=bool)
    flag[order] = least > least[new][np.cumsum(new, dtype=np.uint32) - 1]
    return [np.packbits(part).tobytes() for part in np.split(flag, ends[:-1])]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, measures: tuple[str, str] = ("n_words", "n_removed"), rejoin: bool = True) -> DataFrame:
    """``docs`` with ``text`` cut to the kept words, and two measures: words before, words removed.

    Kept words are joined by one space; with ``rejoin=False`` a text that loses nothing stays as it is.
    """
    docs = docs.select([c for c in docs.columns if c not in measures])
    packets = P.pack_rows(docs, "substring-packets")
    bits = P.cell_bits(packets)

    def first_hashes(batch, cache=P.WordHashes()):
        return _Windows(batch, window, cache).first

    counts = cut_lineage(P.estimate_counts(packets, first_hashes, bits).withColumnRenamed("replies", "counts"))
    counted = packets.join(counts, "packet", "left").select("packet", "body", "counts")

    def send(row, cache=P.WordHashes()):
        w = _Windows(P.unpack(row["body"]), window, cache)
        return P.message_batch(row["packet"], _Repeats(w, P.replies_of(row["counts"]), bits).messages())

    smaller = P.exchange(counted.mapInArrow(tidy(by_row(send)), P.MESSAGE), _least_elsewhere)
    schema = StructType([*docs.schema.fields, *[StructField(m, LongType()) for m in measures]])
    text_at = docs.columns.index("text")

    def cut(row, cache=P.WordHashes()):
        rows = P.unpack(row["body"])
        w = _Windows(rows, window, cache)
        r = _Repeats(w, P.replies_of(row["counts"]), bits)
        # In another packet, or here: not the smallest document of the packet that has the window.
        gone = r.smaller_elsewhere(P.replies_of(row["replies"]))[r.group] | (w.doc_ids[w.doc[r.chosen]] > r.least[r.group])
        starts = w.at[r.chosen[gone]]
        del r, gone
        size = w.n + window + 1
        opened = np.bincount(starts, minlength=size) - np.bincount(starts + window, minlength=size)
        covered = np.cumsum(opened)[: w.n] > 0
        del opened
        texts, removed, at = [], [], 0
        for text, n in zip(w.texts.to_pylist(), w.n_words):
            mask = covered[at : at + n]
            at += n
            lost = int(mask.sum())
            removed.append(lost)
            if text is not None and (lost or rejoin):
                text = b" ".join([x for x, m in zip(text.split(), mask) if not m] if lost else text.split())
            texts.append(text)
        columns = list(rows.columns)
        columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(w.n_words), pa.array(removed, pa.int64())], names=schema.names)

    return counted.join(smaller, "packet", "left").mapInArrow(tidy(by_row(cut)), schema)
