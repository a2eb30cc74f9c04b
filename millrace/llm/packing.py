"""Cost-balanced packing of token ids into training sequences.

A piece of n ids costs ``LINEAR * n + QUADRATIC * n * n``: the layers that are linear in length, and
attention inside the piece. Documents of a block are taken in descending order; each goes to the sequence
with the lowest cost so far that still has room. What fits nowhere whole is cut to fill the largest rooms,
so every sequence of a block gets full and only the remainder moves on to the next block.

Each task packs the documents it reads, block by block, without moving texts. What is left at its end
(less than one sequence) carries its ids to a second pass that packs the leftovers of many tasks together.
So padding is at most one sequence for each ``LEFTOVERS`` tasks.

Defined cases: a null or empty text is a document of the end id only; null and repeated doc_ids are
separate documents; an empty table gives no rows; a text longer than a sequence fills sequences of its own
and its rest is packed like a document; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import tidy, written
from millrace.llm.tokens import text_encoder
from millrace.session import arrow_rows

MAX_TOKENS = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BLOCK_SEQUENCES = 256
BATCH_ROWS = 1000
LEFTOVERS = 512

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KINDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def pack_block(lengths: list[int], sequences: int, capacity: int = MAX_TOKENS) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Pack lengths (none above ``capacity``) into so many sequences.

    Returns pieces (item, start, length, sequence, offset) and the parts (item, start) that found no room.
    """
    room = np.full(sequences, capacity, dtype=np.int64)
    spent = np.zeros(sequences)
    pieces, over = [], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = np.flatnonzero(room >= left)
            if len(fits):
                s, n = int(fits[np.argmin(spent[fits])]), left
            else:
                s = int(np.argmax(room)) if sequences else 0
                if not sequences or not room[s]:
                    over.append((item, start))
                    break
                n = int(room[s])
            pieces.append((item, start, n, s, int(capacity - room[s])))
            room[s] -= n
            spent[s] += cost(n)
            start, left = start + n, left - n
    return pieces, over


class _Packer:
    """Collects parts of documents and hands out finished pieces, block by block."""

    def __init__(self, first_sequence: int, capacity: int):
        self.capacity, self.next = capacity, first_sequence
        self.parts: list[tuple] = []  # doc_id, start in the document, ids, doc_tokens
        self.held, self.rows = 0, []

    def piece(self, doc_id, start, ids: bytes, total, sequence, offset) -> None:
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        full = len(ids) // 4 // self.capacity
        for k in range(full):
            self.piece(doc_id, start + k * self.capacity, ids[4 * k * self.capacity : 4 * (k + 1) * self.capacity], total, self.next, 0)
            self.next += 1
        rest = ids[4 * full * self.capacity :]
        if rest:
            self.parts.append((doc_id, start + full * self.capacity, rest, total))
            self.held += len(rest) // 4

    def pack(self, sequences: int) -> None:
        pieces, over = pack_block([len(p[2]) // 4 for p in self.parts], sequences, self.capacity)
        for item, start, n, s, offset in pieces:
            doc_id, first, ids, total = self.parts[item]
            self.piece(doc_id, first + start, ids[4 * start : 4 * (start + n)], total, self.next + s, offset)
        self.next += sequences
        kept = [(self.parts[i], start) for i, start in over]
        self.parts = [(p[0], p[1] + start, p[2][4 * start :], p[3]) for p, start in kept]
        self.held = sum(len(p[2]) // 4 for p in self.parts)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _pieces(rows: list[tuple], ids: list[bytes | None]) -> pa.RecordBatch:
    columns = {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(_KINDS)}
    return pa.RecordBatch.from_pydict(columns | {"ids": pa.array(ids, pa.binary())})


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = MAX_TOKENS, end_id: int = 2, block_sequences: int = BLOCK_SEQUENCES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = struct.pack("<I", end_id)

    def first(batches):
        # Sequence numbers of a task lie in a range of its own.
        packer = _Packer((TaskContext.get().partitionId() + 1) << 32, capacity)
        encoder = text_encoder(tokenizer)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids += end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if packer.held >= block_sequences * capacity:
                    packer.pack(packer.held // capacity)
            rows = packer.taken()
            yield _pieces(rows, [None] * len(rows))
        packer.pack(packer.held // capacity)
        rows, loose = packer.taken(), packer.parts
        yield _pieces(rows, [None] * len(rows))
        yield _pieces([(d, s, len(i) // 4, zlib.crc32(i), t, None, None) for d, s, i, t in loose], [p[2] for p in loose])

    def second(batches):
        packer = _Packer((1 << 62) + (TaskContext.get().partitionId() << 32), capacity)
        for batch in batches:
            for row in batch.to_pylist():
                packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
                if packer.held >= block_sequences * capacity:
                    packer.pack(packer.held // capacity)
        packer.pack(-(-packer.held // capacity))
        rows = packer.taken()
        yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(_KINDS)})

    source = docs.select("doc_id", "text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):  # texts are long, and a task holds a batch in the JVM and in Python
        placed = written(source.mapInArrow(tidy(first), PIECE + ", ids binary"), "pieces")
    names = [name for name, _ in _KINDS]
    packed = placed.filter(F.col("sequence_id").isNotNull()).select(names)
    loose = placed.filter(F.col("sequence_id").isNull())
    # Each of these tasks gets the leftovers of about LEFTOVERS tasks: under LEFTOVERS * capacity ids.
    tasks = -(-source.rdd.getNumPartitions() // LEFTOVERS)
    return packed.unionByName(loose.coalesce(tasks).mapInArrow(tidy(second), PIECE))
