"""Packets: rows in compressed blocks of bounded size, and messages between packets and hash slices.

Substring de-duplication and the Jaccard join both need facts about every word window of a corpus. A row
for each window would cost far more than the windows themselves, so rows are first put into packets (Arrow
record batches, zstd compressed, about ``PACKET_BYTES`` of text each, written to the shared folder). A
packet then sends each slice of the hash space one message with all its windows there, already reduced to
one entry for equal windows, and gets one reply. Slices hold a bounded number of cells, and their number
grows with the corpus, so no message, group or table that goes around grows with it.

``estimate_counts`` is a count-min sketch built this way: every packet's sparse counters are merged slice
by slice, and the merged counter of a window is never below its true count. The counters are one row of
``CELLS_PER_BYTE`` cells for each byte of text, so the share of windows that are overestimated stays the
same (about 3 % of those that occur once) at every size.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_row, give_back, tidy, written

PACKET_BYTES = 4 << 20
CELLS_PER_BYTE = 4
SLICE_BITS = 25
CACHE_WORDS = 100_000
MOST = 65535


# Rows in packets


def pack_rows(docs: DataFrame, label: str, packet_bytes: int = PACKET_BYTES) -> DataFrame:
    """``docs`` (with a column ``text``) as rows packet, n_bytes, body on shared storage."""
    where = docs.columns.index("text")

    def pack(batches):
        first, number = TaskContext.get().partitionId() << 24, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            body = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
            with pa.ipc.new_stream(body, whole.schema, options=options) as out:
                out.write_batch(whole)
            return pa.RecordBatch.from_pydict({"packet": pa.array([first + number], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "body": pa.array([body.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(where)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(batch):
                gone = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, gone + packet_bytes - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - gone
                at = to
                if size >= packet_bytes or at < len(batch):
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return written(docs.mapInArrow(tidy(pack), "packet long, n_bytes long, body binary"), label)


def unpack(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


# Words and windows as numbers


class WordHashes(dict):
    """64-bit hashes of words (bytes), the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i, seed) | 1 for i in range(n)], dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words; the high bits are the good ones."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i, m in enumerate(multipliers(size, seed)):
        out += words[i : i + n] * m
    return out


def starts(*columns: np.ndarray) -> np.ndarray:
    """Of sorted entries: whether each differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


# Messages


def join_parts(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def split_parts(body: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", body)
    sizes = struct.unpack_from(f"<{n}I", body, 4)
    ends = np.cumsum((4 + 4 * n, *sizes))
    return [body[a:b] for a, b in zip(ends[:-1], ends[1:])]


def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as gaps of two bytes, longer gaps in steps, or as they are."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    steps = gaps // 0xFFFF
    if steps.sum() >= len(values):
        return b"\1" + values.astype("<u4").tobytes()
    out = np.full(len(values) + int(steps.sum()), 0xFFFF, dtype="<u2")
    out[np.arange(len(values)) + np.cumsum(steps)] = gaps % 0xFFFF
    return b"\0" + out.tobytes()


def decode_sorted(body: bytes) -> np.ndarray:
    if body[:1] == b"\1":
        return np.frombuffer(body, "<u4", offset=1)
    gaps = np.frombuffer(body, "<u2", offset=1)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 0xFFFF].astype(np.uint32)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def exchange(messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Bring the messages (packet, slice, body) of each slice together and the replies back by packet.

    Returns rows packet, replies (array of struct slice, body).
    """

    def merge(group: pa.Table) -> pa.Table:
        replies = answer(group.column("body").to_pylist())
        give_back()
        return pa.table({"packet": group.column("packet"), "slice": group.column("slice"), "body": pa.array(replies, pa.binary())})

    replies = messages.groupBy("slice").applyInArrow(merge, "packet long, slice int, body binary")
    return replies.groupBy("packet").agg(F.collect_list(F.struct("slice", "body")).alias("replies"))


def replies_of(cell) -> dict[int, bytes]:
    return {r["slice"]: r["body"] for r in cell or []}


# Count-min sketch


def cell_bits(packets: DataFrame) -> int:
    total = packets.agg(F.sum("n_bytes")).first()[0] or 1
    return max(SLICE_BITS, math.ceil(math.log2(total * CELLS_PER_BYTE)))


class Cells:
    """The distinct cells of a packet's hashes, in order, and where each slice begins among them."""

    def __init__(self, hashes: np.ndarray, bits: int):
        cells = hashes >> np.uint64(64 - bits)
        self.order = np.argsort(cells).astype(np.uint32)
        cells = cells[self.order]
        self.new = starts(cells)
        self.cells = cells[self.new]
        self.slices = np.arange(1 << (bits - SLICE_BITS), dtype=np.uint64)
        self.edges = np.append(np.searchsorted(self.cells, self.slices << np.uint64(SLICE_BITS)), len(self.cells))

    def messages(self) -> Iterator[tuple[int, bytes]]:
        firsts = np.append(np.flatnonzero(self.new), len(self.new))
        for s in range(len(self.slices)):
            a, b = self.edges[s], self.edges[s + 1]
            if b > a:
                local = self.cells[a:b] & np.uint64((1 << SLICE_BITS) - 1)
                counts = np.diff(firsts[a : b + 1])
                yield s, join_parts(encode_sorted(local), squeeze(np.minimum(counts, MOST).astype("<u2").tobytes()))

    def estimates(self, replies: dict[int, bytes]) -> np.ndarray:
        """The estimated count of each hash that the object was made from."""
        parts = [np.frombuffer(unsqueeze(replies[s]), "<u2") for s in sorted(replies)]
        out = np.zeros(len(self.order), "<u2")
        if parts:
            out[self.order] = np.concatenate(parts)[np.cumsum(self.new, dtype=np.uint32) - 1]
        return out


def _merge_counts(bodies: list[bytes]) -> list[bytes]:
    cells, counts = [], []
    for body in bodies:
        local, n = split_parts(body)
        cells.append(decode_sorted(local))
        counts.append(np.frombuffer(unsqueeze(n), "<u2"))
    ends = np.cumsum([len(c) for c in cells])
    cells, counts = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cells).astype(np.uint32)
    new = starts(cells[order])
    sums = np.minimum(np.add.reduceat(counts[order], np.flatnonzero(new), dtype=np.uint64), MOST).astype("<u2")
    total = np.empty(len(order), "<u2")
    total[order] = sums[np.cumsum(new, dtype=np.uint32) - 1]
    return [squeeze(part.tobytes()) for part in np.split(total, ends[:-1])]


def message_batch(packet: int, messages: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(messages)
    return pa.RecordBatch.from_pydict({"packet": pa.array([packet] * len(rows), pa.int64()), "slice": pa.array([r[0] for r in rows], pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})


MESSAGE = "packet long, slice int, body binary"


def estimate_counts(packets: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> DataFrame:
    """Rows packet, replies; ``Cells.estimates`` turns them into a count for each hash of the packet.

    ``hashes`` gives the hashes of a packet's rows, in an order that depends on the rows alone.
    """

    def send(row):
        return message_batch(row["packet"], Cells(hashes(unpack(row["body"])), bits).messages())

    return exchange(packets.select("packet", "body").mapInArrow(tidy(by_row(send)), MESSAGE), _merge_counts)
