"""Token ids in files of independent zstandard frames with a trailing seek table.

A file follows the public seekable-zstd layout: ordinary frames, then a skippable frame that lists every
frame's compressed size, plain size and checksum (the low 32 bits of XXH64), then the number of frames and
a magic number. Every frame but the last holds one document's ids as little-endian unsigned 32-bit
integers, the last one the doc_ids of the file. A reader takes the table from the end of the file and decompresses
only the frames of the documents it wants, checking each.

Files are named by range partition and are in ascending doc_id order, within and across files. A task
writes under a name of its own and renames when the file is whole, so a repeated or a lost task leaves no
torn file.

Defined cases: a null or empty text is a document of the end id only; null doc_ids come first; rows with
one doc_id are separate documents, ordered by their texts; an empty table gives no file and no rows; other
columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import text_encoder
from millrace.session import cut_lineage

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Appends frames to a binary stream and ends it with the seek table."""

    def __init__(self, stream, level: int = LEVEL):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []

    def add(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.stream.write(packed)
        self.entries.append((len(packed), len(data), checksum(data)))

    def close(self) -> None:
        body = np.array(self.entries, dtype=_ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.stream.close()


class FrameReader:
    """Random access to the frames of one file."""

    def __init__(self, stream):
        self.stream, size = stream, stream.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - count * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(start, count * _ENTRY.itemsize), dtype=_ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(length)

    def __len__(self) -> int:
        return len(self.entries)

    def frame(self, k: int) -> bytes:
        entry = self.entries[k]
        data = self.unpacker.decompress(self._at(int(self.offsets[k]), int(entry["packed"])), max_output_size=int(entry["plain"]))
        if len(data) != entry["plain"] or checksum(data) != entry["check"]:
            raise ValueError(f"frame {k} is damaged")
        return data


def pack_ids(doc_ids: list[int | None]) -> bytes:
    known = np.array([d is not None for d in doc_ids], dtype="u1")
    return np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes()


def unpack_ids(data: bytes) -> list[int | None]:
    n = len(data) // 9
    ids, known = np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, n * 8)
    return [int(d) if k else None for d, k in zip(ids, known)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` below ``folder`` and return one row per file: file, part, n_docs, n_ids."""
    end = struct.pack("<I", end_id)

    def write(batches):
        part, name, spool = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():06d}.zst", None
        encoder = text_encoder(tokenizer)
        doc_ids, n_ids, frames = [], 0, None
        fs, root = _open(folder)
        for batch in batches:
            if frames is None:
                fs.create_dir(root)
                spool = f"{root}/_{name}.{uuid.uuid4().hex}"
                frames = FrameWriter(fs.open_output_stream(spool))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                data = ids + end
                frames.add(data)
                doc_ids.append(doc_id)
                n_ids += len(data) // 4
        if frames is not None and doc_ids:
            frames.add(pack_ids(doc_ids))
            frames.close()
            fs.move(spool, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "n_docs": [len(doc_ids)], "n_ids": [n_ids]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut_lineage(ordered.mapInArrow(write, "file string, part int, n_docs long, n_ids long"))


def read_token_files(files: DataFrame, wanted: frozenset | None = None) -> DataFrame:
    """Documents of ``files`` (as ``write_token_files`` returns them), or only those with ``wanted`` ids.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (binary).
    """
    # One row per file; the running sum over them is the only ordered step.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = _open(file)
                with fs.open_input_file(path) as stream:
                    reader = FrameReader(stream)
                    doc_ids = unpack_ids(reader.frame(len(reader) - 1))
                    starts = base + np.concatenate([[0], np.cumsum(reader.entries["plain"][:-1] // 4, dtype=np.int64)])
                    rows, held = [], 0
                    for k, doc_id in enumerate(doc_ids):
                        if wanted is not None and doc_id not in wanted:
                            continue
                        data = reader.frame(k)
                        rows.append((doc_id, int(starts[k]), len(data) // 4, zlib.crc32(data), data))
                        held += len(data)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    # As many partitions as files, stated as a number: the rows are tiny, and without it they would be merged into one task.
    return placed.select("file", "base").repartition(max(1, files.count()), "file").mapInArrow(read, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def document_ids(file: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file, decompressing only their frames."""
    fs, path = _open(file)
    with fs.open_input_file(path) as stream:
        reader = FrameReader(stream)
        wanted = set(doc_ids)
        return {d: np.frombuffer(reader.frame(k), "<u4") for k, d in enumerate(unpack_ids(reader.frame(len(reader) - 1))) if d in wanted}


def token_file_rows(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    files = write_token_files(docs, folder, tokenizer)
    return read_token_files(files).drop("ids")
