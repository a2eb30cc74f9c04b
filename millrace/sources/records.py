"""Quoted records of text files that are read in many tasks at once.

A cell in quotes may hold line breaks, so where a record begins depends on all that stands before. A
line, and a whole block of lines, is a function on two states: it says where a reader ends, inside or outside of
quotes, if it came in outside, and if it came in inside. Each block of a file reports its function (one row),
a scan over those rows gives the state every block begins in, and the blocks are then cut into records side by
side. A record that crosses a border is put together from its pieces, of which a block has at most two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.scan import ordered_scan, previous, running_sum
from millrace.session import cut_lineage

#: Blocks that begin inside quotes and are made known by a broadcast; beyond that, lines are joined with them.
KNOWN_BLOCKS = 100_000

_LINES = "file string, block long, line long, value binary"


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, line, value`` (bytes without the line break); lines of a block are in order by ``line``."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").cast("binary").alias("value"),
    )


def ends_inside(line: bytes, inside: bool, sep: bytes, trim: bool = False) -> bool:
    """Whether a reader is inside quotes after ``line``; a quote counts only where a cell begins."""
    at = 0
    if inside:
        at = _closing(line, 0)
        if at < 0:
            return True
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)
    while True:
        if trim:
            while line[at : at + 1] in (b" ", b"\t") and line[at : at + len(sep)] != sep:
                at += 1
        if line[at : at + 1] == b'"':
            at = _closing(line, at + 1)
            if at < 0:
                return True
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _closing(line: bytes, at: int) -> int:
    """The place behind the quote that ends a cell; a doubled quote is part of the cell."""
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return -1
        if line[at + 1 : at + 2] != b'"':
            return at + 1
        at += 2


def _block_functions(sep: bytes, trim: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, in_ = None, False, True
        done: list[tuple] = []
        for batch in batches:
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for file, block, value in zip(files, blocks, batch.column(2)):
                if (file, block) != key:
                    if key is not None:
                        done.append((*key, out, in_))
                    key, out, in_ = (file, block), False, True
                line = value.as_py()
                if b'"' in line:
                    out, in_ = ends_inside(line, out, sep, trim), ends_inside(line, in_, sep, trim)
        if key is not None:
            done.append((*key, out, in_))
        columns = list(zip(*done)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "out", "in"])

    return scan


def blocks_inside(lines: DataFrame, sep: str, trim: bool) -> DataFrame:
    """``file, block`` of the blocks that begin inside quotes."""
    functions = lines.select("file", "block", "value").mapInArrow(_block_functions(sep.encode(), trim), "file string, block long, out boolean, in boolean")
    # The state before a block: what the last constant block gave, turned by each swapping block since.
    constant, swap = F.col("out") == F.col("in"), (F.col("out") & ~F.col("in")).cast("int")
    functions = ordered_scan(cut_lineage(functions), ["file"], ["block"], {"turns": running_sum(swap)})
    given = F.when(constant, F.struct(F.col("out").cast("int").alias("state"), "turns"))
    functions = ordered_scan(functions.withColumn("before", F.col("turns") - swap), ["file"], ["block"], {"given": previous(given)})
    state = (F.coalesce("given.state", F.lit(0)) + F.col("before") - F.coalesce("given.turns", F.lit(0))) % 2
    return functions.where(state == 1).select("file", "block")


def _cut(sep: bytes, trim: bool, known):
    """Pieces ``file, block, line, kind, value``: whole records (0), and what a border cuts: 1 goes on, 2 ends, 3 both."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, late, held, first = None, False, False, [], 0
        for batch in batches:
            rows: list[tuple] = []
            files, blocks, numbers = (batch.column(c).to_pylist() for c in range(3))
            starts = batch.column(4).to_pylist() if known is None else None
            for i, value in enumerate(batch.column(3)):
                if (files[i], blocks[i]) != key:
                    if held:
                        rows.append((*key, first, 1 + 2 * late, b"\n".join(held)))
                    key, held = (files[i], blocks[i]), []
                    inside = late = bool(starts[i]) if starts is not None else key in known.value
                line = value.as_py()
                if not held:
                    first = numbers[i]
                held.append(line)
                if b'"' in line:
                    inside = ends_inside(line, inside, sep, trim)
                if not inside:
                    rows.append((*key, first, 2 * late, b"\n".join(held)))
                    held, late = [], False
            yield _pieces(rows)
        if held:
            yield _pieces([(*key, first, 1 + 2 * late, b"\n".join(held))])

    return scan


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "line", "kind", "value"])


def quoted_records(lines: DataFrame, sep: str = ",", trim: bool = False, known_blocks: int = KNOWN_BLOCKS) -> DataFrame:
    """``file, block, line, value``: the records of every file; ``block, line`` orders them inside a file."""
    starts = cut_lineage(blocks_inside(lines, sep, trim))
    schema = "file string, block long, line long, kind int, value binary"
    if starts.limit(known_blocks + 1).count() <= known_blocks:
        known = lines.sparkSession.sparkContext.broadcast({(r["file"], r["block"]) for r in starts.collect()})
        pieces = lines.mapInArrow(_cut(sep.encode(), trim, known), schema)
    else:
        marked = lines.join(starts.withColumn("__late", F.lit(True)), ["file", "block"], "left")
        marked = marked.repartition("file", "block").sortWithinPartitions("file", "block", "line")
        pieces = marked.select("file", "block", "line", "value", "__late").mapInArrow(_cut(sep.encode(), trim, None), schema)
    whole = pieces.where("kind = 0").select("file", "block", "line", "value")
    # A file's cut pieces are at most two for each block.
    cut = cut_lineage(pieces.where("kind > 0"))
    cut = ordered_scan(cut, ["file"], ["block", "line"], {"record": running_sum((F.col("kind") == 1).cast("int"))})
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = cut.groupBy("file", "record").agg(parts.alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"),
        F.array_join(F.transform("parts", lambda p: F.hex(p["value"])), "0A").alias("value"),
    )
    return whole.unionByName(joined.withColumn("value", F.unhex("value")))
