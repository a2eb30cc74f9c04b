"""Helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage, shared_folder

_LOW_BITS = (1 << 33) - 1


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: every later branch sees the same rows."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def private_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variation of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_digest(text: Column) -> Column:
    """16 bytes that stand for a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the doc_id as text is divisible by ``folds``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def with_position(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the 0-based position of each row inside its group, without bringing a group into one task.

    Rows are range partitioned by (group, order) and fixed on shared storage. A row's position is its
    place in its partition plus the counts of the same group in earlier partitions; that table has at
    most (partitions + groups) rows.
    """
    row, part, base = "__row", "__part", "__base"
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = cut_lineage(placed.withColumn(row, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND(_LOW_BITS))
    pieces = placed.groupBy(*group, part).agg(F.min(row).alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(base, F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first"))
    pieces = pieces.select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col(part).alias("__p"), base)
    same = (F.col(part) == F.col("__p"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    joined = placed.join(pieces, same, "left")
    return joined.select(*df.columns, (F.col(row) + F.col(base)).cast("long").alias(name))


def give_back() -> None:
    """Hand freed memory of this worker back to the system.

    Spark keeps Python workers for later tasks, and neither Arrow nor the C library returns what a task has freed, so an
    executor would hold the sum of all its stages' peaks.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(work):
    """An Arrow worker function that gives its memory back when its task ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def by_row(answer):
    """An Arrow worker function that turns each row (a dict) into a record batch, holding what one row needs at a time."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield answer(batch.slice(i, 1).to_pylist()[0])
                give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
