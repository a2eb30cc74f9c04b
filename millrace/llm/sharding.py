"""Longest-processing-time sharding: equal texts stay together, large groups are placed first.

Groups are sorted by size and each goes to the least-loaded shard through a heap. The heap runs on the
driver, so what it sees is bounded whatever the input: every group above 1/``LARGE_PER_SHARD`` of a mean
shard is a unit of its own (there can be at most ``shards * LARGE_PER_SHARD`` such groups), and smaller
groups are first dealt by hash into ``BUNDLES`` bundles, which are units too. Shard sizes therefore differ
by about one bundle, except where one group of equal texts alone is larger than a mean shard.

Defined cases: a null text is an empty text (size 1, crc32 0) and stays with the empty texts; null or
repeated doc_ids are rows like any other; an empty table gives no rows; columns that are not needed are
not read, so their names can't clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_digest, with_position
from millrace.session import cut_lineage

LARGE_PER_SHARD = 2048
BUNDLES = 8192


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit: units in descending size (ties: in the given order) to the least load."""
    heap = [(0, shard) for shard in range(shards)]
    placed = [0] * len(sizes)
    for unit in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + sizes[unit], shard))
    return placed


def assign_shards(
    rows: DataFrame, group: str, size: str, shards: int, large_per_shard: int = LARGE_PER_SHARD, bundles: int = BUNDLES
) -> DataFrame:
    """Add ``shard``; rows with equal ``group`` (a binary column without nulls) share one."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(size)).first()[0] or 0
    limit = total / (shards * large_per_shard)
    bundle = F.pmod(F.xxhash64(group), F.lit(bundles)).cast("int")
    groups = rows.groupBy(group).agg(F.sum(size).alias("__size"))
    large = F.col("__size") > limit
    units = (
        groups.groupBy(F.when(large, F.col(group)).alias("__large"), F.when(~large, bundle).alias("__bundle"))
        .agg(F.sum("__size").alias("__size"))
        .collect()
    )
    # Groups of one size are interchangeable; a fixed order makes the result repeatable.
    units.sort(key=lambda u: (u["__large"] or b"", u["__bundle"] if u["__bundle"] is not None else -1))
    shard_of = longest_first([u["__size"] for u in units], shards)
    of_group = [(bytes(u["__large"]), s) for u, s in zip(units, shard_of) if u["__large"] is not None]
    of_bundle = [(u["__bundle"], s) for u, s in zip(units, shard_of) if u["__large"] is None]
    # Both tables are bounded by the parameters above, so they may be broadcast at any scale.
    group_table = F.broadcast(spark.createDataFrame(of_group, "__g binary, __gs int"))
    bundle_table = F.broadcast(spark.createDataFrame(of_bundle, "__b int, __bs int"))
    joined = rows.join(group_table, F.col(group) == F.col("__g"), "left").join(
        bundle_table, bundle == F.col("__b"), "left"
    )
    return joined.select(*rows.columns, F.coalesce("__gs", "__bs").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        text_digest(F.col("text")).alias("__digest"),
    )
    placed = assign_shards(cut_lineage(rows), "__digest", "size", shards).drop("__digest")
    placed = with_position(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
