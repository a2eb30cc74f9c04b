"""Ordered distinct lists and differences of maps and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that are opened in one pass over the rows.
LEVELS = 4


def ordered_distinct(*lists: Column) -> Column:
    """Concatenate lists, keeping the first of equal items."""
    return F.array_distinct(F.concat(*lists))


def map_difference(base: Column, overlay: Column) -> Column:
    """Entries of ``overlay`` that ``base`` does not already have with the same value."""
    return F.map_filter(overlay, lambda k, v: ~(F.map_contains_key(base, k) & F.try_element_at(base, k).eqNullSafe(v)))


def json_difference(df: DataFrame, key: str, base: str, overlay: str, levels: int = LEVELS) -> DataFrame:
    """``(key, path, value)`` for every leaf of ``overlay`` that ``base`` lacks or has differently.

    Objects present on both sides are opened until none is left, ``levels`` at a time inside the row;
    anything else is a leaf.
    """

    def members(value: Column) -> Column:
        return F.try_variant_get(value, "$", "map<string,variant>")

    def opened(node: Column) -> Column:
        inside, known = members(node["value"]), members(node["base"])
        children = F.transform(
            F.map_entries(inside),
            lambda e: F.struct(
                F.concat(node["path"], F.lit("."), e["key"]).alias("path"),
                F.try_element_at(known, e["key"]).alias("base"),
                e["value"].alias("value"),
            ),
        )
        return F.when(inside.isNotNull() & known.isNotNull(), children).otherwise(F.array(node))

    rows = df.select(
        key,
        F.array(
            F.struct(
                F.lit("$").alias("path"),
                F.try_parse_json(base).alias("base"),
                F.try_parse_json(overlay).alias("value"),
            )
        ).alias("nodes"),
    )
    leaves = None
    while True:
        for _ in range(levels):
            rows = rows.select(key, F.flatten(F.transform("nodes", opened)).alias("nodes"))
        nodes = rows.select(key, F.explode("nodes").alias("n"))
        both = members(F.col("n.value")).isNotNull() & members(F.col("n.base")).isNotNull()
        done = nodes.where(~both).select(key, "n.path", F.to_json("n.value").alias("value"), F.to_json("n.base").alias("old"))
        leaves = done if leaves is None else leaves.unionByName(done)
        deeper = nodes.where(both)
        if deeper.isEmpty():
            break
        rows = deeper.select(key, F.array("n").alias("nodes"))
    return leaves.where(~F.col("value").eqNullSafe(F.col("old"))).select(key, "path", "value")
