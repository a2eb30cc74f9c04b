"""Ordered scans (running sums, carry-forward, previous row) that survive a hot group.

A plain window puts a whole group into one task. Groups are therefore counted first: while
every group stays under ``hot_rows`` the plain window is used, otherwise the rows are range
partitioned by (group, order), scanned inside each partition, and joined with the state that
the earlier partitions of the same group hand over. The handed-over table has at most one row
per group and partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

HOT_ROWS = 2_000_000

_PART = "__part"
_GROUP = "__group"


@dataclass(frozen=True)
class Scan:
    """One output of an ordered scan over the rows of a group.

    ``kind`` is one of
    ``running_sum``  sum of ``value`` over the rows up to and including this one,
    ``row_number``   1-based position,
    ``last``         latest non-null ``value`` up to and including this row,
    ``previous``     latest non-null ``value`` strictly before this row,
    ``following``    first non-null ``value`` strictly after this row.
    """

    kind: str
    value: Column | None = None


def running_sum(value: Column) -> Scan:
    return Scan("running_sum", value)


def row_number() -> Scan:
    return Scan("row_number", F.lit(1))


def last(value: Column) -> Scan:
    return Scan("last", value)


def previous(value: Column) -> Scan:
    return Scan("previous", value)


def following(value: Column) -> Scan:
    return Scan("following", value)


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Row count of the biggest group (map-side combined, one row comes back)."""
    counts = df.groupBy(*by).count() if by else df.groupBy().count()
    return counts.agg(F.max("count")).first()[0] or 0


def _window_column(scan: Scan, value: Column, forward, backward) -> Column:
    before_and_here = (Window.unboundedPreceding, Window.currentRow)
    strictly_before = (Window.unboundedPreceding, -1)
    if scan.kind in ("running_sum", "row_number"):
        return F.sum(value).over(forward.rowsBetween(*before_and_here))
    if scan.kind == "last":
        return F.last(value, ignorenulls=True).over(forward.rowsBetween(*before_and_here))
    if scan.kind == "previous":
        return F.last(value, ignorenulls=True).over(forward.rowsBetween(*strictly_before))
    if scan.kind == "following":
        return F.last(value, ignorenulls=True).over(backward.rowsBetween(*strictly_before))
    raise ValueError(f"unknown scan kind {scan.kind!r}")


def ordered_scan(
    df: DataFrame,
    by: list[str],
    order: list[str],
    outputs: dict[str, Scan],
    hot_rows: int = HOT_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Add one column per entry of ``outputs``. ``order`` must be unique inside a group.

    ``at_most`` is an upper bound of the group sizes when the caller knows one, for instance from
    a coarser grouping; it saves the counting pass.
    """
    if at_most is None or at_most > hot_rows:
        at_most = largest_group(df, by)
    if at_most <= hot_rows:
        return _plain_scan(df, by, order, outputs)
    return _split_scan(df, by, order, outputs)


def _plain_scan(df: DataFrame, by, order, outputs) -> DataFrame:
    keys = [F.col(c) for c in by] or [F.lit(0)]
    forward = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    backward = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    columns = {name: _window_column(s, s.value, forward, backward) for name, s in outputs.items()}
    return df.withColumns(columns)


def _split_scan(df: DataFrame, by, order, outputs) -> DataFrame:
    names = list(df.columns)
    values = {name: f"__value_{i}" for i, name in enumerate(outputs)}
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    prepared = df.withColumns({values[n]: s.value for n, s in outputs.items()})
    prepared = prepared.withColumn(_GROUP, F.xxhash64(group) if by else F.lit(0).cast("long"))
    # Partition numbers are fixed by the checkpoint, so both branches below agree on them.
    placed = cut_lineage(
        prepared.repartitionByRange(_GROUP, *by, *order).withColumn(_PART, F.spark_partition_id())
    )

    keys = [_PART, *by]
    position = F.struct(*order)
    forward = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    backward = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    local = placed.withColumns(
        {f"__local_{n}": _window_column(s, F.col(values[n]), forward, backward) for n, s in outputs.items()}
    )

    summaries = []
    for name, scan in outputs.items():
        value = F.col(values[name])
        present = F.when(value.isNotNull(), position)
        if scan.kind in ("running_sum", "row_number"):
            summary = F.sum(value)
        elif scan.kind == "following":
            summary = F.min_by(value, present)
        else:
            summary = F.max_by(value, present)
        summaries.append(summary.alias(f"__sum_{name}"))
    totals = placed.groupBy(*keys).agg(*summaries)

    # One row per (group, partition): the window below never sees data rows.
    group_keys = [F.col(c) for c in by] or [F.lit(0)]
    earlier = Window.partitionBy(*group_keys).orderBy(F.col(_PART).asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    later = Window.partitionBy(*group_keys).orderBy(F.col(_PART).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = totals.select(
        *[F.col(c).alias(f"__key_{c}") for c in keys],
        *[
            (
                F.sum(f"__sum_{n}").over(earlier)
                if s.kind in ("running_sum", "row_number")
                else F.last(f"__sum_{n}", ignorenulls=True).over(later if s.kind == "following" else earlier)
            ).alias(f"__carry_{n}")
            for n, s in outputs.items()
        ],
    )
    match = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys]
    )
    joined = local.join(carried, match, "left")

    results = []
    for name, scan in outputs.items():
        here, carry = F.col(f"__local_{name}"), F.col(f"__carry_{name}")
        if scan.kind in ("running_sum", "row_number"):
            # NULL only while no value was seen yet, as with a plain window.
            total = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            column = F.when(here.isNotNull() | carry.isNotNull(), total)
        else:
            column = F.coalesce(here, carry)
        results.append(column.alias(name))
    return joined.select(*names, *results)
