"""Newest record that is open at a moment, for any number of overlapping records in a group.

The state a scan carries is the set of open records. A record can only be the newest open one as long as
no later record stays open at least as long, so the set is kept as a stack whose closing times fall
towards its top. Such stacks merge: of an earlier stack remains what closes after everything opened later.

While every group stays under ``hot_rows`` one task scans a group. Beyond that the rows are range
partitioned by (group, time) and scanned per partition. An event that finds nothing open in its own partition
belongs to the nearest earlier partition with a record that closes later; which one that is follows from one
closing time per (group, partition), and the record from an ordered scan over that partition's stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scan import HOT_ROWS, following, largest_group, ordered_scan
from millrace.session import cut_lineage

_NEVER = np.iinfo(np.int64).max
_PART, _RANK, _AT, _UNTIL, _NO = "__part", "__rank", "__at", "__until", "__no"


def _micros(column: pa.Array, missing: int) -> list[int]:
    return column.cast(pa.int64()).fill_null(missing).to_pylist()


def _scan(by: list[str], stacks: bool):
    """Arrow scan over sorted rows: the newest open record of each event, or each group's last stack."""
    width = len(by)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack, kinds = None, [], None

        def left() -> pa.RecordBatch:
            columns = [pa.array([v] * len(stack), t) for v, t in zip(group, kinds)]
            until = pa.array([u for u, _, _ in stack], pa.int64())
            return pa.RecordBatch.from_arrays([*columns, until, pa.array([n for _, n, _ in stack], pa.int64())], [*by, _PART, "x", _NO])

        for batch in batches:
            kinds = [c.type for c in batch.columns[: width + 1]]
            keys = list(zip(*(c.to_pylist() for c in batch.columns[: width + 1])))
            ranks, numbers = batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
            times, ends = _micros(batch.column(width + 3), -_NEVER), _micros(batch.column(width + 4), _NEVER)
            found, until, rows = [], [], []
            for i, key in enumerate(keys):
                if key != group:
                    if stacks and stack:
                        yield left()
                    group, stack = key, []
                end = ends[i]
                if ranks[i] == 0:
                    while stack and stack[-1][0] <= end:
                        stack.pop()
                    stack.append((end, numbers[i], times[i]))
                elif not stacks:
                    while stack and stack[-1][0] <= times[i]:
                        stack.pop()
                    rows.append(i)
                    found.append(stack[-1][1] if stack else None)
                    until.append(stack[-1][0] if stack and stack[-1][0] < _NEVER else None)
            if rows:
                own = batch.take(pa.array(rows))
                columns = [*own.columns[: width + 1], own.column(width + 2), own.column(width + 3)]
                ended = pa.array(until, pa.int64()).cast(own.column(width + 4).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64()), ended], [*by, _PART, "id", "ts", "open_no", "open_until"])
        if stacks and stack:
            yield left()

    return scan


def newest_open(records: DataFrame, events: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (``by``, id, ts, open_no, open_until): the newest record of its group that each event falls into.

    ``records``: by, no, opened_at, closed_at; ``events``: by, id, ts. A record is open from ``opened_at`` until
    just before ``closed_at`` (null: for ever); of records opened at one moment the greater ``no`` is newer.
    Rows with a null group or a null opening time match nothing.
    """
    grouped = F.lit(True)
    for c in by:
        grouped = grouped & F.col(c).isNotNull()
    when = records.schema["closed_at"].dataType
    log = records.where(grouped & F.col("opened_at").isNotNull()).select(
        *by, F.lit(0).alias(_RANK), F.col("no").cast("long").alias("id"), F.col("opened_at").alias("ts"), F.col("closed_at").alias(_UNTIL)
    )
    log = log.unionByName(events.where(grouped).select(*by, F.lit(1).alias(_RANK), F.col("id").cast("long").alias("id"), "ts", F.lit(None).cast(when).alias(_UNTIL)))
    order = [*by, "ts", _RANK, "id"]
    columns = [*by, _PART, _RANK, "id", "ts", _UNTIL]
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    answered = f"{keys}{_PART} int, id long, ts {kinds['ts']}, open_no long, open_until {when.simpleString()}"
    if largest_group(log, by) <= hot_rows:
        placed = log.withColumn(_PART, F.lit(0)).repartition(*by).sortWithinPartitions(*order)
        return placed.select(*columns).mapInArrow(_scan(by, False), answered).drop(_PART)

    placed = cut_lineage(log.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()))
    placed = placed.sortWithinPartitions(*order).select(*columns)
    local = cut_lineage(placed.mapInArrow(_scan(by, False), answered))
    stacks = placed.where(F.col(_RANK) == 0).mapInArrow(_scan(by, True), f"{keys}{_PART} int, x long, {_NO} long")
    stacks = cut_lineage(stacks)
    # A stack's first record closes last. Few groups cross a border: at most two rows for each partition.
    rows = placed.groupBy(*by).agg(F.countDistinct(_PART).alias("n")).where("n > 1").drop("n")
    lasts = stacks.groupBy(*by, _PART).agg(F.max("x").alias("m")).join(F.broadcast(rows), by)
    lasts = lasts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(_PART).alias("p"), "m"))).alias("__ends"))
    micros = _at_micros("ts", kinds["ts"])
    open_ = local.where("open_no IS NULL AND ts IS NOT NULL").join(F.broadcast(lasts), by).withColumn(_AT, micros)
    earlier = F.filter("__ends", lambda e: (e["p"] < F.col(_PART)) & (e["m"] > F.col(_AT)))
    open_ = open_.withColumn("__from", F.element_at(F.transform(earlier, lambda e: e["p"]), -1)).where("__from IS NOT NULL")
    asked = open_.select(*by, F.col("__from"), F.col(_AT).alias("x"), F.lit(1).alias("kind"), "id", F.lit(None).cast("long").alias(_NO))
    known = stacks.join(F.broadcast(rows), by).select(*by, F.col(_PART).alias("__from"), "x", F.lit(0).alias("kind"), F.col(_NO).alias("id"), _NO)
    record = F.when(F.col("kind") == 0, F.struct(F.col(_NO).alias("no"), F.col("x").alias("x")))
    late = ordered_scan(known.unionByName(asked), [*by, "__from"], ["x", "kind", "id"], {"__found": following(record)}, hot_rows)
    ended = F.when(F.col("__found.x") < _NEVER, _from_micros(F.col("__found.x"), when.simpleString()))
    late = late.where("kind = 1").select(
        *[F.col(c).alias(f"__{c}") for c in by], F.col("id").alias("__id"), F.col("__found.no").alias("__late"), ended.alias("__late_until")
    )
    same = F.col("id") == F.col("__id")
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    joined = local.join(late, same, "left")
    return joined.select(*by, "id", "ts", F.coalesce("open_no", "__late").alias("open_no"), F.coalesce("open_until", "__late_until").alias("open_until"))


# A timestamp without zone is counted as UTC, as Arrow does.


def _at_micros(column: str, kind: str):
    if kind == "timestamp":
        return F.unix_micros(column)
    days = F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
    micros = (F.date_format(column, "SSSSSS")).cast("long")
    return (days * 86400 + clock) * 1_000_000 + micros


def _from_micros(micros, kind: str):
    if kind == "timestamp":
        return F.timestamp_micros(micros)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))
