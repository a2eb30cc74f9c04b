"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Its documents are counted by exact length, and the counts are
fitted to the target: all documents are taken as many whole times as the target allows, an even share of
every length follows, and a bounded-knapsack dynamic program over the lengths that are left closes the
remaining budget. Inside one length the documents that get one more copy are those with the smallest
seeded hash.

Only the table of (source, length, count) is grouped by source: a source of W words has at most sqrt(2 W)
different lengths, whatever the number of its documents. Documents are ranked inside (source, length) by a
range partitioning, so a hot source or length is spread over many tasks. Targets are levelled in rounds of
one small aggregate, so sources are never collected.

Defined cases: a null text has size 0; documents of size 0 take nothing; a null source is a source of its
own and comes last; rows with equal doc_id are documents like any other; without any words all targets
are 0; an empty table gives no rows; columns that are not needed are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import with_position, written
from millrace.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 2
SEED = 13
#: Words of budget that the dynamic program closes; everything before is counting.
ROOM = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150) -> DataFrame:
    """Rows source, source_size, target for rows of source, size.

    Sources share ``percent`` of all words by weight; no target is above ``MOST_COPIES`` times its source.
    Sources above the common level are held at that limit and the others share what remains, until none
    is above; all comparisons are of whole numbers.
    """
    whole = "decimal(38,0)"
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = with_position(totals.withColumn("__last", F.col("source").isNull()), [], ["__last", "source"], "__place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    totals = written(totals.select("source", "source_size", weight.cast(whole).alias("w"), F.col("source_size").cast(whole).alias("s")), "source-sizes")
    budget = (totals.agg(F.sum("s")).first()[0] or 0) * percent  # in hundredths of words
    left, shared = budget, totals.agg(F.sum("w")).first()[0] or 1
    while True:
        # left / shared is the level of one unit of weight; a source is full when its limit lies below its part.
        full = F.col("s") * (100 * MOST_COPIES) * F.lit(shared).cast(whole) < F.col("w") * F.lit(left).cast(whole)
        held = totals.agg(F.coalesce(F.sum(F.when(full, F.col("s") * (100 * MOST_COPIES))), F.lit(0)), F.sum(F.when(~full, F.col("w")))).first()
        now = budget - held[0]
        if held[1] is None or (now, held[1]) == (left, shared):
            break
        left, shared = now, held[1]
    part = (F.col("w") * F.lit(left).cast(whole)).cast("double") / (100.0 * float(shared))
    target = F.when(full, F.col("source_size") * float(MOST_COPIES)).otherwise(part)
    return totals.select("source", "source_size", target.alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, copies: int, seed: float = 0.5, room: int = ROOM) -> np.ndarray:
    """How many further copies of documents of each length come nearest to ``budget`` words.

    ``copies`` is how often a document may still be taken (1 or 2). The longest lengths give way where the
    even share is above the budget; then the budget is filled from the longest length down to ``room``
    words, and the dynamic program finds the sum nearest to the rest. Second copies of a document come
    into play only in that program, after all first ones.
    """
    order = np.argsort(-lengths, kind="stable")
    size, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * n).sum())
    take = np.zeros(len(size), dtype=np.int64)
    if total and budget > 0:
        edges = np.floor(np.cumsum(n * min(1.0, budget / total)) + seed).astype(np.int64)
        take = np.minimum(n, np.diff(edges, prepend=int(np.floor(seed))))
    rest = budget - int((size * take).sum())
    for i in range(len(size)):
        if rest >= 0:
            break
        back = min(int(take[i]), -(rest // int(size[i])))
        take[i] -= back
        rest += back * int(size[i])
    for i in range(len(size)):
        if rest <= room:
            break
        more = min(int(n[i] - take[i]), rest // int(size[i]), -((room - rest) // int(size[i])))
        take[i] += more
        rest -= more * int(size[i])
    take += _nearest_sum(size, n, take, rest, copies, min(2 * rest, rest + room))
    out = np.zeros(len(take), dtype=np.int64)
    out[order] = take
    return out


def _nearest_sum(size: np.ndarray, n: np.ndarray, take: np.ndarray, rest: int, copies: int, limit: int) -> np.ndarray:
    """Bounded knapsack: additions to ``take`` whose words are nearest to ``rest`` (the smaller sum on ties)."""
    added = np.zeros(len(size), dtype=np.int64)
    if rest <= 0:
        return added
    items: list[tuple[int, int]] = []
    for spare in (np.maximum(n - take, 0), (copies - 1) * n):
        for i in np.flatnonzero((spare > 0) & (size <= limit)):
            left, step = min(int(spare[i]), limit // int(size[i])), 1
            while left:  # so many copies as 1, 2, 4, ... pieces
                items.append((int(i), min(step, left)))
                left -= items[-1][1]
                step *= 2
    reached, first = 1, np.full(limit + 1, -1, dtype=np.int64)
    mask, exact = (1 << (limit + 1)) - 1, 1 << rest
    for k, (i, step) in enumerate(items):
        words = step * int(size[i])
        if words > limit:
            continue
        new = (reached << words) & mask & ~reached
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = k
            reached |= new
            if reached & exact:
                break
    sums = np.flatnonzero(first >= 0)
    at = int(sums[np.argmin(np.abs(sums - rest))]) if len(sums) else 0
    if rest <= abs(at - rest):
        return added
    while at:
        i, step = items[first[at]]
        added[i] += step
        at -= step * int(size[i])
    return added


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, seed: int = SEED, room: int = ROOM
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, source, copies."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    drawn = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    rows = cut_lineage(docs.select("doc_id", "source", size.alias("size"), drawn.alias("__drawn")))
    targets = written(source_targets(rows, weights, percent), "source-targets")
    counts = rows.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).select("source", "size", "n", "source_size", "target")

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        total, target = int(table["source_size"].iloc[0]), float(table["target"].iloc[0])
        whole = min(MOST_COPIES, int(target // total))
        name = table["source"].iloc[0]
        start = np.random.default_rng([seed, *(b"" if name is None else str(name).encode())]).random()
        extra = np.zeros(len(table), dtype=np.int64)
        if whole < MOST_COPIES:
            lengths, n = table["size"].to_numpy(), table["n"].to_numpy()
            extra = fit_budget(lengths, n, round(target - whole * total), MOST_COPIES - whole, start, room)
        each, more = np.divmod(extra, table["n"].to_numpy())
        return pd.DataFrame({"s": table["source"], "l": table["size"], "base": whole + each, "more": more})

    kind = docs.schema["source"].dataType.simpleString()
    # The group is the table of lengths of one source, not its documents.
    plan = written(counts.groupBy("source").applyInPandas(fit, f"s {kind}, l long, base long, more long"), "length-plan")
    placed = with_position(rows, ["source", "size"], ["__drawn", "doc_id"], "__place")
    planned = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")), "left")
    copies = F.coalesce(F.col("base") + (F.col("__place") < F.col("more")).cast("long"), F.lit(0))
    planned = planned.select("doc_id", "source", "size", copies.alias("copies"))
    named = targets.withColumnRenamed("source", "s")
    return planned.join(named, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )
