"""Exact medians and quantiles of many columns in a fixed number of passes and bounded memory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scan import ordered_scan, running_sum

DIRECT_ROWS = 20_000
_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float] = [0.5],
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, NULL and NaN ignored.

    Columns of at most ``direct_rows`` values use Spark's exact ``percentile``, which keeps all distinct values in
    one buffer. For all others together one pass of mergeable sketches brackets every order statistic that is asked
    for, and a second pass counts what lies below each bracket and the values inside. The number of jobs does not
    depend on the number of columns or probabilities.
    """
    if not columns:
        return {}
    present = {c: _clean(F.col(f"`{c}`")) for c in columns}
    numbers = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(present.values())]).first()
    counts = dict(zip(columns, numbers))
    small = [c for c in columns if counts[c] <= direct_rows]
    out: dict[str, list[float | None]] = {}
    if small:
        exact = [F.percentile(present[c], F.array(*map(F.lit, probabilities))).alias(f"q{i}") for i, c in enumerate(small)]
        for c, found in zip(small, df.agg(*exact).first()):
            out[c] = list(found) if found is not None else [None] * len(probabilities)
    large = [c for c in columns if c not in out]
    positions = {(c, p): p * (counts[c] - 1) for c in large for p in probabilities}
    wanted = {(c, f(x)) for (c, _), x in positions.items() for f in (math.floor, math.ceil)}
    found = order_statistics(df.select(*[present[c].alias(c) for c in large]), counts, sorted(wanted)) if wanted else {}
    for c in large:
        out[c] = []
        for p in probabilities:
            x = positions[c, p]
            low, high = found[c, math.floor(x)], found[c, math.ceil(x)]
            out[c].append(low + (high - low) * (x - math.floor(x)) if high != low else low)
    return out


def _clean(column: Column) -> Column:
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def order_statistics(values: DataFrame, counts: dict[str, int], wanted: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank (column, rank) in ascending order; ``counts`` are the values per column."""
    found: dict[tuple[str, int], float] = {}
    margin, left = 2.0 / _ACCURACY, list(wanted)
    while left:
        columns = list(dict.fromkeys(c for c, _ in left))
        bounds = []
        for c in columns:
            shares = [max(0.0, min(1.0, r / counts[c] + d)) for k, r in left if k == c for d in (-margin, margin)]
            bounds.append(F.percentile_approx(F.col(f"`{c}`"), shares, _ACCURACY).alias(f"b{len(bounds)}"))
        brackets: dict[tuple[str, int], tuple[float, float]] = {}
        for c, b in zip(columns, values.agg(*bounds).first()):
            for i, rank in enumerate(r for k, r in left if k == c):
                brackets[c, rank] = (b[2 * i], b[2 * i + 1])
        if margin >= 1.0:  # bounds of the sketch at both ends: take everything
            brackets = {k: (-math.inf, math.inf) for k in brackets}
        cells = []
        for slot, key in enumerate(left):
            x, (lo, hi) = F.col(f"`{key[0]}`"), brackets[key]
            inside = F.when(x >= F.lit(lo), x)  # what lies below is counted under NULL
            cells.append(F.when(x <= F.lit(hi), F.struct(F.lit(slot).alias("slot"), inside.alias("x"))))
        rows = values.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s")).select("s.*")
        tally = rows.groupBy("slot", "x").agg(F.count(F.lit(1)).alias("n"))
        upto = ordered_scan(tally, ["slot"], ["x"], {"upto": running_sum(F.col("n"))})
        ranks = F.element_at(F.array(*[F.lit(r).cast("long") for _, r in left]), F.col("slot") + 1)
        # Where all of a slot's rank lies below its bracket, the smallest row beyond it is the count itself.
        hits = upto.where(F.col("upto") > ranks).groupBy("slot").agg(F.min(F.struct("upto", "x")).alias("first"))
        for r in hits.collect():  # one row per column and rank
            if r["first"]["x"] is not None:
                found[left[r["slot"]]] = r["first"]["x"]
        left, margin = [k for k in left if k not in found], margin * 16
    return found
