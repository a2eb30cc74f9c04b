"""Cross-validated ridge regression from additive moment matrices: one scan of the rows for all folds.

The sums of products of all columns are added up per fold. What a fold's model is fitted on is the total less
the fold's own sums; filling gaps with medians, scaling and the ridge solution are small matrix steps on it, so no fold
reads the rows again. The matrices have (2 x columns + 2) squared cells and are what comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.quantiles import exact_quantiles

#: Beyond so many columns the moment matrix is no longer small.
MOST_COLUMNS = 500


@dataclass(frozen=True)
class Ridge:
    """A fitted model: gaps are filled, then ``intercept + sum(weights * value)`` on the raw values."""

    columns: tuple[str, ...]
    fill: np.ndarray
    weights: np.ndarray
    intercept: float

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for c, m, w in zip(self.columns, self.fill, self.weights):
            out = out + F.coalesce(_number(c), F.lit(float(m))) * F.lit(float(w))
        return out


def _number(column: str) -> Column:
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def moments(rows: DataFrame, columns: list[str], label: str, fold: str, shift: np.ndarray) -> dict[int, np.ndarray]:
    """Per fold the sums of products of (1, values with gaps as 0, gap marks, label), less ``shift`` of values and label."""
    p = len(columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            cells = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(p + 1)]) - shift
            gap = np.isnan(cells[:, :p])
            full = np.column_stack([np.ones(len(batch)), np.where(gap, 0.0, cells[:, :p]), gap, cells[:, p]])
            for f in np.unique(folds):
                own = full[folds == f]
                sums[int(f)] = sums.get(int(f), 0.0) + own.T @ own
        width = 2 * p + 2
        place = np.arange(width * width, dtype=np.int32)
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), f), pa.int32()), pa.array(place), pa.array(m.ravel())], ["fold", "place", "v"])

    chosen = rows.where(F.col(label).isNotNull()).select(F.col(fold).cast("int"), *[_number(c) for c in columns], F.col(label).cast("double"))
    added = chosen.mapInArrow(scan, "fold int, place int, v double").groupBy("fold", "place").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in added.collect():  # folds x (2p + 2)^2 cells
        out.setdefault(r["fold"], np.zeros((2 * p + 2) ** 2))[r["place"]] = r["v"]
    return {f: m.reshape(2 * p + 2, -1) for f, m in out.items()}


def solve(total: np.ndarray, columns: list[str], fill: np.ndarray, shift: np.ndarray, penalty: float) -> Ridge:
    """Ridge on standardised values; the intercept is not penalised."""
    p = len(columns)
    # Filling a gap adds the (shifted) median times the gap mark: a linear map of the columns.
    mix = np.zeros((2 * p + 2, p + 2))
    mix[0, 0] = mix[-1, -1] = 1.0
    mix[1 : p + 1, 1 : p + 1] = np.eye(p)
    mix[p + 1 : 2 * p + 1, 1 : p + 1] = np.diag(fill - shift[:p])
    g = mix.T @ total @ mix
    n = g[0, 0]
    mean = g[0, 1:] / n
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:p], 0) / n)
    spread[spread <= 1e-12 * (1 + np.abs(mean[:p]))] = 1.0
    a = centred[:p, :p] / np.outer(spread, spread) + penalty * np.eye(p)
    w = np.linalg.solve(a, centred[:p, p] / spread) / spread
    return Ridge(tuple(columns), fill, w, float(mean[p] + shift[p] - (mean[:p] + shift[:p]) @ w))


def fold_models(rows: DataFrame, columns: list[str], label: str, fold: str, k: int, penalty: float = 1.0) -> list[Ridge]:
    """For each of ``k`` folds the ridge model fitted on all other folds.

    Three fixed passes, whatever the number of folds and columns: shifts, medians, moments.
    """
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    known = rows.where(F.col(label).isNotNull())
    means = known.agg(*[F.avg(_number(c)) for c in columns], F.avg(F.col(label).cast("double"))).first()
    shift = np.array([m if m is not None else 0.0 for m in means], dtype=float)
    names = [(i, c) for i in range(k) for c in range(len(columns))]
    others = known.select(*[F.when(F.col(fold) != i, _number(columns[c])).alias(f"x{i}_{c}") for i, c in names])
    medians = exact_quantiles(others, others.columns, [0.5])
    parts = moments(known, columns, label, fold, shift)
    total = sum(parts.values())
    models = []
    for i in range(k):
        fill = np.array([medians[f"x{i}_{c}"][0] if medians[f"x{i}_{c}"][0] is not None else 0.0 for c in range(len(columns))])
        models.append(solve(total - parts.get(i, 0.0), columns, fill, shift, penalty))
    return models


def out_of_fold(rows: DataFrame, models: list[Ridge], fold: str, name: str = "prediction") -> DataFrame:
    """``rows`` with the prediction of the model that has not seen their fold."""
    out = F.lit(None).cast("double")
    for i, model in enumerate(models):
        out = F.when(F.col(fold) == i, model.predict()).otherwise(out)
    return rows.withColumn(name, out)
