"""Fold assignment, class weights and the union of out-of-fold predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import ratio
from millrace.plans.ranks import shuffled_key, with_share

FOLDS = 5
SEED = 42
IMBALANCE_SHARE = 0.4


def stratified_folds(df: DataFrame, target: str, key: list[str], k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` so that every class is spread evenly over the folds.

    A fold is one k-th of each class in shuffled order; rows are labelled in place.
    """
    return with_share(df, [target], key, seed, [i / k for i in range(1, k)], "fold")


def plain_folds(df: DataFrame, key: list[str], k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` from a hash of the key alone: no shuffle at all."""
    digits = F.conv(F.substring(shuffled_key(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (digits % k).cast("int"))


def fold_union(folds: list[DataFrame]) -> DataFrame:
    """All out-of-fold rows in one table."""
    return reduce(lambda a, b: a.unionByName(b), folds)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``(label, n, total, n_classes)``; totals come from the small class table."""
    counts = df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "label",
        "n",
        counts.agg(F.sum("n")).scalar().alias("total"),
        counts.agg(F.count(F.lit(1))).scalar().alias("n_classes"),
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight of every class: total / (classes * rows of the class)."""
    weight = ratio(F.col("total"), F.col("n_classes") * F.col("n"))
    return class_counts(df, target).select("label", "n", weight.alias("weight"))


def class_shares(df: DataFrame, target: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Rows and percentage per class with a readable class name."""
    names = F.create_map(*[F.lit(x) for pair in (labels or {"": ""}).items() for x in pair])
    text = F.col("label").cast("string")
    return class_counts(df, target).select(
        "label",
        F.coalesce(F.try_element_at(names, text), text).alias("name"),
        "n",
        (100.0 * ratio(F.col("n"), F.col("total"))).alias("share"),
    )


def imbalance_warning(df: DataFrame, target: str, limit: float = IMBALANCE_SHARE) -> DataFrame:
    """One row; ``warn`` is true for two classes whose smaller one is under ``limit``."""
    counts = class_counts(df, target)
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        ratio(F.min("n"), F.max("total")).alias("minority_share"),
    ).withColumn("warn", (F.col("n_classes") == 2) & (F.col("minority_share") < limit))
