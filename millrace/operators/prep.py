"""Leakage-safe preparation: every statistic is fitted on train and applied to both tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numbers import to_number
from millrace.functions.text import ABSENT_NUMBER, ABSENT_TEXT
from millrace.operators.profile import column_modes, numeric_columns, value_counts
from millrace.operators.roles import Hints
from millrace.plans.quantiles import DIRECT_ROWS, exact_quantiles
from millrace.plans.ranks import with_share

HOLDOUT_SHARE = 0.2
HOLDOUT_SEED = 42
MAX_STRATA = 50
NO_MODE = "Unknown"


@dataclass(frozen=True)
class ImputeValues:
    """Fill values fitted on a train table: medians per number, modes per text column."""

    numbers: dict[str, float]
    texts: dict[str, str]
    #: Whole-number columns without gaps in train: they keep their type.
    complete: tuple[str, ...] = ()


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def features_and_label(df: DataFrame, target: str, id_column: str | None = None):
    """Split a table into its predictors and its label column."""
    features = df.drop(*[c for c in (target, id_column) if c])
    return features, (df.select(target) if target in df.columns else None)


def align_schema(df: DataFrame, like: T.StructType) -> DataFrame:
    """Columns of ``like`` in its order; absent ones become NULL, extra ones go."""
    have = set(df.columns)
    return df.select(
        *[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in like]
    )


def fill_structural_absence(df: DataFrame, columns) -> DataFrame:
    """Where missing means "has none": a marker text, or -1 for numbers."""
    texts, fills = set(text_columns(df)), {}
    for c in columns:
        if c in texts:
            fills[c] = F.coalesce(F.col(c), F.lit(ABSENT_TEXT))
        elif c in df.columns:
            fills[c] = F.coalesce(F.col(c), F.lit(ABSENT_NUMBER).cast(df.schema[c].dataType))
    return df.withColumns(fills) if fills else df


def fit_imputation(train: DataFrame, target: str, direct_rows: int = DIRECT_ROWS, id_column: str | None = None) -> ImputeValues:
    """Exact medians (0.0 when a column is empty) and modes (smallest of the tied values); never of the id."""
    train = train.drop(*[c for c in (id_column,) if c])
    numbers = [c for c in numeric_columns(train) if c != target]
    texts = [c for c in text_columns(train) if c != target]
    medians = exact_quantiles(train, numbers, [0.5], direct_rows)
    modes = column_modes(train, texts) if texts else {}
    whole = [c for c in numbers if isinstance(train.schema[c].dataType, T.IntegralType)]
    gaps = train.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in whole]).first() if whole else {}
    return ImputeValues(
        numbers={c: (medians[c][0] if medians[c][0] is not None else 0.0) for c in numbers},
        texts={c: modes.get(c, NO_MODE) for c in texts},
        complete=tuple(c for c in whole if not gaps[c]),
    )


def apply_imputation(df: DataFrame, values: ImputeValues) -> DataFrame:
    """Fill the columns the fit knows.

    Whole-number columns with gaps in train become doubles, as their median may not be whole. Those without
    keep their type and all their digits; a gap that only another table has gets the rounded median.
    """
    fills = {}
    for c, v in values.numbers.items():
        if c in df.columns and c in values.complete:
            fills[c] = F.coalesce(F.col(c), F.lit(round(v)).cast(df.schema[c].dataType))
        elif c in df.columns:
            fills[c] = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(v)))
    for c, v in values.texts.items():
        if c in df.columns:
            fills[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(fills) if fills else df


def clean(train: DataFrame, test: DataFrame | None, target: str, hints: Hints = Hints(), id_column: str | None = None):
    """Structural-absence fill followed by imputation; returns train, test and the fitted values."""
    train = fill_structural_absence(train, hints.na_means_absent)
    values = fit_imputation(train, target, id_column=id_column)
    if test is not None:
        test = apply_imputation(fill_structural_absence(test, hints.na_means_absent), values)
    return apply_imputation(train, values), test, values


def missing_indicators(df: DataFrame, columns) -> DataFrame:
    """``<column>_missing`` flags; 0 where this table lacks the column.

    Run it before imputation: afterwards nothing is missing and every flag is 0.
    """
    flags = {
        f"{c}_missing": F.col(c).isNull().cast("int") if c in df.columns else F.lit(0) for c in columns
    }
    return df.withColumns(flags) if flags else df


def pair_interaction(df: DataFrame, numeric_with_missing) -> DataFrame:
    """Product of the first two hinted numbers, unreadable or missing values counting as 0."""
    pair = list(numeric_with_missing)[:2]
    if len(pair) < 2 or any(c not in df.columns for c in pair):
        return df
    first, second = [F.coalesce(to_number(F.col(c).cast("string")), F.lit(0.0)) for c in pair]
    return df.withColumn(f"{pair[0]}_x_{pair[1]}", first * second)


def construct(train: DataFrame, test: DataFrame | None, hints: Hints):
    """Missing flags for the columns train has, plus the pair interaction."""
    flagged = [c for c in hints.high_missing if c in train.columns]

    def build(df):
        return pair_interaction(missing_indicators(df, flagged), hints.numeric_with_missing)

    return build(train), (build(test) if test is not None else None)


def integrate(train: DataFrame, test: DataFrame | None, target: str):
    """Limit test to the columns train has, in train order; the target must survive in train."""
    if target not in train.columns:
        raise ValueError(f"target {target!r} is missing from the train table")
    if test is None:
        return train, None
    return train, test.select(*[c for c in train.columns if c in test.columns])


def stratified_holdout(
    df: DataFrame, target: str, key: list[str], share: float = HOLDOUT_SHARE, seed: int = HOLDOUT_SEED
) -> DataFrame:
    """Add ``is_holdout``; the same share of every class is held out, in shuffled key order.

    With many distinct target values there is nothing to stratify by, and the split is plain.
    """
    classes = df.select(target).distinct().limit(MAX_STRATA + 1).count()
    by = [target] if classes < MAX_STRATA else []
    split = with_share(df, by, key, seed, [share], "__after")
    return split.select(*df.columns, (F.col("__after") == 0).alias("is_holdout"))


def wide_text_columns(df: DataFrame, hints: Hints) -> list[str]:
    """Hinted free-text columns that must not reach one-hot encoding.

    The leading text column stays when the case is text-led; the others go when they are not
    needed or have too many distinct values. Values are told apart by their digests, all columns in one pass.
    """
    listed = [c for c in hints.text_free if c in df.columns]
    if hints.text_led:
        listed = [c for c in listed if c != hints.text_free[0]]
    if not listed or not hints.text_led:
        return listed
    values = value_counts(df.select(*listed), whole=[])
    found = values.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct")).collect()  # one row per column
    return [r["column"] for r in sorted(found, key=lambda r: listed.index(r["column"])) if r["n_distinct"] > max(50, int(0.3 * r["n_rows"]))]


def format_tables(
    train: DataFrame, test: DataFrame | None, target: str, id_column: str | None, hints: Hints = Hints(),
    key: list[str] | None = None,
):
    """Model-ready tables: hold-out made when there is no test, id and wide text dropped, test aligned."""
    if target not in train.columns:
        raise ValueError(f"target {target!r} is missing from the train table")
    if test is None:
        split = stratified_holdout(train, target, key or [id_column])
        train = split.where(~F.col("is_holdout")).drop("is_holdout")
        test = split.where("is_holdout").drop("is_holdout", target)
    dropped = wide_text_columns(train, hints)
    prepared = train.drop(*dropped, *([id_column] if id_column else []))
    wanted = T.StructType([f for f in prepared.schema if f.name != target])
    if id_column and id_column in test.columns:
        wanted = T.StructType([test.schema[id_column], *[f for f in wanted if f.name != id_column]])
    return prepared, align_schema(test, wanted)


def count_features(df: DataFrame, counts: list[str], out: str, alone: str) -> DataFrame:
    """Sum of count columns plus one, and a flag for the rows where that sum is 1."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(1))
    return df.withColumn(out, total.cast("long")).withColumn(alone, (F.col(out) == 1).cast("int"))


def low_cardinality(profile: DataFrame, limit: int = 20) -> DataFrame:
    """Text columns with few enough distinct values to encode."""
    return profile.where((F.col("dtype") == "string") & (F.col("n_distinct") <= limit)).select("column", "n_distinct")
