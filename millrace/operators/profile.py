"""Dataset profiling: counts, distinct values, distributions, moments, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numbers import ratio
from millrace.plans.quantiles import exact_quantiles

TOP_VALUES = 20
TOP_CORRELATIONS = 10
SAMPLE_VALUES = 5
LONG_CELL = 80

_FLOATS = (T.FloatType, T.DoubleType)


def family(dtype: T.DataType) -> str:
    """Coarse type name used by the role and quality rules."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "nested"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def as_text(field: T.StructField) -> Column:
    """A value as text, so that equal values have equal text and NaN counts as missing."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _FLOATS):
        # Adding zero folds -0.0 into 0.0.
        return F.nanvl(column + F.lit(0.0), F.lit(None).cast(field.dataType)).cast("string")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def counting_form(value: Column) -> Column:
    """A text as it is counted: long ones by their SHA-256."""
    return F.when(F.length(value) > LONG_CELL, F.sha2(value, 256)).otherwise(value)


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest of tied ones; columns without a value are left out.

    Values are counted in their short form, all columns in one pass. The texts themselves are only looked at where a
    form that may stand for a long text is among the most frequent ones: all those columns in a second pass.
    """
    counts = value_counts(df, columns, whole=[]).where("value is not null")
    digest = F.length("value") == 64
    tops = counts.groupBy("column").agg(
        F.max("n").alias("top"),
        F.min(F.when(~digest, F.struct((-F.col("n")).alias("less"), "value"))).alias("short"),
        F.max(F.when(digest, F.col("n"))).alias("long"),
    ).collect()  # one row per column
    modes = {r["column"]: r["short"]["value"] for r in tops if r["short"] and -r["short"]["less"] == r["top"]}
    again = {r["column"]: r["top"] for r in tops if r["long"] == r["top"]}
    if again:
        top = F.element_at(F.create_map(*[F.lit(v) for kv in again.items() for v in kv]), F.col("column"))
        names = list(again)
        best = counts.where(F.col("column").isin(names) & digest & (F.col("n") == top)).select(F.col("column").alias("__column"), F.col("value").alias("__form"))
        cells = df.select(*[as_text(df.schema[c]).alias(c) for c in names]).unpivot([], names, "column", "value")
        same = (F.col("column") == F.col("__column")) & (counting_form(F.col("value")) == F.col("__form"))
        for r in cells.where("value is not null").join(best, same, "left_semi").groupBy("column").agg(F.min("value").alias("least")).collect():
            modes[r["column"]] = min(x for x in (modes.get(r["column"]), r["least"]) if x is not None)
    return modes


def value_counts(df: DataFrame, columns: list[str] | None = None, whole: list[str] | None = None) -> DataFrame:
    """Long table ``(column, value, n)``; NULL is kept as a value of its own.

    One unpivot and one map-side-combined shuffle serve missing counts, exact distinct counts,
    modes and distributions of all columns together. Values of the ``whole`` columns (all, unless
    given) are kept as they are; in the others a long value is replaced by its SHA-256, so that
    counting documents does not shuffle documents.
    """
    chosen = columns or df.columns
    kept = set(chosen if whole is None else whole)

    def counted(name: str) -> Column:
        value = as_text(df.schema[name])
        digested = name not in kept and family(df.schema[name].dataType) in ("string", "nested")
        return counting_form(value) if digested else value

    text = df.select(*[counted(c).alias(c) for c in chosen])
    long = text.unpivot([], chosen, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _per_column(df: DataFrame, columns: list[str], value) -> Column:
    pairs = [F.lit(x) for c in columns for x in (c, value(c))]
    return F.try_element_at(F.create_map(*pairs), F.col("column"))


def column_profile(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per column: position, dtype, rows, missing, exact distinct, constant flag."""
    counts = counts if counts is not None else value_counts(df, whole=[])
    order = {c: i for i, c in enumerate(df.columns)}
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
    )
    return per_column.select(
        "column",
        _per_column(df, df.columns, lambda c: order[c]).alias("position"),
        _per_column(df, df.columns, lambda c: family(df.schema[c].dataType)).alias("dtype"),
        "n_rows",
        "n_missing",
        "n_distinct",
        (F.col("n_distinct") <= 1).alias("is_constant"),
    )


def missing_counts(df: DataFrame, out: str = "n_missing") -> DataFrame:
    """Rows and missing values per column from one aggregation without a wide shuffle."""
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(as_text(f).isNull()).alias(f.name) for f in df.schema]
    )
    return row.unpivot(["n_rows"], df.columns, "column", out)


def target_distribution(df: DataFrame, target: str, top: int = TOP_VALUES) -> DataFrame:
    """Most frequent target values, NULL included."""
    counts = df.groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()).limit(top)


def target_moments(df: DataFrame, target: str) -> DataFrame:
    """Mean, population standard deviation, missing and distinct values of a numeric target."""
    y = F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double"))
    return df.agg(
        F.count_if(y.isNull()).alias("n_missing"),
        F.count_distinct(y).alias("n_unique"),
        F.avg(y).alias("mean"),
        F.coalesce(F.stddev_pop(y), F.lit(0.0)).alias("std"),
    )


def target_correlations(df: DataFrame, target: str, top: int = TOP_CORRELATIONS) -> DataFrame:
    """Pearson correlation of every other numeric column with the target, strongest first.

    Each pair uses the rows where both values are present. A constant column has no
    correlation and is left out.
    """
    others = [c for c in numeric_columns(df) if c != target]
    if not others:
        return df.sparkSession.createDataFrame([], "column string, correlation double")
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in [target, *others]}
    aggregates = []
    for c in others:
        both = clean[c].isNotNull() & clean[target].isNotNull()
        x, y = F.when(both, clean[c]), F.when(both, clean[target])
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        aggregates.append(ratio(F.covar_pop(x, y), spread).alias(c))
    long = df.agg(*aggregates).unpivot([], others, "column", "correlation")
    return (
        long.where("correlation is not null")
        .orderBy(F.abs("correlation").desc(), "column")
        .limit(top)
    )


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each key; NULL is one key value."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def column_set_diff(spark, train: list[str], test: list[str]) -> DataFrame:
    """One row per column name with the side it is on: only_train, only_test or shared."""
    sides = [("train", c) for c in train] + [("test", c) for c in test]
    names = spark.createDataFrame(sides, "side string, column string")
    in_train, in_test = F.bool_or(F.col("side") == "train"), F.bool_or(F.col("side") == "test")
    place = F.when(in_train & in_test, "shared").when(in_train, "only_train").otherwise("only_test")
    return names.groupBy("column").agg(place.alias("place")).orderBy("place", "column")


def preflight_summary(
    train: DataFrame, test: DataFrame | None = None, target: str | None = None
) -> DataFrame:
    """Per column: dtype, missing values in train and whether test has it, plus table facts."""
    test_columns = test.columns if test is not None else []
    return missing_counts(train).select(
        "column",
        _per_column(train, train.columns, lambda c: family(train.schema[c].dataType)).alias("dtype"),
        "n_missing",
        F.col("n_rows").alias("train_rows"),
        F.col("column").isin(test_columns).alias("in_test"),
        F.coalesce(F.col("column") == F.lit(target), F.lit(False)).alias("is_target"),
    )


def describe_view(profile: DataFrame) -> DataFrame:
    return profile.select("column", "dtype", "n_rows", "n_missing", "n_distinct")


def explore_view(profile: DataFrame, correlations: DataFrame) -> DataFrame:
    """Constant columns, missing counts and the correlation with the target side by side."""
    return profile.select("column", "n_missing", "is_constant").join(correlations, "column", "left")


def target_describe(df: DataFrame, target: str) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max in long form."""
    y = F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double"))
    row = df.agg(
        F.count(y).cast("double").alias("count"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
    )
    quartiles = exact_quantiles(df, [target], [0.25, 0.5, 0.75])[target]
    for name, value in zip(["25%", "50%", "75%"], quartiles):
        row = row.withColumn(name, F.lit(value).cast("double"))
    return row.unpivot([], ["count", "mean", "std", "min", "25%", "50%", "75%", "max"], "statistic", "value")


def guessed_type(samples: Column) -> Column:
    """Type guess for raw text from a few sample values."""
    numeric = F.forall(samples, lambda v: F.regexp_replace(v, ",", "").try_cast("double").isNotNull())
    whole = F.forall(samples, lambda v: ~F.contains(v, F.lit(".")) & ~F.contains(F.lower(v), F.lit("e")))
    long = F.exists(samples, lambda v: F.length(v) > LONG_CELL)
    return (
        F.when(F.size(samples) == 0, "empty")
        .when(numeric & whole, "integer")
        .when(numeric, "float")
        .when(long, "text")
        .otherwise("string")
    )


def raw_string_profile(df: DataFrame, position: str) -> DataFrame:
    """Profile of an all-text table: blanks are missing, samples are the first distinct values.

    Cells are counted in their short form. The few chosen as samples are read again by position, so whole long cells
    are never shuffled as keys. Values first met at one position are ordered by their short forms.
    """
    columns = [c for c in df.columns if c != position]
    trimmed = df.select(F.col(position).alias("__at"), *[F.trim(F.col(c).cast("string")).alias(c) for c in columns])
    long = trimmed.unpivot(["__at"], columns, "column", "cell").withColumn("cell", F.when(F.col("cell") != "", F.col("cell")))
    long = long.withColumn("form", counting_form(F.col("cell")))
    values = long.groupBy("column", "form").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first_at"))
    totals = values.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("form").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("form").alias("n_unique"),
    )
    by_first = Window.partitionBy("column").orderBy("first_at", "form")
    firsts = values.where("form is not null").withColumn("rank", F.row_number().over(by_first)).where(F.col("rank") <= SAMPLE_VALUES)
    # At most SAMPLE_VALUES rows per column.
    wanted = F.broadcast(firsts.select("column", "form", F.col("first_at").alias("__at"), "rank"))
    samples = (
        long.join(wanted, ["column", "form", "__at"])
        .groupBy("column", "rank")
        .agg(F.min("cell").alias("cell"))
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "cell"))).alias("picked"))
        .select("column", F.col("picked.cell").alias("samples"))
    )
    none = F.array().cast("array<string>")
    joined = totals.join(samples, "column", "left").withColumn("samples", F.coalesce("samples", none))
    return joined.select(
        "column", "n_missing", "n_unique", guessed_type(F.col("samples")).alias("dtype"), "samples"
    )


def header_warnings(header: list[str]) -> list[str]:
    """Problems in a header line: empty or repeated names."""
    names = [h.strip() for h in header]
    found = []
    if not names or "" in names:
        found.append("one or more header cells are empty")
    if len(set(names)) < len(names):
        found.append("duplicate column names")
    return found


def profile_dataset(
    train: DataFrame,
    test: DataFrame | None = None,
    target: str | None = None,
    id_column: str | None = None,
) -> dict[str, DataFrame]:
    """All profile tables of a dataset, sharing one pass for the per-column counts."""
    counts = value_counts(train, whole=[target] if target in train.columns else [])
    out = {"columns": column_profile(train, counts)}
    if id_column in train.columns:
        out["duplicates"] = duplicate_keys(train, [id_column])
    if target in train.columns:
        out["distribution"] = (
            counts.where(F.col("column") == target)
            .select("value", "n")
            .orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
            .limit(TOP_VALUES)
        )
        if target in numeric_columns(train):
            out["moments"] = target_moments(train, target)
            out["correlations"] = target_correlations(train, target)
    if test is not None:
        out["column_diff"] = column_set_diff(train.sparkSession, train.columns, test.columns)
    return out
