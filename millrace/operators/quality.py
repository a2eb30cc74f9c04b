"""Data-quality gate, prepared-table lint and the before/after audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import ratio
from millrace.operators.profile import column_profile, missing_counts

# Fixed values of the gate.
BLOCKING_RATE = 0.6
TOLERABLE_RATE = 0.05


def quality_gate(
    profile: DataFrame,
    target: str | None,
    na_means_absent: list[str] = (),
    high_missing: list[str] = (),
    id_duplicates: DataFrame | None = None,
    target_present: bool = True,
) -> DataFrame:
    """Findings ``(column, rule, severity, rate)`` from a column profile.

    ``id_duplicates`` is the one-row result of :func:`duplicate_keys`.
    """
    column, rate = F.col("column"), ratio(F.col("n_missing"), F.greatest(F.col("n_rows"), F.lit(1)))
    is_target = F.coalesce(column == F.lit(target), F.lit(False))
    missing = F.col("n_missing") > 0
    rule = (
        F.when(is_target, F.when(missing, "target_missing"))
        .when(missing & column.isin(list(na_means_absent)), "structural_absence")
        .when(missing & column.isin(list(high_missing)), "documented_missing")
        .when(rate >= BLOCKING_RATE, "undocumented_missing")
        .when(rate >= TOLERABLE_RATE, "some_missing")
    )
    constant = F.when(F.col("is_constant") & ~is_target, "constant")
    tolerable = ["structural_absence", "documented_missing", "some_missing"]
    findings = profile.select(
        "column", rate.alias("rate"), F.explode(F.array_compact(F.array(rule, constant))).alias("rule")
    ).select(
        "column",
        "rule",
        F.when(F.col("rule").isin(tolerable), "tolerable").otherwise("blocker").alias("severity"),
        "rate",
    )
    if target and not target_present:
        absent = profile.sparkSession.createDataFrame(
            [(target, "target_absent", "blocker", None)], "column string, rule string, severity string, rate double"
        )
        findings = findings.unionByName(absent)
    if id_duplicates is not None:
        repeated = id_duplicates.where("duplicate_rows > 0").select(
            F.lit(None).cast("string").alias("column"),
            F.lit("duplicate_ids").alias("rule"),
            F.lit("blocker").alias("severity"),
            ratio(F.col("duplicate_rows"), F.col("n_rows")).alias("rate"),
        )
        findings = findings.unionByName(repeated)
    return findings


def prepared_lint(prepared: DataFrame, target: str, id_column: str | None = None) -> DataFrame:
    """Problems of a prepared training table: ``(column, rule)``."""
    if target not in prepared.columns:
        return prepared.sparkSession.createDataFrame([(target, "target_absent")], "column string, rule string")
    profile = column_profile(prepared)
    is_target = F.col("column") == target
    rules = F.array_compact(
        F.array(
            F.when(F.col("column") == F.lit(id_column), "id_present"),
            F.when(~is_target & F.col("is_constant"), "constant_predictor"),
            F.when(is_target & (F.col("n_missing") > 0), "target_missing"),
        )
    )
    return profile.select("column", F.explode(rules).alias("rule"))


def prep_audit(source: DataFrame, prepared: DataFrame, target: str) -> DataFrame:
    """Missing values per column before and after, with dropped and derived columns marked."""
    before = missing_counts(source, "missing_before").withColumnRenamed("n_rows", "rows_before")
    after = missing_counts(prepared, "missing_after").withColumnRenamed("n_rows", "rows_after")
    change = (
        F.when(F.col("missing_after").isNull() & (F.col("column") != target), "dropped")
        .when(F.col("missing_before").isNull(), "derived")
        .otherwise("kept")
    )
    return before.join(after, "column", "full_outer").select(
        "column", "missing_before", "missing_after", "rows_before", "rows_after", change.alias("change")
    )
