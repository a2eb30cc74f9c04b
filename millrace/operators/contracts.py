"""Contracts: submission file, prepared table, candidate models, sources, run outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.metricrules import SCORE_CEILINGS
from millrace.operators.profile import missing_counts

LAST_PHASE = 6
LAST_SUBSTEP = "6.4"
EARLIER_A_LOOPS = 2

VIOLATION = "rule string, detail string"


def _rows(df: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, VIOLATION)


def attach_predictions(sample: DataFrame, predictions: DataFrame, id_column: str, target: str) -> DataFrame:
    """Predictions in the layout of the sample file, matched by id and never by row position."""
    values = predictions.select(id_column, F.col(target).alias("__prediction"))
    joined = sample.drop(target).join(values, id_column, "left")
    return joined.withColumnRenamed("__prediction", target).select(*sample.columns)


def submission_violations(submission: DataFrame, sample: DataFrame, id_column: str) -> DataFrame:
    """Rows ``(rule, detail)``: column layout, row count, NULL ids, ids missing or unknown."""
    found = []
    if submission.columns != sample.columns:
        found.append(("columns", f"{submission.columns} instead of {sample.columns}"))
    checks = _rows(sample, found)
    if id_column not in submission.columns:
        return checks.unionByName(_rows(sample, [("id_absent", id_column)]))
    expected = sample.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("wanted"))
    given = submission.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("given"))
    matched = expected.join(given, expected["id"].eqNullSafe(given["id"]), "full_outer").select(
        F.coalesce("wanted", F.lit(0)).alias("wanted"),
        F.coalesce("given", F.lit(0)).alias("given"),
        given["id"].alias("given_id"),
    )
    totals = matched.agg(
        F.sum("wanted").alias("wanted"),
        F.sum("given").alias("given"),
        F.sum(F.when(F.col("given_id").isNull(), F.col("given")).otherwise(0)).alias("null_ids"),
        F.count_if((F.col("wanted") > 0) & (F.col("given") == 0)).alias("missing_ids"),
        F.count_if((F.col("wanted") == 0) & F.col("given_id").isNotNull()).alias("unknown_ids"),
    )

    def rule(name: str, count: Column, broken: Column) -> Column:
        return F.when(broken, F.struct(F.lit(name).alias("rule"), count.cast("string").alias("detail")))

    rules = F.array_compact(
        F.array(
            rule("row_count", F.col("given"), F.col("given") != F.col("wanted")),
            *[rule(c, F.col(c), F.col(c) > 0) for c in ("null_ids", "missing_ids", "unknown_ids")],
        )
    )
    return checks.unionByName(totals.select(F.inline(rules)))


def prepared_violations(
    prepared: DataFrame, target: str, id_column: str | None = None,
    included: list[str] = (), derived: list[str] = (), has_test: bool = True,
) -> DataFrame:
    """Does the prepared train table hold what the preparation claims?"""
    have = set(prepared.columns)
    reserved = {target, id_column}
    found = []
    if not has_test:
        found.append(("test_absent", ""))
    if target not in have:
        found.append(("target_absent", target))
    if not [c for c in prepared.columns if c not in reserved]:
        found.append(("no_features", ""))
    found += [("included_absent", c) for c in included if c not in have and c not in reserved]
    found += [("derived_absent", c) for c in derived if c not in have]
    checks = _rows(prepared, found)
    if target in have:
        gaps = missing_counts(prepared.select(target)).where("n_missing > 0")
        checks = checks.unionByName(gaps.select(F.lit("target_missing").alias("rule"), F.col("column").alias("detail")))
    return checks


def model_violations(candidates: DataFrame, group: list[str], metric: str) -> DataFrame:
    """Findings per group of candidates ``(technique, cv_score, is_chosen)``."""
    ceiling = SCORE_CEILINGS.get((metric or "").lower())
    too_good = F.col("cv_score") >= ceiling if ceiling is not None else F.lit(False)
    rule = F.when(F.col("cv_score").isNull(), "no_score").when(too_good, "above_ceiling")
    per_model = candidates.select(*group, "technique", rule.alias("rule")).where("rule is not null")
    unchosen = (
        candidates.groupBy(*group)
        .agg(F.bool_or(F.coalesce("is_chosen", F.lit(False))).alias("any_chosen"))
        .where("not any_chosen")
        .select(*group, F.lit(None).cast("string").alias("technique"), F.lit("none_chosen").alias("rule"))
    )
    return per_model.unionByName(unchosen)


def source_violations(cases: DataFrame, sources: DataFrame, headers: DataFrame) -> DataFrame:
    """Launch check of many cases at once: ``(case_id, rule, detail)``.

    ``cases``: case_id, target; ``sources``: case_id, role, path, is_readable;
    ``headers``: path, columns (array of the header names of readable train files).
    """
    folder = F.regexp_extract("path", r"(?:^|/)data/([^/]+)/", 1)
    listed = cases.join(sources, "case_id", "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col("path").isNotNull() & ~F.coalesce("is_readable", F.lit(False)), "not_readable"),
            F.when((folder != "") & (folder != "users") & (folder != F.col("case_id")), "folder_mismatch"),
        )
    )
    files = listed.select("case_id", F.explode(rules).alias("rule"), F.col("path").alias("detail"))
    trains = sources.where("role = 'train'")
    no_train = cases.join(trains, "case_id", "left_anti").select(
        "case_id", F.lit("train_absent").alias("rule"), F.lit(None).cast("string").alias("detail")
    )
    peek = (
        cases.join(trains, "case_id")
        .join(headers, "path")
        .where(F.col("target").isNotNull() & ~F.array_contains("columns", F.col("target")))
        .select("case_id", F.lit("target_not_in_header").alias("rule"), F.col("target").alias("detail"))
    )
    # The header is looked at only for cases without another finding.
    peek = peek.join(files.select("case_id").distinct(), "case_id", "left_anti")
    return files.unionByName(no_train).unionByName(peek)


def outcome_flags(states: DataFrame) -> DataFrame:
    """Deficits, success and completion of every run.

    ``states``: run_id, chosen_model, submission_path, meets, halted, phase, substep.
    """
    deficits = F.array_compact(
        F.array(
            F.when(F.col("chosen_model").isNull(), "no_model"),
            F.when(F.col("submission_path").isNull(), "no_submission"),
            F.when(~F.coalesce("meets", F.lit(False)), "criteria_not_met"),
        )
    )
    complete = F.col("halted") & (F.col("phase") == LAST_PHASE) & (F.col("substep") == LAST_SUBSTEP)
    return states.select(
        "run_id",
        deficits.alias("deficits"),
        (F.size(deficits) == 0).alias("ml_success"),
        F.coalesce(complete, F.lit(False)).alias("workflow_complete"),
    )


def phase_readiness(states: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """One flag per phase: all columns it needs are filled."""

    def filled(columns):
        flag = F.lit(True)
        for c in columns:
            flag = flag & F.col(c).isNotNull()
        return flag

    return states.select("run_id", *[filled(columns).alias(name) for name, columns in needs.items()])


def loop_recommendation(states: DataFrame) -> DataFrame:
    """Advice per run at the decision steps 5.1 and 5.2; NULL when there is nothing to do.

    ``states``: run_id, substep, n_findings, n_degraded, meets, loops_a, loops_c.
    """
    step, unmet = F.col("substep"), F.coalesce(~F.col("meets"), F.lit(False))
    advice = (
        F.when((step == "5.1") & (F.col("n_findings") > 0), "B:findings")
        .when((step == "5.1") & (F.col("n_degraded") > 0), "B:degraded")
        .when((step == "5.2") & unmet & (F.col("loops_a") >= EARLIER_A_LOOPS), "halt")
        .when((step == "5.2") & unmet & (F.col("loops_c") == 0), "C:criteria_not_met")
    )
    return states.select("run_id", "substep", advice.alias("advice"))
