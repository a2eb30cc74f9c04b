"""The whole way from two source tables to a checked submission."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import contracts, models, prep, profile, quality, roles
from millrace.operators.roles import Hints
from millrace.session import cut_lineage, shared_folder
from millrace.sources.stages import StageStore


@dataclass(frozen=True)
class Settings:
    """What the user states; blank entries are inferred from the data and never override a stated one."""

    target: str | None = None
    id_column: str | None = None
    problem_type: str = "classification"
    metric: str = "accuracy"
    hints: Hints | None = None
    preferred: str | None = None


@dataclass(frozen=True)
class Understanding:
    settings: Settings
    columns: DataFrame
    findings: DataFrame


@dataclass(frozen=True)
class Result:
    understanding: Understanding
    train: DataFrame
    test: DataFrame
    lint: DataFrame
    experiments: list
    best: object
    submission: DataFrame
    violations: DataFrame
    #: Metrics, confusion cells and cross-validation of the chosen technique, one row.
    bundle: DataFrame
    model_path: str
    #: Metric of the submission on held-out rows, where there was no test table.
    holdout_score: float | None = None


def understand(train: DataFrame, test: DataFrame | None, settings: Settings) -> Understanding:
    """Profile, inferred roles and hints, and the quality gate. The profile is computed once."""
    columns = cut_lineage(profile.column_profile(train))  # one row per column
    only_train = [c for c in train.columns if test is not None and c not in test.columns]
    inferred = {r["role"]: r["column"] for r in roles.infer_roles(columns, only_train, settings.problem_type).collect()}
    target = settings.target or inferred.get("target")
    id_column = settings.id_column or inferred.get("id")
    if target is None:
        raise ValueError("no target given and none could be inferred")
    hints = settings.hints
    if hints is None:
        hints = roles.hints_from_rows(roles.infer_hints(columns, [c for c in (target, id_column) if c]).collect())
    duplicates = profile.duplicate_keys(train, [id_column]) if id_column else None
    findings = quality.quality_gate(
        columns, target, list(hints.na_means_absent), list(hints.high_missing), duplicates, target in train.columns
    )
    return Understanding(replace(settings, target=target, id_column=id_column, hints=hints), columns, findings)


def prepare(train: DataFrame, test: DataFrame | None, settings: Settings, stages: StageStore | None = None):
    """Flags and interactions, then imputation, integration and the final layout.

    Flags come before imputation, because afterwards nothing is missing any more. With a stage
    store every step reads what the step before it wrote.
    """
    def staged(name, left, right):
        if stages is None:
            return left, right
        stages.write(name, left, right)
        spark = left.sparkSession
        return spark.read.parquet(stages.path("train", name)), (
            spark.read.parquet(stages.path("test", name)) if right is not None else None
        )

    hints = settings.hints or Hints()
    train, test = staged("constructed", *prep.construct(train, test, hints))
    cleaned_train, cleaned_test, _ = prep.clean(train, test, settings.target, hints, settings.id_column)
    train, test = staged("clean", cleaned_train, cleaned_test)
    train, test = staged("integrated", *prep.integrate(train, test, settings.target))
    return train, test


def run(
    train: DataFrame, test: DataFrame | None = None, sample: DataFrame | None = None, settings: Settings = Settings(),
    stages: StageStore | None = None, model_path: str | None = None,
) -> Result:
    """Understand, prepare, compare baselines and build a submission that keeps its contract.

    Without a test table a fifth of every class is held out and takes its place; its labels only score the submission.
    The chosen model is fitted on all of train, saved, and the saved model makes the predictions.
    """
    understanding = understand(train, test, settings)
    settings = understanding.settings
    truth = None
    if test is None:
        key = [settings.id_column] if settings.id_column else [c for c in train.columns if c != settings.target]
        split = cut_lineage(prep.stratified_holdout(train, settings.target, key))
        train, held = (split.where(F.col("is_holdout") == v).drop("is_holdout") for v in (False, True))
        test = held.drop(settings.target)
        truth = held.select(settings.id_column, settings.target) if settings.id_column else None
    ready, ready_test = prepare(train, test, settings, stages)
    dropped = prep.wide_text_columns(ready, settings.hints)
    ready, ready_test = ready.drop(*dropped), ready_test.drop(*dropped)
    task = models.Task(settings.target, settings.id_column, settings.problem_type, settings.metric, settings.hints)
    lint = quality.prepared_lint(ready.drop(settings.id_column), settings.target)
    experiments = models.compare_experiments(ready, task, models.technique_ladder(task, settings.preferred))
    best = models.select_best(experiments, task)
    bundle = models.bundle(best, task)
    model_path = model_path or shared_folder(ready.sparkSession, "model")
    model, classes = models.fit_final(ready, task, best.technique)
    models.save_model(model, classes, ready.schema, model_path)
    submission = models.submit_saved(ready.sparkSession, model_path, ready_test, sample, task)
    layout = sample if sample is not None else ready_test.select(settings.id_column, F.lit(None).cast(ready.schema[settings.target].dataType).alias(settings.target))
    violations = contracts.submission_violations(submission, layout, settings.id_column)
    score = models.submission_score(submission, truth, task) if truth is not None else None
    return Result(understanding, ready, ready_test, lint, experiments, best, submission, violations, bundle, model_path, score)
