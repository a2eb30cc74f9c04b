"""Which way a metric is better, whether it meets a threshold, and how names are unified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the stored run records.
MINIMIZE_MARKS = ["rmse", "mae", "mse", "loss", "error"]
LOWER_IS_BETTER_MARKS = ["rmse", "rmsle", "mae", "mse", "mape", "loss", "error"]
SCORE_CEILINGS = {"accuracy": 0.999, "auc": 0.999, "roc_auc": 0.999}
METRIC_ORDER = [
    "accuracy",
    "balanced_accuracy",
    "precision",
    "recall",
    "f1",
    "roc_auc",
    "rmse",
    "mae",
    "mse",
    "r2",
    "mape",
]
TECHNIQUE_ALIASES = {
    "lgbm": "lightgbm",
    "xgb": "xgboost",
    "logreg": "logistic_regression",
    "lr": "logistic_regression",
    "gb": "gradient_boosting",
    "gbc": "gradient_boosting",
    "gbr": "gradient_boosting",
    "rf": "random_forest",
    "svc": "svm",
    "hist_gb": "hist_gradient_boosting",
    "tfidf": "tfidf_logreg",
    "tfidf_logistic": "tfidf_logreg",
    "openai_embeddings_logreg": "tfidf_logreg",
}
RUNNABLE_TYPES = [
    "",
    "classification",
    "binary_classification",
    "multiclass_classification",
    "regression",
    "prediction",
]


def direction(metric: Column, explicit: Column | None = None) -> Column:
    guessed = F.when(F.lower(F.coalesce(metric, F.lit(""))).rlike("|".join(MINIMIZE_MARKS)), "minimize")
    guessed = guessed.otherwise("maximize")
    if explicit is None:
        return guessed
    return F.when(explicit.isin("minimize", "maximize"), explicit).otherwise(guessed)


def lower_is_better(metric: Column) -> Column:
    return F.lower(F.coalesce(metric, F.lit(""))).rlike("|".join(LOWER_IS_BETTER_MARKS))


def meets(score: Column, threshold: Column, way: Column) -> Column:
    """NULL while score or threshold is unknown."""
    return F.when(way == "minimize", score <= threshold).otherwise(score >= threshold)


def technique(name: Column) -> Column:
    plain = F.translate(F.lower(F.trim(name)), "- ", "__")
    aliases = F.create_map(*[F.lit(x) for pair in TECHNIQUE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def default_metric(problem_type: Column) -> Column:
    lowered = F.lower(F.coalesce(problem_type, F.lit("classification")))
    return F.when(F.contains(lowered, F.lit("regress")), "rmse").otherwise("accuracy")


def default_direction(metric: Column) -> Column:
    return F.when(metric.isin("rmse", "rmse_log", "mae", "mse"), "minimize").otherwise("maximize")


def problem_type_supported(problem_type: Column) -> Column:
    plain = F.translate(F.lower(F.trim(F.coalesce(problem_type, F.lit("")))), "- ", "__")
    return plain.isin(RUNNABLE_TYPES)


def case_status(problem_type: Column, runnable: Column, marked_ready: Column) -> Column:
    """draft until marked ready, then ready or unsupported."""
    return (
        F.when(~marked_ready, "draft")
        .when(~problem_type_supported(problem_type) | ~F.coalesce(runnable, F.lit(False)), "unsupported")
        .otherwise("ready")
    )


def run_status(halted: Column, ended_at: Column) -> Column:
    return F.when(halted, "halted").when(ended_at.isNotNull(), "complete").otherwise("running")
