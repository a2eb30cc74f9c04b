"""Evaluation metrics computed from counts and moments, never from collected predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.metricrules import METRIC_ORDER, lower_is_better
from millrace.functions.numbers import log1p_clipped, ratio, ratio_or_zero
from millrace.plans.scan import ordered_scan, running_sum
from millrace.session import cut_lineage

LOW_RECALL = 0.7
LOW_PRECISION = 0.6
MAX_PIVOT_CLASSES = 1000


def confusion_counts(df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
    """``(by..., y, pred, n)``: all classification metrics follow from this small table."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """One row per true label and one ``pred_<label>`` column per label, in sorted order."""
    labels = [r["y"] for r in counts.select("y").distinct().orderBy("y").limit(MAX_PIVOT_CLASSES + 1).collect()]
    if len(labels) > MAX_PIVOT_CLASSES:
        raise ValueError("too many classes for a matrix; use confusion_counts, the long form")
    wide = counts.groupBy("y").pivot("pred", labels).agg(F.sum("n"))
    return wide.select("y", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"pred_{p}") for p in labels])


def class_metrics(counts: DataFrame, by: list[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support for every label that occurs in ``y``; 0 where undefined."""
    by = list(by)
    hit = F.col("y") == F.col("pred")
    truth = counts.groupBy(*by, F.col("y").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp")
    )
    predicted = counts.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("n_predicted"))
    both = truth.join(predicted, [*by, "label"], "left")
    tp, support = F.col("tp"), F.col("support")
    n_predicted = F.coalesce("n_predicted", F.lit(0))
    readable = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])
    text = F.col("label").cast("string")
    return both.select(
        *by,
        "label",
        F.coalesce(F.try_element_at(readable, text), text).alias("name"),
        ratio_or_zero(tp, n_predicted).alias("precision"),
        ratio_or_zero(tp, support).alias("recall"),
        ratio_or_zero(2 * tp, support + n_predicted).alias("f1"),
        "support",
    )


def overall_metrics(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and F1.

    F1 is that of class 1 when all true labels are 0 or 1, else the mean over all labels seen
    in either column.
    """
    by = list(by)
    n, hit = F.col("n"), F.col("y") == F.col("pred")
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), n.alias("truth"), F.lit(0).cast("long").alias("guess"), F.when(hit, n).otherwise(0).alias("tp")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("truth"), n.alias("guess"), F.lit(0).cast("long").alias("tp")),
            )
        ).alias("s"),
    )
    per_label = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum("s.truth").alias("truth"), F.sum("s.guess").alias("guess"), F.sum("s.tp").alias("tp")
    )
    f1 = ratio_or_zero(2 * F.col("tp"), F.col("truth") + F.col("guess"))
    in_truth = F.col("truth") > 0
    is_binary = F.bool_and(~in_truth | F.col("label").cast("string").isin("0", "1"))
    has_positive = F.bool_or(in_truth & (F.col("label").cast("string") == "1"))
    return (
        per_label.groupBy(*by)
        .agg(
            ratio(F.sum("tp"), F.sum("truth")).alias("accuracy"),
            F.avg(F.when(in_truth, ratio(F.col("tp"), F.col("truth")))).alias("balanced_accuracy"),
            F.when(is_binary & has_positive, F.max(F.when(F.col("label").cast("string") == "1", f1)))
            .otherwise(F.avg(f1))
            .alias("f1"),
            F.sum("truth").alias("n"),
        )
    )


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
    """RMSE, RMSE of log1p (negatives clipped to 0) and MAE in one aggregation."""
    error = F.col(y).cast("double") - F.col(pred).cast("double")
    log_error = log1p_clipped(F.col(y)) - log1p_clipped(F.col(pred))
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sqrt(F.avg(log_error * log_error)).alias("rmse_log"),
        F.avg(F.abs(error)).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )


REGRESSION_SCORES = {"rmse": "rmse", "mse": "rmse", "mae": "mae", "rmsle": "rmse_log", "rmse_log": "rmse_log", "root_mean_squared_error": "rmse", "mean_squared_error": "rmse", "mean_absolute_error": "mae"}
CLASS_SCORES = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "f1": "f1", "f1_macro": "f1", "roc_auc": "roc_auc", "auc": "roc_auc", "precision": "precision", "recall": "recall", "log_loss": "log_loss", "logloss": "log_loss"}


def score_column(metric: str, is_regression: bool) -> str:
    """Which metric column scores a model; no metric means rmse or accuracy, an unknown one is an error."""
    name = (metric or "").strip().lower().removeprefix("neg_")
    if not name:
        return "rmse" if is_regression else "accuracy"
    known = REGRESSION_SCORES if is_regression else CLASS_SCORES
    if name in known:
        return known[name]
    if is_regression and "log" in name:
        return "rmse_log"
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(known)}")


def binary_scores(oof: DataFrame, by: list[str] = ()) -> DataFrame:
    """``roc_auc, precision, recall, log_loss`` of the class with label 1.

    ``oof``: y and pred (0.0 or 1.0), score (larger: label 1 likelier) and probability of label 1 (NULL where a
    model has none). The area under the curve counts pairs by ranks, ties at their mean; equal scores are
    one row before anything is ordered.
    """
    tied = oof.groupBy(*by, "score").agg(F.sum("y").alias("up"), F.count(F.lit(1)).alias("n"))
    below = {"before": running_sum(F.col("n"))}
    ranked = ordered_scan(tied, list(by), ["score"], below)
    # Mean rank of a tie: ranks before it, plus half of its own (and a half).
    rank = F.col("before") - F.col("n") / 2 + 0.5
    sums = ranked.groupBy(*by).agg(F.sum(rank * F.col("up")).alias("r"), F.sum("up").alias("p"), F.sum("n").alias("t"))
    p, t = F.col("p"), F.col("t")
    area = sums.select(*by, F.when((p > 0) & (p < t), (F.col("r") - p * (p + 1) / 2) / (p * (t - p))).alias("roc_auc"))
    hit = F.count_if((F.col("y") == 1) & (F.col("pred") == 1))
    chance = F.least(F.greatest(F.when(F.col("y") == 1, F.col("probability")).otherwise(1 - F.col("probability")), F.lit(1e-15)), F.lit(1.0))
    rest = oof.groupBy(*by).agg(
        F.coalesce(F.try_divide(hit, F.count_if(F.col("pred") == 1)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, F.count_if(F.col("y") == 1)), F.lit(0.0)).alias("recall"),
        F.when(F.count("probability") == F.count(F.lit(1)), F.avg(-F.log(chance))).alias("log_loss"),
    )
    if by:
        return rest.join(area, list(by))
    return rest.withColumn("roc_auc", area.scalar())


def fold_summary(fold_metrics: DataFrame, score: str, by: list[str] = ()) -> DataFrame:
    """Mean and population standard deviation of a score over the folds."""
    return fold_metrics.groupBy(*by).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n_folds")
    )


def evaluation_bundle(fold_counts: DataFrame, score: str = "f1") -> DataFrame:
    """One row: metric map with per-class entries, confusion cells and the cross-validation map.

    ``fold_counts`` are confusion counts per fold; the table is tiny and read several times, so
    it is materialised first.
    """
    fold_counts = cut_lineage(fold_counts)
    counts = fold_counts.groupBy("y", "pred").agg(F.sum("n").alias("n"))
    fold_metrics = overall_metrics(fold_counts, ["fold"])
    per_class = class_metrics(counts).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.concat(F.lit(m + "_"), "name").alias("key"), F.col(m).alias("value"))
                    for m in ("precision", "recall", "f1")
                ]
            )
        ).alias("e")
    )
    overall = overall_metrics(counts).select(
        F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("key"), F.col(m).alias("value")) for m in ("accuracy", "balanced_accuracy", "f1")]
            )
        ).alias("e")
    )
    metrics = overall.unionByName(per_class).agg(F.map_from_entries(F.collect_list("e")).alias("metrics"))
    cells = counts.agg(F.sort_array(F.collect_list(F.struct("y", "pred", "n"))).alias("confusion"))
    cv = fold_summary(fold_metrics, score).select(
        F.create_map(F.lit("mean"), "mean", F.lit("std"), "std").alias("cv")
    )
    return metrics.select("metrics", cells.scalar().alias("confusion"), cv.scalar().alias("cv"))


def regression_bundle(oof: DataFrame, log_target: bool = False) -> DataFrame:
    """The bundle's shape for numbers: metric map, no confusion cells, and the cross-validation map.

    With a target learned in logs the error is that of all rows in logs, otherwise the mean of the folds' errors.
    """
    score = "rmse_log" if log_target else "rmse"
    summary = fold_summary(regression_metrics(oof, "y", "pred", ["fold"]), score)
    whole = regression_metrics(oof, "y", "pred").select(F.col("rmse_log").alias("w"), "mae")
    one = summary.withColumns({"w": whole.select("w").scalar(), "mae": whole.select("mae").scalar()})
    rmse = F.col("w") if log_target else F.col("mean")
    name = F.lit("rmse_log" if log_target else "rmse_raw")
    cells = F.array().cast("array<struct<y:double,pred:double,n:bigint>>")
    return one.select(
        F.create_map(F.lit("rmse"), rmse, name, rmse, F.lit("mae"), "mae").alias("metrics"),
        cells.alias("confusion"),
        F.create_map(F.lit("mean"), "mean", F.lit("std"), "std", F.lit("n_folds"), F.col("n_folds").cast("double")).alias("cv"),
    )


def binary_insight(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Recall, precision and warning flags of a two-class matrix."""
    recall, precision = ratio_or_zero(tp, tp + fn), ratio_or_zero(tp, tp + fp)
    flags = F.array_compact(
        F.array(
            F.when(recall < LOW_RECALL, "misses_positives"),
            F.when(precision < LOW_PRECISION, "false_alarms"),
        )
    )
    return F.struct(recall.alias("recall"), precision.alias("precision"), flags.alias("flags"))


def best_candidate(
    candidates: DataFrame, group: list[str], score: str, position: str, way: Column
) -> DataFrame:
    """Best finite score per group in the direction ``way``; the earlier candidate wins a tie."""
    value = F.col(score).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    signed = F.when(way == "minimize", value).otherwise(-value)
    best = Window.partitionBy(*group).orderBy(signed, position)
    kept = candidates.where(finite).withColumn("__rank", F.row_number().over(best))
    return kept.where(F.col("__rank") == 1).drop("__rank")


def best_per_metric(metrics: DataFrame) -> DataFrame:
    """Best value of every metric over all runs, in display order.

    ``metrics`` is long: ``(run_id, metric, value)``.
    """
    lower = lower_is_better(F.col("metric"))
    best = metrics.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    rank = F.array_position(F.array(*map(F.lit, METRIC_ORDER)), F.col("metric"))
    shown = F.when(rank > 0, rank - 1).otherwise(99).cast("int")
    return best.select(
        "metric", F.when(lower, F.col("low")).otherwise(F.col("high")).alias("best"), shown.alias("display_rank")
    ).orderBy("display_rank", "metric")
