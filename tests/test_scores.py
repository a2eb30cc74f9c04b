"""Scorers against plain Python, and models that are saved and loaded."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, models


def plain(rows):
    y, pred, score, p = (np.array(x, float) for x in zip(*rows))
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]
    hit = ((y == 1) & (pred == 1)).sum()
    loss = -np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-15, 1)))
    return np.mean(pairs), hit / max(1, (pred == 1).sum()), hit / max(1, (y == 1).sum()), loss


def test_binary_scores(spark):
    rng = np.random.default_rng(1)
    folds = {f: [(float(rng.random() < 0.4), float(rng.random() < 0.5), round(rng.random(), 1), rng.random()) for _ in range(60)] for f in range(3)}
    df = spark.createDataFrame([(f, *map(float, r)) for f, rows in folds.items() for r in rows], "fold int, y double, pred double, score double, probability double")
    for r in metrics.binary_scores(df, ["fold"]).collect():
        assert np.allclose((r.roc_auc, r.precision, r.recall, r.log_loss), plain(folds[r.fold]))
    whole = metrics.binary_scores(df).first()
    assert np.allclose((whole.roc_auc, whole.precision, whole.recall, whole.log_loss), plain(sum(folds.values(), [])))
    one = metrics.binary_scores(df.where("y = 1").withColumn("probability", F.lit(None).cast("double"))).first()
    assert one.roc_auc is None and one.log_loss is None and one.precision == 1.0


def test_unknown_metric_is_an_error():
    assert metrics.score_column("", False) == "accuracy" and metrics.score_column("ROC_AUC", False) == "roc_auc"
    assert metrics.score_column("neg_log_loss", False) == "log_loss" and metrics.score_column("RMSLE", True) == "rmse_log"
    for name, regression in (("kappa", False), ("accuracy", True)):
        with pytest.raises(ValueError):
            metrics.score_column(name, regression)


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(models, "TREES", 5)


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal() + 2 * (i % 2)), "ab"[int(rng.integers(2))], "yes" if i % 2 else "no") for i in range(160)]
    return spark.createDataFrame([*rows, (1000, 0.0, "a", None)], "id long, x double, c string, label string")


@pytest.mark.parametrize("technique", ["logistic_regression", "random_forest", "hist_gradient_boosting", "svm"])
def test_every_classifier_is_scored_by_auc(train, technique):
    task = models.Task("label", "id", "binary_classification", "roc_auc")
    got = models.run_experiment(train, task, technique, k=2)
    assert got.technique == technique and 0.75 < got.cv_score <= 1 and got.n_unlabelled == 1 and got.n_features == 2
    assert got.oof.count() == 160


@pytest.mark.parametrize("technique", ["ridge", "lasso", "elastic_net", "random_forest", "hist_gradient_boosting"])
def test_every_regressor_runs(train, technique):
    data = train.where("label is not null").withColumn("target", F.col("x") * 5 + F.rand(3)).drop("label")
    got = models.run_experiment(data, models.Task("target", "id", "regression", "rmse"), technique, k=2)
    assert math.isfinite(got.cv_score) and got.cv_score < 6.5


def test_saved_model_predicts_the_same(spark, train, tmp_path):
    task = models.Task("label", "id", "binary_classification", "accuracy")
    model, classes = models.fit_final(train, task, "logistic_regression")
    models.save_model(model, classes, train.schema, str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    test = train.drop("label")
    first, second = (dict(models.predict(*m, test, task).collect()) for m in ((model, classes, train.schema), again))
    assert first == second and set(first.values()) == {"yes", "no"}


def test_rows_with_one_source_are_chunked_apart(spark):
    from millrace.operators import corpus

    rows = [("same", "# t\n## s\nfirst text"), ("same", "# t\n## s\nsecond text"), (None, "third"), (None, "fourth\n\nfifth")]
    df = spark.createDataFrame(rows, "name string, body string").coalesce(1)
    got = sorted((r.source or "", r.chunk_no, r.text) for r in corpus.chunk_documents(df, "name", "body").collect())
    assert got == [("", 0, "fourth\n\nfifth"), ("", 0, "third"), ("same", 0, "first text"), ("same", 0, "second text")]


def test_modes_of_long_and_short_texts(spark):
    from millrace.operators import profile

    long_a, long_b, hexed = "a" * 5000, "b" * 5000, "f" * 64
    rows = [(long_b, "x", hexed, None), (long_b, "x", hexed, None), (long_a, "y", "zz", None), (long_a, "y", "zz", None), ("zzz", None, "q", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert profile.column_modes(df, ["a", "b", "c", "d"]) == {"a": long_a, "b": "x", "c": hexed}


def test_quantile_jobs_do_not_depend_on_columns(spark):
    from millrace.plans import quantiles

    df = spark.range(3000).selectExpr(*[f"IF(id % 7 = {i % 7}, NULL, (id * {2 * i + 1}) % 997) AS c{i}" for i in range(12)])
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n in (2, 12):
        spark.sparkContext.setJobGroup(f"quantiles-{n}", "")
        columns = [f"c{i}" for i in range(n)]
        found = quantiles.exact_quantiles(df, columns, [0.1, 0.5, 0.99], direct_rows=10)
        spark.sparkContext.setJobGroup("other", "")
        jobs.append(len(tracker.getJobIdsForGroup(f"quantiles-{n}")))
        exact = df.agg(*[__import__("pyspark.sql.functions").sql.functions.percentile(c, [0.1, 0.5, 0.99]).alias(c) for c in columns]).first()
        assert all(abs(x - y) < 1e-9 for c in columns for x, y in zip(found[c], exact[c]))
    assert jobs[0] == jobs[1], jobs
