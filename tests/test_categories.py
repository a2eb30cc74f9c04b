"""One-hot features from a dictionary table."""

import random
from collections import Counter

import pytest
from pyspark.ml import PipelineModel

from millrace.operators import categories, models

DDL = "id long, x double, a string, b string"


def rows(n=300):
    rng = random.Random(1)
    return [(i, rng.choice([None, 1.0, 2.5, float("nan")]), rng.choice(["p", "q", "r", None, "", "Ü"]), f"v{rng.randrange(40)}") for i in range(n)]


def plain_places(values):
    counts = Counter(values)
    return {v: i for i, (v, _) in enumerate(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0].encode())))}


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_places_follow_frequency_then_value(spark, hot_rows):
    data = rows()
    df = spark.createDataFrame(data, DDL)
    path, sizes = categories.fit_dictionary(df, ["a", "b"], hot_rows)
    found = {}
    for r in categories._dictionary(spark, path).collect():
        found.setdefault(r.slot, {})[r.value] = r["index"]
    assert found == {0: plain_places([a for _, _, a, _ in data if a is not None]), 1: plain_places([b for *_, b in data])}
    assert sizes == [len(found[0]), len(found[1])]


def test_vectors_and_saved_model(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, DDL)
    model = models.fit_tabular_features(df, ["x", "a", "b"])
    a, b = plain_places([v if v is not None else "missing" for _, _, v, _ in data]), plain_places([v for *_, v in data])
    test = spark.createDataFrame([*data[:50], (900, 1.0, "new", "v1"), (901, None, None, "other"), (902, 2.5, "new", "new")], DDL)
    got = {r.id: r for r in model.transform(test).select("id", "x__z", "features", "a").collect()}
    assert len(got) == 53
    for number, _, va, vb in [*data[:50], (900, 1.0, "new", "v1"), (901, None, None, "other"), (902, 2.5, "new", "new")]:
        v = got[number].features
        hot = [0] + [1 + a[k] for k in ([va if va is not None else "missing"]) if k in a] + [1 + len(a) + b[k] for k in [vb] if k in b]
        assert v.size == 1 + len(a) + len(b) and v.indices.tolist() == hot and v.values.tolist() == [got[number].x__z] + [1.0] * (len(hot) - 1)
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(test)
    assert {r.id: r.features for r in again.collect()} == {i: r.features for i, r in got.items()}
    assert model.transform(test.limit(0)).count() == 0


def test_a_linear_model_over_many_categories(spark):
    """More categories than any former limit, and one of them with a third of the rows."""
    df = spark.range(30000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('c', id)) AS c", "CAST(id % 3 = 0 AS double) * 10 AS y")
    task = models.Task("y", "id", "regression", "rmse")
    model, classes = models.fit_final(df, task, "lasso")
    assert classes == [] and model.stages[0].stages[-1].sizes == [20001]
    pred = models.predict(model, classes, df.schema, df.where("id < 30").drop("y"), task).collect()
    assert len(pred) == 30 and all(abs(r.y - (10 if r.id % 3 == 0 else 0)) < 5 for r in pred)
