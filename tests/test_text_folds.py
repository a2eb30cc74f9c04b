"""Term counts for all folds at once against features fitted fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import models


@pytest.mark.parametrize("terms", [models.MAX_TERMS, 7])
def test_folds_share_one_count_of_terms(spark, terms):
    words = "Über alles the cat sat on a mat ÉTÉ x_1 dog ran".split()
    texts = [" ".join(words[(i * j) % len(words)] for j in range(1, 3 + i % 7)) for i in range(30)] + [None, "", "only once here", "?"]
    df = spark.createDataFrame([(i, t, i % 3, float(i)) for i, t in enumerate(texts)], "id long, text string, fold int, size double")
    counted, weights = models.count_text_folds(df, "text", 3, terms)
    assert counted.columns == ["id", "fold", "size", "__counts"] and counted.count() == len(texts)
    for i in range(3):
        apart = models.fit_text_features(df.where(F.col("fold") != i), "text", ["size"], terms=terms)
        together = models.PipelineModel(models._weighting_stages(counted.where(F.col("fold") != i), weights[i], ["size"], "features"))
        assert sum(w > 0 for w in weights[i]) == len(apart.stages[4].vocabulary)
        if terms > 7:  # a cut vocabulary may hold other terms of equal counts
            for rows, model, out in ((df, apart, {}), (counted, together, {})):
                out.update({r["id"]: np.sort(r["features"].toArray()) for r in model.transform(rows).select("id", "features").collect()})
                first = out if model is apart else first
            assert first.keys() == out.keys()
            for key, row in first.items():
                own = out[key]
                assert np.allclose(row[np.abs(row) > 0], own[np.abs(own) > 0])


def test_texts_of_one_block_are_spread(spark):
    rows = [(i, f"good fine {'nice' if i % 2 else 'bad'} word{i % 5}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, y int").coalesce(1)
    task = models.Task("y", "id", metric="f1", hints=models.Hints(text_free=("text",)))
    seen, plain = [], models.count_text_folds
    try:
        models.count_text_folds = lambda assigned, *a: seen.append(assigned.rdd.glom().map(len).collect()) or plain(assigned, *a)
        result = models.run_experiment(df, task, "tfidf_logreg")
    finally:
        models.count_text_folds = plain
    assert max(seen[0]) <= 20 and sum(seen[0]) == 80
    assert result.cv_score == 1.0 and result.oof.count() == 80
