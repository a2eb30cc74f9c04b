"""Features, cross-validation and scoring."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.catalog.fixtures import ORDERS_SPLIT, orders_test, orders_train
from millrace.catalog.registry import query
from millrace.operators import contracts, models
from millrace.operators.roles import Hints


@query(
    "scale_numeric",
    f"""WITH {ORDERS_SPLIT}, s AS (SELECT median(o_totalprice) AS m FROM train), f AS (SELECT o_orderkey, coalesce(o_totalprice, m) AS p FROM train, s)
    SELECT o_orderkey, round((p - avg(p) OVER ()) / stddev_pop(p) OVER (), 6) AS z FROM f""",
)
def scale_numeric(t):
    train = orders_train(t)
    scaled = models.fit_scaling(train, ["o_totalprice"]).transform(train)
    return scaled.select("o_orderkey", F.round("o_totalprice__z", 6).alias("z"))


@query(
    "scale_onehot",
    f"""WITH {ORDERS_SPLIT}, v AS (SELECT count(DISTINCT coalesce(o_orderpriority, 'missing')) AS k FROM train)
    SELECT o_orderkey, 1 + k AS width, CASE WHEN o_orderpriority IS NOT DISTINCT FROM '5-LOW' THEN 0.0::DOUBLE ELSE 1.0 END AS hot FROM test, v""",
)
def scale_onehot(t):
    """Encoder fitted on train; one priority is renamed in test, so it is unknown and all zeros."""
    train = orders_train(t)
    model = models.fit_tabular_features(train, ["o_totalprice", "o_orderpriority"])
    renamed = F.when(F.col("o_orderpriority") == "5-LOW", "6-NEW").otherwise(F.col("o_orderpriority"))
    rows = model.transform(orders_test(t).withColumn("o_orderpriority", renamed))
    cells = vector_to_array("features")
    hot = F.aggregate(F.slice(cells, F.lit(2), F.size(cells)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("o_orderkey", F.size(cells).cast("long").alias("width"), hot.alias("hot"))


@query(
    "onehot_wide",
    """WITH c AS (SELECT *, CASE WHEN l_linenumber <= 2 THEN l_orderkey || '/' || l_linenumber ELSE l_shipdate::DATE || '' END AS key FROM lineitem),
    d AS (SELECT key, row_number() OVER (ORDER BY count(*) DESC, key) AS place FROM c WHERE l_quantity < 45 GROUP BY key), s AS (SELECT count(*) AS k FROM d)
    SELECT l_orderkey, l_linenumber, 1 + k AS width, CASE WHEN place IS NULL THEN 0 ELSE 1 END AS hot, CASE WHEN place IS NULL THEN 0 ELSE place END AS hot_at FROM c LEFT JOIN d USING (key), s""",
)
def onehot_wide(t):
    """A column of more than 20,000 categories at the small scale: where each row's hot cell is. The encoder is
    fitted on part of the rows, so some categories are unknown."""
    key = F.when(F.col("l_linenumber") <= 2, F.concat_ws("/", "l_orderkey", "l_linenumber")).otherwise(F.col("l_shipdate").cast("date").cast("string"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", key.alias("key"))
    model = models.fit_tabular_features(rows.where("l_quantity < 45"), ["l_quantity", "key"])
    # The vector as text: "(size,[indices],[values])", so that no row is opened to its full width.
    shown = F.to_json(F.struct("features"))
    width = F.get_json_object(shown, "$.features.size").cast("long")
    cells = F.from_json(F.get_json_object(shown, "$.features.indices"), "array<long>")
    hot = (F.size(cells) - 1).cast("int")
    return model.transform(rows).select("l_orderkey", "l_linenumber", width.alias("width"), hot.alias("hot"), F.when(hot == 1, F.get(cells, F.lit(1))).otherwise(0).alias("hot_at"))


@query(
    "tfidf_features",
    """WITH words AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS w FROM conversations),
    terms AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM words) GROUP BY ALL),
    df AS (SELECT term, count(*) AS n_documents FROM terms GROUP BY term HAVING count(*) >= 2),
    weighted AS (SELECT conv_id, turn, term, n_documents, tf * (ln((1 + (SELECT count(*) FROM conversations)) / (1 + n_documents)) + 1) AS w FROM terms JOIN df USING (term)),
    unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS u FROM weighted)
    SELECT term, any_value(n_documents) AS n_documents, round(sum(u), 5) AS total_weight FROM unit GROUP BY term""",
)
def tfidf_features(t):
    """Document frequency and total unit-length weight of every term: all terms as rows, so no vocabulary is held anywhere."""
    unit = models.tfidf_terms(t.conversations, ["conv_id", "turn"], "text")
    return unit.groupBy("term").agg(F.first("n_documents").alias("n_documents"), F.round(F.sum("weight"), 5).alias("total_weight"))


def _documents_task():
    return models.Task("quality", "doc_id", "classification", "f1", Hints(text_free=("text",)))


@query(
    "text_baseline_cv",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42')) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels JOIN documents USING (doc_id))
    SELECT doc_id, (rk > floor(n * 0.2 + 0.5))::INT + (rk > floor(n * 0.4 + 0.5))::INT + (rk > floor(n * 0.6 + 0.5))::INT + (rk > floor(n * 0.8 + 0.5))::INT AS fold, quality::INT AS y, true AS has_class FROM r""",
)
def text_baseline_cv(t):
    """Every labelled document is predicted exactly once, by a model that has not seen its fold.

    The predicted class itself depends on the optimiser, so only its validity is compared.
    """
    train = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    oof = models.run_experiment(train, _documents_task(), "tfidf_logreg").oof
    return oof.select("doc_id", "fold", F.col("y").cast("int").alias("y"), F.col("pred").isin(0.0, 1.0).alias("has_class"))


@query(
    "tabular_baseline_cv",
    """WITH o AS (SELECT l_orderkey, sum(l_extendedprice) AS price, CAST('0x' || substr(md5(l_orderkey || '|42'), 1, 8) AS BIGINT) % 5 AS fold FROM lineitem GROUP BY 1)
    SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, true AS beats_mean FROM o GROUP BY 1""",
)
def tabular_baseline_cv(t):
    """Folds of the regression ladder; the best technique must beat predicting the mean."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max("l_returnflag").alias("flag"),
        F.sum("l_extendedprice").alias("price"),
    )
    task = models.Task("price", "l_orderkey", "regression", "rmse")
    results = models.compare_experiments(lines, task, ["ridge", "lasso"])
    best = models.select_best(results, task)
    spread = lines.agg(F.stddev_pop("price")).scalar()
    return best.fold_metrics.select("fold", "n", (F.col("rmse") < spread).alias("beats_mean"))


@query(
    "ridge_folds",
    """WITH o AS (SELECT l_orderkey, sum(l_extendedprice) AS y, sum(l_quantity) AS a0, avg(l_discount) AS b, CAST('0x' || substr(md5(l_orderkey || '|42'), 1, 8) AS BIGINT) % 5 AS fold FROM lineitem GROUP BY 1),
    g AS (SELECT *, CASE WHEN l_orderkey % 7 > 0 THEN a0 END AS a1 FROM o), ks AS (SELECT unnest(range(5)) AS k),
    md AS (SELECT k, median(a1) AS m FROM ks JOIN g ON fold <> k GROUP BY k), f AS (SELECT k, fold, y, coalesce(a1, m) AS a, b FROM ks JOIN md USING (k), g),
    s AS (SELECT k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM f WHERE fold <> k GROUP BY k),
    w AS (SELECT *, n * cab / (sa * sb) AS r, n * cay / sa AS pa, n * cby / sb AS pb FROM s),
    z AS (SELECT *, (pa * (n + 1) - pb * r) / ((n + 1) * (n + 1) - r * r) / sa AS wa, (pb * (n + 1) - pa * r) / ((n + 1) * (n + 1) - r * r) / sb AS wb FROM w)
    SELECT CAST(k AS INTEGER) AS fold, count(*) AS n, round(sqrt(avg((y - (my + wa * (a - ma) + wb * (b - mb))) ** 2)), 3) AS rmse FROM f JOIN z USING (k) WHERE fold = k GROUP BY k""",
)
def ridge_folds(t):
    """Out-of-fold error of ridge with gaps in a column; the closed form leaves nothing to an optimiser."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.sum("l_extendedprice").alias("price"))
    lines = lines.withColumn("a", F.when(F.col("l_orderkey") % 7 > 0, F.col("a")))
    result = models.run_experiment(lines, models.Task("price", "l_orderkey", "regression", "rmse"), "ridge")
    return result.fold_metrics.select("fold", "n", F.round("rmse", 3).alias("rmse"))


@query(
    "score_and_submit",
    f"""WITH {ORDERS_SPLIT} SELECT o_orderkey, true AS has_prediction, 0::BIGINT AS violations FROM test""",
)
def score_and_submit(t):
    """Every test order gets one of the known classes, and the submission contract holds."""
    train, test = orders_train(t).drop("o_orderdate"), orders_test(t)
    task = models.Task("o_orderstatus", "o_orderkey", hints=Hints(categorical=("o_orderpriority",)))
    sample = test.select("o_orderkey", F.lit("F").alias("o_orderstatus"))
    submission = models.score_and_submit(train, test, sample, task, "logistic_regression")
    broken = contracts.submission_violations(submission, sample, "o_orderkey").count()
    known = F.col("o_orderstatus").isin("F", "O", "P")
    return submission.select("o_orderkey", F.coalesce(known, F.lit(False)).alias("has_prediction"), F.lit(broken).cast("long").alias("violations"))
