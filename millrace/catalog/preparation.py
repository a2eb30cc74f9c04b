"""Preparation, folds and prepared-table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.fixtures import (
    LABELLED_DOCUMENTS,
    ORDERS_DTYPES,
    ORDERS_SPLIT,
    ORDERS_WITH_GAPS,
    labelled_documents,
    orders_test,
    orders_train,
    orders_with_gaps,
    profile_sql,
)
from millrace.catalog.registry import query
from millrace.operators import folds, prep, profile, quality
from millrace.operators.roles import Hints

_MODES = """modes AS (SELECT arg_min(o_orderpriority, (-n, o_orderpriority)) AS mode FROM
      (SELECT o_orderpriority, count(*) AS n FROM train WHERE o_orderpriority IS NOT NULL GROUP BY 1)),
    medians AS (SELECT median(o_orderkey) AS k, median(o_custkey) AS c, median(o_totalprice) AS p FROM train)"""


@query(
    "impute_train_stats",
    f"""WITH {ORDERS_SPLIT}, {_MODES}
    SELECT 'o_orderkey' AS "column", CAST(k AS DOUBLE) AS median, NULL AS mode FROM medians
    UNION ALL SELECT 'o_custkey', CAST(c AS DOUBLE), NULL FROM medians
    UNION ALL SELECT 'o_totalprice', round(p, 6), NULL FROM medians
    UNION ALL SELECT 'o_orderpriority', NULL, mode FROM modes""",
)
def impute_train_stats(t):
    """Fitted fill values; the table of fills has one row per column."""
    values = prep.fit_imputation(orders_train(t), "o_orderstatus")
    rows = [(c, round(v, 6), None) for c, v in values.numbers.items()] + [(c, None, v) for c, v in values.texts.items()]
    return t.spark.createDataFrame(rows, "column string, median double, mode string")


_IMPUTED = f"""WITH {ORDERS_SPLIT}, {_MODES},
    filled AS (SELECT 'train' AS side, train.* EXCLUDE (o_orderstatus) FROM train UNION ALL SELECT 'test', test.* FROM test)
    SELECT side, o_orderkey, o_custkey,
      round(coalesce(o_totalprice, p), 6) AS o_totalprice, o_orderdate, coalesce(o_orderpriority, mode) AS o_orderpriority
    FROM filled, medians, modes"""


@query("impute_apply", _IMPUTED)
def impute_apply(t):
    train, test, _ = prep.clean(orders_train(t), orders_test(t), "o_orderstatus")
    both = train.drop("o_orderstatus").withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(
    "clean_pipeline",
    f"""WITH {ORDERS_SPLIT}, {_MODES},
    cleaned AS (SELECT o_orderstatus, coalesce(o_totalprice, -1) AS o_totalprice, coalesce(o_orderpriority, '__ABSENT__') AS o_orderpriority FROM train)
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM cleaned GROUP BY ALL""",
)
def clean_pipeline(t):
    hints = Hints(na_means_absent=("o_orderpriority", "o_totalprice"))
    train, _, _ = prep.clean(orders_train(t), orders_test(t), "o_orderstatus", hints)
    return train.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "na_absent_fill",
    f"""WITH {LABELLED_DOCUMENTS} SELECT doc_id, lang, source, n_chars, coalesce(quality, -1) AS quality,
    coalesce(toxic, -1) AS toxic FROM docs""",
)
def na_absent_fill(t):
    return prep.fill_structural_absence(labelled_documents(t), ["quality", "toxic"])


@query(
    "missing_indicator",
    f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice_missing,
    CAST(o_orderpriority IS NULL AS INTEGER) AS o_orderpriority_missing, 0 AS o_comment_missing FROM gaps""",
)
def missing_indicator(t):
    flagged = prep.missing_indicators(orders_with_gaps(t), ["o_totalprice", "o_orderpriority", "o_comment"])
    return flagged.select("o_orderkey", "o_totalprice_missing", "o_orderpriority_missing", "o_comment_missing")


@query(
    "pair_interaction",
    f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, round(coalesce(o_totalprice, 0) * o_custkey, 4) AS o_totalprice_x_o_custkey FROM gaps""",
)
def pair_interaction(t):
    out = prep.pair_interaction(orders_with_gaps(t), ["o_totalprice", "o_custkey"])
    return out.select("o_orderkey", F.round("o_totalprice_x_o_custkey", 4).alias("o_totalprice_x_o_custkey"))


@query(
    "construct_features",
    f"""WITH {ORDERS_SPLIT}, c AS (SELECT 'train' AS side, o_totalprice, o_custkey FROM train UNION ALL SELECT 'test', o_totalprice, o_custkey FROM test)
    SELECT side, count(*) AS n, CAST(sum(CAST(o_totalprice IS NULL AS INTEGER)) AS BIGINT) AS flagged,
      round(sum(coalesce(o_totalprice, 0) * o_custkey), 0) AS interaction FROM c GROUP BY side""",
)
def construct_features(t):
    hints = Hints(high_missing=("o_totalprice",), numeric_with_missing=("o_totalprice", "o_custkey"))
    train, test = prep.construct(orders_train(t), orders_test(t), hints)
    both = train.drop("o_orderstatus").withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_totalprice_missing").alias("flagged"),
        F.round(F.sum("o_totalprice_x_o_custkey"), 0).alias("interaction"),
    )


@query(
    "align_schema",
    f"""WITH {ORDERS_SPLIT} SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM test""",
)
def align_schema(t):
    shuffled = orders_test(t).select("o_orderpriority", "o_totalprice", "o_orderkey", "o_custkey", "o_orderdate", F.lit(1).alias("extra"))
    return prep.align_schema(shuffled, orders_train(t).schema)


@query(
    "integrate_tables",
    f"WITH {ORDERS_SPLIT} SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM test",
)
def integrate_tables(t):
    extra = orders_test(t).withColumn("extra", F.lit(1))
    return prep.integrate(orders_train(t), extra, "o_orderstatus")[1]


@query(
    "feature_select",
    """SELECT o_custkey, o_totalprice FROM orders""",
)
def feature_select(t):
    """Predictors without target and id, then only the numeric ones."""
    features, _ = prep.features_and_label(t.orders, "o_orderstatus", "o_orderkey")
    return features.select(*profile.numeric_columns(features))


@query("drop_wide_text", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_wide_text(t):
    hints = Hints(text_free=("lang", "text"), representation_options=("tfidf_logreg",))
    documents = t.documents
    return documents.drop(*prep.wide_text_columns(documents, hints))


_HELD_OUT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42'), doc_id) AS rk,
      count(*) OVER (PARTITION BY quality) AS n FROM docs)"""


@query(
    "stratified_holdout",
    f"""WITH {LABELLED_DOCUMENTS}, {_HELD_OUT}
    SELECT doc_id, quality, rk <= floor(n * 0.2 + 0.5) AS is_holdout FROM ranked""",
)
def stratified_holdout(t):
    docs = labelled_documents(t).select("doc_id", "quality")
    return prep.stratified_holdout(docs, "quality", ["doc_id"])


@query(
    "format_tables",
    f"""WITH {LABELLED_DOCUMENTS}, {_HELD_OUT}
    SELECT NULL AS doc_id, n_chars, quality, toxic FROM ranked WHERE NOT rk <= floor(n * 0.2 + 0.5)
    UNION ALL SELECT doc_id, n_chars, NULL, toxic FROM ranked WHERE rk <= floor(n * 0.2 + 0.5)""",
)
def format_tables(t):
    docs = labelled_documents(t)
    hints = Hints(text_free=("source", "lang"), categorical=("lang",))
    train, test = prep.format_tables(docs, None, "quality", "doc_id", hints)
    return train.unionByName(test, allowMissingColumns=True)


_FOLDS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42')) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels),
    folded AS (SELECT *, (rk > floor(n * 0.2 + 0.5))::INT + (rk > floor(n * 0.4 + 0.5))::INT + (rk > floor(n * 0.6 + 0.5))::INT + (rk > floor(n * 0.8 + 0.5))::INT AS fold FROM ranked)"""


@query(
    "fold_assign_stratified",
    f"WITH {_FOLDS} SELECT doc_id, quality, fold FROM folded",
)
def fold_assign_stratified(t):
    return folds.stratified_folds(t.labels.select("doc_id", "quality"), "quality", ["doc_id"])


@query(
    "fold_assign_plain",
    """SELECT o_orderkey, CAST(CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders""",
)
def fold_assign_plain(t):
    return folds.plain_folds(t.orders.select("o_orderkey"), ["o_orderkey"])


@query(
    "oof_union",
    f"WITH {_FOLDS} SELECT doc_id, quality, fold FROM folded",
)
def oof_union(t):
    assigned = folds.stratified_folds(t.labels.select("doc_id", "quality"), "quality", ["doc_id"])
    return folds.fold_union([assigned.where(F.col("fold") == i) for i in range(folds.FOLDS)])


@query(
    "prep_audit",
    f"""WITH {ORDERS_SPLIT}, b AS (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS "column",
      unnest([count(*)-count(o_orderkey), count(*)-count(o_custkey), count(*)-count(o_orderstatus), count(*)-count(o_totalprice),
              count(*)-count(o_orderdate), count(*)-count(o_orderpriority)]) AS mb, count(*) AS n FROM train)
    SELECT "column", mb AS missing_before, CASE WHEN "column" <> 'o_orderkey' THEN 0::BIGINT END AS missing_after, n AS rows_before,
      CASE WHEN "column" <> 'o_orderkey' THEN n END AS rows_after, CASE WHEN "column" = 'o_orderkey' THEN 'dropped' ELSE 'kept' END AS change FROM b
    UNION ALL SELECT 'o_totalprice_missing', NULL, 0, NULL, any_value(n), 'derived' FROM b""",
)
def prep_audit(t):
    train = orders_train(t)
    hints = Hints(high_missing=("o_totalprice",))
    flagged, _ = prep.construct(train, None, hints)
    prepared, _, _ = prep.clean(flagged, None, "o_orderstatus")
    return quality.prep_audit(train, prepared.drop("o_orderkey"), "o_orderstatus")


@query(
    "prep_lint",
    f"""WITH {ORDERS_WITH_GAPS}, p AS ({profile_sql('gaps', ORDERS_DTYPES)})
    SELECT "column", 'target_missing' AS rule FROM p WHERE "column" = 'o_totalprice' AND n_missing > 0
    UNION ALL SELECT 'o_orderkey', 'id_present' UNION ALL SELECT 'fixed', 'constant_predictor'""",
)
def prep_lint(t):
    return quality.prepared_lint(orders_with_gaps(t).withColumn("fixed", F.lit(1)), "o_totalprice", "o_orderkey")


@query(
    "derived_counts",
    """SELECT o_orderkey, o_custkey + n_lines + 1 AS party, CAST(o_custkey + n_lines + 1 = 1 AS INTEGER) AS alone
    FROM (SELECT o_orderkey, any_value(o_custkey) AS o_custkey, count(l_orderkey) AS n_lines
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""",
)
def derived_counts(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    joined = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return prep.count_features(joined, ["o_custkey", "n_lines"], "party", "alone").select("o_orderkey", "party", "alone")


@query(
    "low_cardinality",
    """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_distinct FROM orders
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""",
)
def low_cardinality(t):
    return prep.low_cardinality(profile.column_profile(t.orders))


@query(
    "class_weights",
    """SELECT o_orderstatus AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 8) AS weight
    FROM orders GROUP BY 1""",
)
def class_weights(t):
    return folds.class_weights(t.orders, "o_orderstatus").withColumn("weight", F.round("weight", 8))


@query(
    "class_shares",
    f"""WITH {LABELLED_DOCUMENTS} SELECT quality AS label, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS name, count(*) AS n,
    round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM docs GROUP BY 1""",
)
def class_shares(t):
    shares = folds.class_shares(labelled_documents(t), "quality", {"0": "poor", "1": "good"})
    return shares.withColumn("share", F.round("share", 6))


@query(
    "imbalance_warning",
    """SELECT count(*) AS n_classes, round(min(n) / sum(n), 8) AS minority_share, count(*) = 2 AND min(n) / sum(n) < 0.4 AS warn
    FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)""",
)
def imbalance_warning(t):
    return folds.imbalance_warning(t.labels, "quality").withColumn("minority_share", F.round("minority_share", 8))
