"""Metrics, candidate selection and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.fixtures import ORDERS_WITH_GAPS, SCORED_LABELS, orders_with_gaps, scored_labels
from millrace.catalog.profiling import FILES, files
from millrace.catalog.registry import query
from millrace.functions import metricrules, numbers, records
from millrace.operators import contracts, folds, metrics

_LABEL_STATS = """labels_seen AS (SELECT DISTINCT y AS label FROM scored),
    stats AS (SELECT label, (SELECT count(*) FROM scored WHERE y = label) AS support,
      (SELECT count(*) FROM scored WHERE pred = label) AS guessed,
      (SELECT count(*) FROM scored WHERE y = label AND pred = label) AS tp FROM labels_seen),
    per_class AS (SELECT label, support, CASE WHEN guessed = 0 THEN 0.0 ELSE tp / guessed END AS p,
      CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r, 2.0 * tp / (support + guessed) AS f FROM stats)"""


@query(
    "confusion_matrix",
    f"""WITH {SCORED_LABELS} SELECT y, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM scored GROUP BY y""",
)
def confusion_matrix(t):
    return metrics.confusion_matrix(metrics.confusion_counts(scored_labels(t), "y", "pred"))


@query(
    "class_metrics",
    f"""WITH {SCORED_LABELS}, {_LABEL_STATS} SELECT label, CASE label WHEN 1 THEN 'good' ELSE 'poor' END AS name,
    round(p, 8) AS precision, round(r, 8) AS recall, round(f, 8) AS f1, support FROM per_class""",
)
def class_metrics(t):
    out = metrics.class_metrics(metrics.confusion_counts(scored_labels(t), "y", "pred"), names={"0": "poor", "1": "good"})
    return out.withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query(
    "overall_metrics",
    f"""WITH {SCORED_LABELS}, {_LABEL_STATS}
    SELECT (SELECT round(avg(CAST(y = pred AS INTEGER)), 8) FROM scored) AS accuracy, round(avg(r), 8) AS balanced_accuracy,
      round(max(f) FILTER (label = 1), 8) AS f1, CAST(sum(support) AS BIGINT) AS n FROM per_class""",
)
def overall_metrics(t):
    out = metrics.overall_metrics(metrics.confusion_counts(scored_labels(t), "y", "pred"))
    return out.withColumns({c: F.round(c, 8) for c in ("accuracy", "balanced_accuracy", "f1")})


@query(
    "overall_metrics_multiclass",
    """WITH s AS (SELECT o_orderpriority AS y, CASE WHEN o_totalprice > 300000 THEN '1-URGENT' WHEN o_totalprice > 150000 THEN '3-MEDIUM' ELSE '5-LOW' END AS pred FROM orders),
    l AS (SELECT DISTINCT y AS label FROM s),
    st AS (SELECT label, count(*) FILTER (y = label) AS support, count(*) FILTER (pred = label) AS guessed, count(*) FILTER (y = label AND pred = label) AS tp
      FROM s JOIN l ON s.y = l.label OR s.pred = l.label GROUP BY label)
    SELECT round(sum(tp) / sum(support), 8) AS accuracy, round(avg(tp / support), 8) AS balanced_accuracy,
      round(avg(2.0 * tp / (support + guessed)), 8) AS f1, CAST(sum(support) AS BIGINT) AS n FROM st""",
)
def overall_metrics_multiclass(t):
    price = F.col("o_totalprice")
    pred = F.when(price > 300000, "1-URGENT").when(price > 150000, "3-MEDIUM").otherwise("5-LOW")
    counts = metrics.confusion_counts(t.orders.withColumn("pred", pred), "o_orderpriority", "pred")
    return metrics.overall_metrics(counts).withColumns({c: F.round(c, 8) for c in ("accuracy", "balanced_accuracy", "f1")})


_RULE_PRICE = "l_quantity * 1500 - 5000"


@query(
    "regression_metrics",
    f"""SELECT l_returnflag, round(sqrt(avg(pow(l_extendedprice - ({_RULE_PRICE}), 2))), 4) AS rmse,
    round(sqrt(avg(pow(ln(1 + greatest(l_extendedprice, 0)) - ln(1 + greatest({_RULE_PRICE}, 0)), 2))), 6) AS rmse_log,
    round(avg(abs(l_extendedprice - ({_RULE_PRICE}))), 4) AS mae, count(*) AS n FROM lineitem GROUP BY 1""",
)
def regression_metrics(t):
    lines = t.lineitem.withColumn("pred", F.expr(_RULE_PRICE))
    out = metrics.regression_metrics(lines, "l_extendedprice", "pred", ["l_returnflag"])
    return out.withColumns({"rmse": F.round("rmse", 4), "rmse_log": F.round("rmse_log", 6), "mae": F.round("mae", 4)})


@query(
    "fold_scores",
    f"""WITH f AS (SELECT CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|42'), 1, 8) AS BIGINT) % 5 AS fold,
      sqrt(avg(pow(l_extendedprice - ({_RULE_PRICE}), 2))) AS rmse FROM lineitem GROUP BY 1)
    SELECT round(avg(rmse), 4) AS mean, round(stddev_pop(rmse), 4) AS std, count(rmse) AS n_folds FROM f""",
)
def fold_scores(t):
    lines = folds.plain_folds(t.lineitem.withColumn("pred", F.expr(_RULE_PRICE)), ["l_orderkey", "l_linenumber"])
    per_fold = metrics.regression_metrics(lines, "l_extendedprice", "pred", ["fold"])
    out = metrics.fold_summary(per_fold, metrics.score_column("mse", is_regression=True))
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "evaluation_bundle",
    f"""WITH {SCORED_LABELS}, {_LABEL_STATS},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(doc_id || '|42')) AS rk, count(*) OVER (PARTITION BY y) AS n FROM scored),
    folded AS (SELECT *, (rk > floor(n * 0.2 + 0.5))::INT + (rk > floor(n * 0.4 + 0.5))::INT + (rk > floor(n * 0.6 + 0.5))::INT + (rk > floor(n * 0.8 + 0.5))::INT AS fold FROM ranked),
    fold_f1 AS (SELECT fold, 2.0 * count(*) FILTER (y = 1 AND pred = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (pred = 1)) AS f1 FROM folded GROUP BY 1),
    entries AS (SELECT 'accuracy' AS metric, avg(CAST(y = pred AS INTEGER)) AS value FROM scored
      UNION ALL SELECT 'balanced_accuracy', avg(r) FROM per_class UNION ALL SELECT 'f1', f FROM per_class WHERE label = 1
      UNION ALL SELECT 'precision_' || label, p FROM per_class UNION ALL SELECT 'recall_' || label, r FROM per_class
      UNION ALL SELECT 'f1_' || label, f FROM per_class)
    SELECT metric, round(value, 8) AS value, (SELECT round(avg(f1), 8) FROM fold_f1) AS cv_mean, (SELECT round(stddev_pop(f1), 8) FROM fold_f1) AS cv_std FROM entries""",
)
def evaluation_bundle(t):
    scored = folds.stratified_folds(scored_labels(t), "y", ["doc_id"])
    bundle = metrics.evaluation_bundle(metrics.confusion_counts(scored, "y", "pred", ["fold"]))
    return bundle.select(F.explode("metrics").alias("metric", "value"), "cv").select(
        "metric", F.round("value", 8).alias("value"),
        F.round(F.col("cv")["mean"], 8).alias("cv_mean"), F.round(F.col("cv")["std"], 8).alias("cv_std"),
    )


@query(
    "binary_insight",
    f"""WITH {SCORED_LABELS}, m AS (SELECT lang, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
      count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM scored GROUP BY lang),
    r AS (SELECT *, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision FROM m)
    SELECT lang, round(recall, 8) AS recall, round(precision, 8) AS precision,
      concat_ws(',', CASE WHEN recall < 0.7 THEN 'misses_positives' END, CASE WHEN precision < 0.6 THEN 'false_alarms' END) AS flags FROM r""",
)
def binary_insight(t):
    def cell(y, pred):
        return F.count_if((F.col("y") == y) & (F.col("pred") == pred))

    cells = scored_labels(t).groupBy("lang").agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )
    insight = metrics.binary_insight(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    return cells.select("lang", insight.alias("i")).select(
        "lang", F.round("i.recall", 8).alias("recall"), F.round("i.precision", 8).alias("precision"),
        F.array_join("i.flags", ",").alias("flags"),
    )


_CANDIDATES = """candidates AS (SELECT p_brand, p_type, min(p_partkey) AS position,
      CASE WHEN avg(p_size) > 24 THEN avg(p_retailprice) WHEN p_type = 'PROMO' THEN 'NaN'::DOUBLE END AS score FROM part GROUP BY 1, 2)"""


def _candidates(t):
    score = F.when(F.avg("p_size") > 24, F.avg("p_retailprice")).when(F.col("p_type") == "PROMO", F.lit(float("nan")))
    return t.part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("position"), score.alias("score"))


@query(
    "best_candidate",
    f"""WITH {_CANDIDATES} SELECT p_brand, p_type, position, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score, position) AS rk FROM candidates WHERE score IS NOT NULL AND NOT isnan(score)) WHERE rk = 1""",
)
def best_candidate(t):
    way = metricrules.direction(F.lit("rmse"))
    return metrics.best_candidate(_candidates(t), ["p_brand"], "score", "position", way).withColumn("score", F.round("score", 6))


_NATION_METRICS = """nation_metrics AS (SELECT s_nationkey AS run_id, unnest(['accuracy', 'rmse', 'custom_loss', 'zeta']) AS metric,
      unnest([avg(s_acctbal), max(s_acctbal), min(s_acctbal), sum(s_suppkey)::DOUBLE]) AS value FROM supplier GROUP BY 1)"""


def nation_metrics(t):
    per_run = t.supplier.groupBy(F.col("s_nationkey").alias("run_id")).agg(
        F.avg("s_acctbal").alias("accuracy"), F.max("s_acctbal").alias("rmse"),
        F.min("s_acctbal").alias("custom_loss"), F.sum("s_suppkey").cast("double").alias("zeta"),
    )
    return per_run.unpivot(["run_id"], ["accuracy", "rmse", "custom_loss", "zeta"], "metric", "value")


@query(
    "best_per_metric",
    f"""WITH {_NATION_METRICS} SELECT metric, round(CASE WHEN metric IN ('rmse', 'custom_loss') THEN min(value) ELSE max(value) END, 6) AS best,
      CAST(CASE metric WHEN 'accuracy' THEN 0 WHEN 'rmse' THEN 6 ELSE 99 END AS INTEGER) AS display_rank FROM nation_metrics GROUP BY metric""",
)
def best_per_metric(t):
    return metrics.best_per_metric(nation_metrics(t)).withColumn("best", F.round("best", 6))


@query(
    "metric_direction",
    f"""WITH {_NATION_METRICS} SELECT run_id, metric, CASE WHEN run_id = 3 THEN 'maximize' WHEN metric IN ('rmse', 'custom_loss') THEN 'minimize' ELSE 'maximize' END AS direction FROM nation_metrics""",
)
def metric_direction(t):
    explicit = F.when(F.col("run_id") == 3, "maximize")
    return nation_metrics(t).select("run_id", "metric", metricrules.direction(F.col("metric"), explicit).alias("direction"))


@query(
    "submission_contract",
    """SELECT 'row_count' AS rule, CAST((SELECT count(*) FROM customer WHERE c_acctbal >= 0 OR c_mktsegment <> 'BUILDING') AS VARCHAR) AS detail
    WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING')
    UNION ALL SELECT 'null_ids', CAST(count(*) AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY' HAVING count(*) > 0
    UNION ALL SELECT 'missing_ids', CAST(count(*) AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY' OR (c_acctbal < 0 AND c_mktsegment = 'BUILDING') HAVING count(*) > 0
    UNION ALL SELECT 'columns', '[''c_custkey'', ''pred'', ''extra''] instead of [''c_custkey'', ''pred'']'""",
)
def submission_contract(t):
    """Some customers are left out and some ids are blank: every rule fires."""
    customer = t.customer
    sample = customer.select("c_custkey", F.lit(0.0).alias("pred"))
    kept = customer.where((F.col("c_acctbal") >= 0) | (F.col("c_mktsegment") != "BUILDING"))
    submission = kept.select(
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey")).alias("c_custkey"),
        F.col("c_acctbal").alias("pred"), F.lit(1).alias("extra"),
    )
    return contracts.submission_violations(submission, sample, "c_custkey")


@query(
    "attach_predictions",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal * 2, 2) END AS pred FROM customer""",
)
def attach_predictions(t):
    sample = t.customer.select("c_custkey", F.lit(0.0).alias("pred"))
    predictions = t.customer.where("c_acctbal >= 0").select(F.round(F.col("c_acctbal") * 2, 2).alias("pred"), "c_custkey")
    return contracts.attach_predictions(sample, predictions, "c_custkey", "pred")


@query(
    "prepared_validator",
    f"""WITH {ORDERS_WITH_GAPS} SELECT DISTINCT 'target_missing' AS rule, 'o_totalprice' AS detail FROM gaps WHERE o_totalprice IS NULL
    UNION ALL SELECT 'derived_absent', 'ratio' UNION ALL SELECT 'included_absent', 'comment' UNION ALL SELECT 'test_absent', '' """,
)
def prepared_validator(t):
    return contracts.prepared_violations(
        orders_with_gaps(t), "o_totalprice", "o_orderkey", included=["o_custkey", "comment"],
        derived=["ratio"], has_test=False,
    )


_MODELS = """models AS (SELECT s_nationkey AS run_id, s_name AS technique, CASE WHEN s_acctbal >= 0 THEN s_acctbal / 9000 END AS cv_score,
      s_acctbal > 8000 AS is_chosen FROM supplier)"""


@query(
    "model_validator",
    f"""WITH {_MODELS} SELECT run_id, technique, CASE WHEN cv_score IS NULL THEN 'no_score' ELSE 'above_ceiling' END AS rule FROM models WHERE cv_score IS NULL OR cv_score >= 0.999
    UNION ALL SELECT run_id, NULL, 'none_chosen' FROM models GROUP BY run_id HAVING NOT bool_or(is_chosen)""",
)
def model_validator(t):
    models = t.supplier.select(
        F.col("s_nationkey").alias("run_id"), F.col("s_name").alias("technique"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 9000).alias("cv_score"), (F.col("s_acctbal") > 8000).alias("is_chosen"),
    )
    return contracts.model_violations(models, ["run_id"], "accuracy")


_SOURCES = f"""{FILES}, sources AS (SELECT case_id, CASE WHEN path LIKE 'train%' THEN 'train' ELSE 'other' END AS role,
      CASE WHEN path LIKE '%.md' THEN 'data/shared/' || path ELSE 'data/' || case_id || '/' || path END AS path, position FROM files),
    cases AS (SELECT DISTINCT source AS case_id, CASE WHEN source < 'src2' THEN 'label' ELSE 'text' END AS target FROM documents)"""


@query(
    "source_preflight",
    f"""WITH {_SOURCES},
    found AS (SELECT case_id, 'not_readable' AS rule, path AS detail FROM sources WHERE path LIKE '%.png'
      UNION ALL SELECT case_id, 'folder_mismatch', path FROM sources WHERE path LIKE 'data/shared/%'),
    bad AS (SELECT DISTINCT case_id FROM found)
    SELECT * FROM found
    UNION ALL SELECT case_id, 'train_absent', NULL FROM cases WHERE case_id NOT IN (SELECT case_id FROM sources WHERE role = 'train')
    UNION ALL SELECT c.case_id, 'target_not_in_header', c.target FROM cases c JOIN sources s ON s.case_id = c.case_id AND s.role = 'train'
      WHERE c.target = 'label' AND c.case_id NOT IN (SELECT case_id FROM bad)""",
)
def source_preflight(t):
    folder = F.when(F.col("path").endswith(".md"), F.lit("data/shared/")).otherwise(F.concat(F.lit("data/"), "case_id", F.lit("/")))
    sources = files(t).select(
        "case_id", F.when(F.col("path").startswith("train"), "train").otherwise("other").alias("role"),
        F.concat(folder, "path").alias("path"), (~F.col("path").endswith(".png")).alias("is_readable"),
    )
    cases = t.documents.select(F.col("source").alias("case_id")).distinct().withColumn(
        "target", F.when(F.col("case_id") < "src2", "label").otherwise("text")
    )
    headers = sources.where("role = 'train'").select("path", F.array(F.lit("doc_id"), F.lit("text")).alias("columns"))
    return contracts.source_violations(cases, sources, headers)


STATES = """states AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS chosen_model,
      CASE WHEN o_totalprice > 100000 THEN 'out.csv' END AS submission_path, CASE WHEN o_totalprice < 450000 THEN o_totalprice >= 200000 END AS meets,
      o_orderstatus <> 'O' AS halted, CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 5 END AS phase,
      CASE o_orderstatus WHEN 'F' THEN '6.4' WHEN 'P' THEN '5.2' ELSE '5.1' END AS substep, o_custkey, o_totalprice FROM orders)"""


def states(t):
    """Orders as final run states."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.when(status != "P", F.col("o_orderpriority")).alias("chosen_model"),
        F.when(price > 100000, "out.csv").alias("submission_path"), F.when(price < 450000, price >= 200000).alias("meets"),
        (status != "O").alias("halted"), F.when(status == "F", 6).otherwise(5).alias("phase"),
        F.when(status == "F", "6.4").when(status == "P", "5.2").otherwise("5.1").alias("substep"), "o_custkey", "o_totalprice",
    )


_DEFICITS = """concat_ws(',', CASE WHEN chosen_model IS NULL THEN 'no_model' END, CASE WHEN submission_path IS NULL THEN 'no_submission' END,
      CASE WHEN NOT coalesce(meets, false) THEN 'criteria_not_met' END)"""


@query(
    "outcome_flags",
    f"""WITH {STATES} SELECT run_id, {_DEFICITS} AS deficits, {_DEFICITS} = '' AS ml_success, halted AND phase = 6 AND substep = '6.4' AS workflow_complete FROM states""",
)
def outcome_flags(t):
    return contracts.outcome_flags(states(t)).withColumn("deficits", F.array_join("deficits", ","))


@query(
    "phase_readiness",
    f"""WITH {STATES} SELECT run_id, chosen_model IS NOT NULL AS phase_4_ready, meets IS NOT NULL AS phase_5_ready, submission_path IS NOT NULL AND chosen_model IS NOT NULL AS phase_6_ready FROM states""",
)
def phase_readiness(t):
    needs = {"phase_4_ready": ["chosen_model"], "phase_5_ready": ["meets"], "phase_6_ready": ["submission_path", "chosen_model"]}
    return contracts.phase_readiness(states(t), needs)


@query(
    "loop_recommendation",
    f"""WITH {STATES}, s AS (SELECT *, o_custkey % 3 AS n_findings, o_custkey % 2 AS n_degraded, o_custkey % 4 AS loops_a, o_custkey % 5 AS loops_c FROM states)
    SELECT run_id, substep, CASE WHEN substep = '5.1' THEN CASE WHEN n_findings > 0 THEN 'B:findings' WHEN n_degraded > 0 THEN 'B:degraded' END
      WHEN substep = '5.2' AND meets = false THEN CASE WHEN loops_a >= 2 THEN 'halt' WHEN loops_c = 0 THEN 'C:criteria_not_met' END END AS advice FROM s""",
)
def loop_recommendation(t):
    key = F.col("o_custkey")
    counted = states(t).withColumns({"n_findings": key % 3, "n_degraded": key % 2, "loops_a": key % 4, "loops_c": key % 5})
    return contracts.loop_recommendation(counted)


@query(
    "assessment_normalize",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rmse' ELSE 'accuracy' END AS metric, CASE WHEN o_orderstatus = 'P' THEN 'minimize' ELSE 'maximize' END AS direction,
      CAST(CASE WHEN o_orderstatus = 'F' THEN 150000 ELSE 200000 END AS DOUBLE) AS threshold, CASE WHEN o_orderstatus = 'O' THEN 7.0 ELSE o_totalprice END AS score,
      CASE o_orderstatus WHEN 'P' THEN o_totalprice <= 200000 WHEN 'F' THEN o_totalprice >= 150000 ELSE false END AS meets FROM orders""",
)
def assessment_normalize(t):
    """Three spellings of an assessment: nested score, aliased keys, no score at all."""
    price = F.col("o_totalprice")
    nested = F.to_json(F.struct(F.struct(price.alias("cv_mean")).alias("cv_score"), F.lit("rmse").alias("metric")))
    aliased = F.to_json(F.struct(price.cast("string").alias("achieved_score"), F.lit(150000).alias("success_threshold")))
    text = F.when(F.col("o_orderstatus") == "P", nested).when(F.col("o_orderstatus") == "F", aliased).otherwise(F.lit('{"meets": true}'))
    out = records.assessment(text, F.lit("accuracy"), F.lit(200000.0), F.lit(None).cast("string"), F.lit(7.0))
    return t.orders.select("o_orderkey", out.alias("a")).select("o_orderkey", "a.*")


@query(
    "bundle_flatten",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS accuracy, l_discount AS precision_good, l_tax AS recall_0, l_quantity + 1 AS cv_mean, NULL::DOUBLE AS note FROM b""",
)
def bundle_flatten(t):
    nested = F.struct(F.struct(F.col("l_discount").alias("precision")).alias("1"), F.struct(F.col("l_tax").alias("recall")).alias("0"))
    text = F.to_json(
        F.struct(
            F.col("l_quantity").alias("accuracy"), nested.alias("per_class"),
            (F.col("l_quantity") + 1).alias("cv_f1_mean"), F.lit("n/a").alias("note"),
        )
    )
    flat = records.flat_metrics(F.col("json"), F.create_map(F.lit("1"), F.lit("good")))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = t.lineitem.select(*keys, text.alias("json"))
    split = lines.select(*keys, flat.alias("m"), records.cv_metrics(F.col("json")).alias("cv"))
    picked = {c: F.try_element_at("m", F.lit(c)).alias(c) for c in ("accuracy", "precision_good", "recall_0", "note")}
    return split.select(*keys, *picked.values(), F.try_element_at("cv", F.lit("mean")).alias("cv_mean"))


@query(
    "metric_defaults",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rmse' ELSE 'accuracy' END AS metric, CASE WHEN o_orderstatus = 'P' THEN 'minimize' ELSE 'maximize' END AS direction FROM orders""",
)
def metric_defaults(t):
    kind = F.when(F.col("o_orderstatus") == "P", "Linear Regression").when(F.col("o_orderstatus") == "F", "binary-classification")
    metric = metricrules.default_metric(kind)
    return t.orders.select("o_orderkey", metric.alias("metric"), metricrules.default_direction(metric).alias("direction"))


@query(
    "technique_alias",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'random_forest' WHEN 'PROMO' THEN 'lightgbm' WHEN 'STANDARD' THEN 'hist_gradient_boosting' ELSE lower(p_type) || '_net' END AS technique FROM part""",
)
def technique_alias(t):
    name = F.when(F.col("p_type") == "ECONOMY", " RF ").when(F.col("p_type") == "PROMO", "LGBM").when(F.col("p_type") == "STANDARD", "hist-gb")
    return t.part.select("p_partkey", metricrules.technique(name.otherwise(F.concat("p_type", F.lit("-net")))).alias("technique"))


@query(
    "case_status",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'draft' WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN 'unsupported' ELSE 'ready' END AS status,
      CASE WHEN o_orderstatus = 'P' THEN 'halted' WHEN o_totalprice > 300000 THEN 'complete' ELSE 'running' END AS run_status FROM orders""",
)
def case_status(t):
    kind = F.when(F.col("o_orderstatus") == "P", "Time Series").when(F.col("o_orderstatus") == "F", "Binary-Classification").otherwise(" ")
    status = metricrules.case_status(kind, F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") >= 100000)
    ended = F.when(F.col("o_totalprice") > 300000, F.col("o_orderdate"))
    return t.orders.select(
        "o_orderkey", status.alias("status"), metricrules.run_status(F.col("o_orderstatus") == "P", ended).alias("run_status")
    )


@query(
    "numeric_scalars",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(1 + greatest(l_quantity - 10, 0)), 8) AS log_quantity, round(exp(l_discount) - 1, 8) AS expm1_discount,
      CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS parsed, CASE WHEN l_discount = 0 THEN NULL ELSE round_even(100.0 * l_tax / l_discount, 1) END AS pct FROM lineitem""",
)
def numeric_scalars(t):
    text = F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_tax").cast("string"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(numbers.log1p_clipped(F.col("l_quantity") - 10), 8).alias("log_quantity"),
        F.round(F.expm1("l_discount"), 8).alias("expm1_discount"),
        numbers.to_number(text).alias("parsed"),
        numbers.percent(F.col("l_tax"), F.col("l_discount")).alias("pct"),
    )


@query(
    "regression_bundle",
    """WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS pred, l_linenumber % 5 AS fold FROM lineitem),
    f AS (SELECT fold, sqrt(avg((y - pred) ** 2)) AS e, sqrt(avg((ln(1 + y) - ln(1 + pred)) ** 2)) AS le FROM r GROUP BY 1),
    w AS (SELECT sqrt(avg((ln(1 + y) - ln(1 + pred)) ** 2)) AS le, avg(abs(y - pred)) AS mae FROM r)
    SELECT 'raw' AS kind, round(avg(e), 4) AS rmse, round(avg(e), 4) AS cv_mean, round(stddev_pop(e), 4) AS cv_std, round(any_value(mae), 4) AS mae, count(*)::INTEGER AS n_folds FROM f, w
    UNION ALL SELECT 'log', round(any_value(w.le), 6), round(avg(f.le), 6), round(stddev_pop(f.le), 6), round(any_value(mae), 4), count(*)::INTEGER FROM f, w""",
)
def regression_bundle(t):
    """The bundle of number predictions, with the target as it is and in logs."""
    oof = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred"), (F.col("l_linenumber") % 5).alias("fold"))

    def row(kind, log, digits):
        m, cv = F.col("metrics"), F.col("cv")
        return metrics.regression_bundle(oof, log).select(
            F.lit(kind).alias("kind"), F.round(m["rmse"], digits).alias("rmse"), F.round(cv["mean"], digits).alias("cv_mean"), F.round(cv["std"], digits).alias("cv_std"),
            F.round(m["mae"], 4).alias("mae"), cv["n_folds"].cast("int").alias("n_folds"),
        )

    return row("raw", False, 4).unionByName(row("log", True, 6))
