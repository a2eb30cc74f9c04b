"""Baseline models on pyspark.ml: features, cross-validation, comparison, scoring."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.metricrules import TECHNIQUE_ALIASES
from millrace.operators import linear
from millrace.operators import metrics as M
from millrace.operators.categories import SparseFeatures, fit_dictionary
from millrace.operators.contracts import attach_predictions
from millrace.operators.folds import FOLDS, SEED, plain_folds, stratified_folds
from millrace.operators.prep import align_schema
from millrace.operators.profile import numeric_columns
from millrace.operators.roles import Hints
from millrace.plans.quantiles import exact_quantiles
from millrace.session import cut_lineage, shared_folder

# Fixed values of the baselines.
MAX_TERMS = 50_000
MIN_DOCUMENTS = 2
TOKEN = r"(?U)\b\w\w+\b"
MISSING_CATEGORY = "missing"
TREES = 100
STEP = 0.1
LOGISTIC_STEPS = 60
MAX_TECHNIQUES = 3

MAX_CLASSES = 10_000
PARALLEL_FITS = 4
#: A step of a fit costs each task some ten milliseconds, so counted texts go to a task by so many rows at least.
ROWS_A_TASK = 10_000


@dataclass(frozen=True)
class Task:
    """What is to be learned."""

    target: str
    id_column: str
    problem_type: str = "classification"
    metric: str = "accuracy"
    hints: Hints = field(default_factory=Hints)

    @property
    def is_regression(self) -> bool:
        return self.problem_type == "regression"

    @property
    def log_target(self) -> bool:
        return self.is_regression and "log" in self.metric.lower()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fit_scaling(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """Median fill and population z-score per number, as one SQL projection with fitted constants."""
    medians = exact_quantiles(train, columns, [0.5])
    fill = {c: (medians[c][0] if medians[c][0] is not None else 0.0) for c in columns}
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(fill[c]))) for c in columns}
    row = train.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled.values())],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled.values())],
    ).first()
    parts = []
    for i, c in enumerate(columns):
        mean, spread = float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0
        value = f"coalesce(nanvl(cast({_quoted(c)} as double), null), {fill[c]!r}D)"
        parts.append(f"({value} - {mean!r}D) / {spread!r}D AS {_quoted(c + '__z')}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_tabular_features(train: DataFrame, columns: list[str], out: str = "features") -> PipelineModel:
    """Scaled numbers and one-hot categories; an unknown category becomes all zeros.

    Categories live in a dictionary table that is joined to the rows, so a column may have any number of them.
    """
    numeric = numeric_columns(train.select(*columns))
    categorical = [c for c in columns if c not in numeric]
    if not columns:
        raise ValueError("no feature columns")
    stages, current = [], train
    if numeric:
        stages.append(fit_scaling(train, numeric))
    if not categorical:
        stages.append(VectorAssembler(inputCols=[f"{c}__z" for c in numeric], outputCol=out))
        return PipelineModel(stages)
    texts = ", ".join(f"coalesce(cast({_quoted(c)} as string), '{MISSING_CATEGORY}') AS {_quoted(c + '__t')}" for c in categorical)
    stages.append(SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__"))
    current = stages[-1].transform(current)
    names = [f"{c}__t" for c in categorical]
    path, sizes = fit_dictionary(current, names)
    stages.append(SparseFeatures(path, [f"{c}__z" for c in numeric], names, sizes, out))
    return PipelineModel(stages)


def _term_stages(text: str) -> list:
    """Words and word pairs of a text, as ``__terms``."""
    return [
        SQLTransformer(statement=f"SELECT *, coalesce(cast({_quoted(text)} as string), '') AS __text FROM __THIS__"),
        RegexTokenizer(inputCol="__text", outputCol="__words", pattern=TOKEN, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="__words", outputCol="__pairs"),
        SQLTransformer(statement="SELECT *, concat(__words, __pairs) AS __terms FROM __THIS__"),
    ]


def _weighting_stages(train: DataFrame, weights: list[float], numeric: list[str], out: str) -> list:
    """From ``__counts`` to features of unit length, and scaled numbers."""
    stages = [
        ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="__counts", outputCol="__weighted"),
        Normalizer(p=2.0, inputCol="__weighted", outputCol="__tfidf"),
    ]
    inputs = ["__tfidf"]
    if numeric:
        stages.insert(0, fit_scaling(train, list(numeric)))
        inputs += [f"{c}__z" for c in numeric]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=out)]


def fit_text_features(train: DataFrame, text: str, numeric: list[str] = (), out: str = "features", terms: int = MAX_TERMS) -> PipelineModel:
    """TF-IDF over words and word pairs (smoothed, plus one, unit length) and scaled numbers."""
    stages = _term_stages(text)
    current = train
    for stage in stages:
        current = stage.transform(current)
    counter = CountVectorizer(inputCol="__terms", outputCol="__counts", vocabSize=terms, minDF=MIN_DOCUMENTS).fit(current)
    rarity = IDF(inputCol="__counts", outputCol="__idf").fit(counter.transform(current))
    return PipelineModel([*stages, counter, *_weighting_stages(train, [w + 1.0 for w in rarity.idf.toArray()], list(numeric), out)])


def count_text_folds(assigned: DataFrame, text: str, k: int, terms: int = MAX_TERMS) -> tuple[DataFrame, list[list[float]]]:
    """The rows with ``__counts`` in place of the text, and for each fold the weight of every term if that fold is held out.

    Texts are cut into terms for two passes, whatever the number of folds: one counts terms and their documents per fold, so that what
    ``fit_text_features`` would find without a fold's rows is a subtraction, the other counts the terms that are in any
    of these vocabularies. A term outside the vocabulary of a fold weighs 0 there.
    """
    current = assigned
    for stage in _term_stages(text):
        current = stage.transform(current)
    used = F.transform("__terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    held = F.transform(F.array_distinct("__terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    rows = current.select("fold", F.explode(F.concat(used, held)).alias("t")).groupBy("t.term", "fold").agg(F.sum("t.tf").alias("tf"), F.sum("t.df").alias("df"))
    of = lambda name, i: F.sum(F.when(F.col("fold") != i, F.col(name)).otherwise(0)).alias(f"{name}{i}")
    rows = rows.groupBy("term").agg(*[of(name, i) for name in ("tf", "df") for i in range(k)], F.sum("df").alias("df"))
    rows = cut_lineage(rows.where(F.col("df") >= MIN_DOCUMENTS).drop("df"))
    sizes = {r["fold"]: r["n"] for r in assigned.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = []
    for i in range(k):
        known = rows.where(F.col(f"df{i}") >= MIN_DOCUMENTS).orderBy(F.col(f"tf{i}").desc(), "term").limit(terms).select("term", f"df{i}").collect()  # a vocabulary
        if not known:
            raise ValueError(f"no term has {MIN_DOCUMENTS} documents outside of fold {i}")
        n = sum(sizes.values()) - sizes.get(i, 0)
        found.append({r[0]: math.log((n + 1) / (r[1] + 1)) + 1.0 for r in known})
    vocabulary = sorted(set().union(*found))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__terms", outputCol="__counts")
    counted = counter.transform(current).select(*[c for c in assigned.columns if c != text], "__counts")
    tasks = -(-sum(sizes.values()) // ROWS_A_TASK)  # coalesce() makes no more than there are
    return cut_lineage(counted).coalesce(max(1, tasks)), [[weights.get(t, 0.0) for t in vocabulary] for weights in found]


def tfidf_terms(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key, term, n_documents, weight``: smoothed TF-IDF at unit length per row, for words and word pairs of at least
    ``MIN_DOCUMENTS`` rows. Terms are rows, so no vocabulary is held anywhere."""
    words = rows.select(*key, F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, size(w))"), lambda a, b: F.concat_ws(" ", a, b))
    terms = words.select(*key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= MIN_DOCUMENTS)
    n = rows.agg(F.count("*")).first()[0]
    df = df.select("term", "n_documents", (F.log((1 + F.lit(n)) / (1 + F.col("n_documents"))) + 1).alias("idf"))
    weighted = terms.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))
    return weighted.select(*key, "term", "n_documents", (F.col("w") / length).alias("weight"))


def normalise_technique(name: str, task: Task) -> str:
    """Known technique name; anything unknown becomes the default of the problem type."""
    plain = name.lower().strip().replace("-", "_").replace(" ", "_")
    plain = TECHNIQUE_ALIASES.get(plain, plain)
    if plain.startswith("tfidf"):
        return "tfidf_logreg"
    if plain in ("gradient_boosting", "lightgbm", "hgb"):
        return "hist_gradient_boosting"
    if task.is_regression:
        return plain if plain in ("random_forest", "hist_gradient_boosting", "lasso", "elastic_net") else "ridge"
    return plain if plain in ("random_forest", "hist_gradient_boosting", "svm") else "logistic_regression"


def technique_ladder(task: Task, preferred: str | None = None) -> list[str]:
    """Up to three techniques to try, the preferred one first."""
    if task.hints.representation_options:
        names = list(task.hints.representation_options)
    elif task.hints.text_led:
        names = ["tfidf_logreg"]
    elif task.is_regression:
        names = ["ridge", "hist_gradient_boosting"]
    else:
        names = ["logistic_regression", "random_forest", "hist_gradient_boosting"]
    ordered = ([preferred] if preferred else []) + names
    return list(dict.fromkeys(normalise_technique(n, task) for n in ordered))[:MAX_TECHNIQUES]


def estimator(technique: str, task: Task, n_rows: int, n_classes: int, weighted: bool = False):
    """The pyspark.ml estimator of a technique.

    Penalties are those of a sum of losses, hence divided by the number of rows; features are
    scaled beforehand, so the estimators do not standardise again.
    """
    label, penalty = "__label", 1.0 / max(n_rows, 1)
    if task.is_regression:
        linear = dict(labelCol=label, standardization=False)
        return {
            "ridge": lambda: LinearRegression(regParam=penalty, elasticNetParam=0.0, **linear),
            "lasso": lambda: LinearRegression(regParam=1.0, elasticNetParam=1.0, **linear),
            "elastic_net": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.5, **linear),
            "random_forest": lambda: RandomForestRegressor(labelCol=label, numTrees=TREES, maxDepth=10, seed=SEED),
            "hist_gradient_boosting": lambda: GBTRegressor(labelCol=label, maxIter=TREES, stepSize=STEP, seed=SEED),
        }[technique]()
    logistic = LogisticRegression(labelCol=label, regParam=penalty, standardization=False, maxIter=LOGISTIC_STEPS, tol=1e-4)
    if weighted:
        logistic = logistic.setWeightCol("__weight")
    if technique in ("logistic_regression", "tfidf_logreg"):
        return logistic
    if technique == "random_forest":
        return RandomForestClassifier(labelCol=label, numTrees=TREES, maxDepth=10, seed=SEED)
    single = {
        "hist_gradient_boosting": lambda: GBTClassifier(labelCol=label, maxIter=TREES, stepSize=STEP, seed=SEED),
        "svm": lambda: LinearSVC(labelCol=label, regParam=penalty, standardization=False),
    }[technique]()
    return single if n_classes <= 2 else OneVsRest(classifier=single, labelCol=label)


def labelled(train: DataFrame, task: Task) -> tuple[DataFrame, list[str]]:
    """Add the numeric ``__label``; for classes also return their names in label order."""
    if task.is_regression:
        y = F.col(task.target).cast("double")
        return train.withColumn("__label", F.log1p(F.greatest(y, F.lit(0.0))) if task.log_target else y), []
    names = [r[0] for r in train.select(F.col(task.target).cast("string")).distinct().limit(MAX_CLASSES).collect()]
    if len(names) >= MAX_CLASSES:
        raise ValueError("the target has too many classes for a classifier")
    names = [n for n in names if n is not None]
    try:
        names.sort(key=float)
        if any(not float(n).is_integer() for n in names):
            names.sort()
    except ValueError:
        names.sort()
    model = StringIndexerModel.from_labels(names, inputCol="__y", outputCol="__label", handleInvalid="skip")
    return model.transform(train.withColumn("__y", F.col(task.target).cast("string"))).drop("__y"), names


def feature_columns(train: DataFrame, task: Task) -> list[str]:
    skip = {task.target, task.id_column, "fold", "__label", "__weight"}
    kinds = (T.NumericType, T.StringType, T.BooleanType)
    return [f.name for f in train.schema if f.name not in skip and isinstance(f.dataType, kinds)]


def text_column(train: DataFrame, task: Task) -> str | None:
    listed = [c for c in task.hints.text_free if c in train.columns]
    return listed[0] if listed else ("text" if "text" in train.columns else None)


def fit(train: DataFrame, task: Task, technique: str, n_classes: int, weights: list[float] | None = None) -> PipelineModel:
    """Features and estimator fitted on one training table that has ``__label``; with ``weights``, texts are counted already."""
    columns = feature_columns(train, task)
    n_rows = train.count()
    if technique == "tfidf_logreg":
        numeric = numeric_columns(train.select(*columns))
        features = fit_text_features(train, text_column(train, task), numeric) if weights is None else PipelineModel(_weighting_stages(train, weights, numeric, "features"))
        counts = train.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
        shares = F.create_map(*[F.lit(v) for r in counts for v in (r["__label"], n_rows / (len(counts) * r["n"]))])
        train = train.withColumn("__weight", F.element_at(shares, F.col("__label")))
        model = estimator(technique, task, n_rows, n_classes, weighted=True)
    else:
        features = fit_tabular_features(train, columns)
        model = estimator(technique, task, n_rows, n_classes)
    return PipelineModel([features, model.fit(features.transform(train))])


@dataclass(frozen=True)
class Experiment:
    """Cross-validated result of one technique; ``oof`` holds ``(id, fold, y, pred)``."""

    technique: str
    cv_score: float | None
    cv_std: float | None
    oof: DataFrame | None
    fold_metrics: DataFrame | None
    error: str | None = None
    n_features: int | None = None
    #: Rows without a target: they are neither fitted nor scored.
    n_unlabelled: int = 0


def _predictions(scored: DataFrame, task: Task) -> DataFrame:
    pred, y = F.col("prediction"), F.col("__label")
    if task.log_target:
        pred, y = F.expm1(pred), F.expm1(y)
    columns = [F.col(task.id_column), F.col("fold"), y.alias("y"), pred.alias("pred")]
    if not task.is_regression:
        second = lambda name: F.get(vector_to_array(name), 1) if name in scored.columns else F.lit(None).cast("double")
        chance = second("probability")
        columns += [F.coalesce(chance, second("rawPrediction")).alias("score"), chance.alias("probability")]
    return scored.select(*columns)


def run_experiment(train: DataFrame, task: Task, technique: str, k: int = FOLDS) -> Experiment:
    """k-fold cross-validation; folds are fitted side by side from a few driver threads.

    The fold table and the out-of-fold predictions are materialised, so a fold is neither
    re-assigned nor re-fitted when they are read again.
    """
    name = normalise_technique(technique, task)
    score = M.score_column(task.metric, task.is_regression)
    n_unlabelled = train.where(F.col(task.target).isNull()).count()
    ready, classes = labelled(train, task)
    if score in ("roc_auc", "precision", "recall", "log_loss") and len(classes) != 2:
        raise ValueError(f"{score} needs two classes, the target has {len(classes)}")
    assigned = plain_folds(ready, [task.id_column], k) if task.is_regression else stratified_folds(ready, "__label", [task.id_column], k)
    weights = [None] * k
    if name == "tfidf_logreg":
        # All tasks take part, however few files or blocks the texts came in.
        spark = train.sparkSession
        spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        assigned, weights = count_text_folds(cut_lineage(assigned.repartition(spread)), text_column(ready, task), k)
    else:
        assigned = cut_lineage(assigned)

    def one_fold(i: int) -> DataFrame:
        model = fit(assigned.where(F.col("fold") != i), task, name, len(classes), weights[i])
        return _predictions(model.transform(assigned.where(F.col("fold") == i)), task)

    columns = feature_columns(ready, task)
    if name == "ridge" and columns and len(columns) <= linear.MOST_COLUMNS and columns == numeric_columns(ready.select(*columns)):
        # Numbers only: all folds follow from one scan.
        fitted = linear.fold_models(assigned, columns, "__label", "fold", k)
        oof = cut_lineage(_predictions(linear.out_of_fold(assigned, fitted, "fold"), task))
    else:
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            parts = list(pool.map(one_fold, range(k)))
        oof = parts[0]
        for part in parts[1:]:
            oof = oof.unionByName(part)
        oof = cut_lineage(oof)
    if task.is_regression:
        per_fold = M.regression_metrics(oof, "y", "pred", ["fold"])
    else:
        per_fold = M.overall_metrics(M.confusion_counts(oof, "y", "pred", ["fold"]), ["fold"])
        if len(classes) == 2:
            binary = M.binary_scores(oof, ["fold"])
            per_fold = per_fold.join(binary.select("fold", *[c for c in binary.columns if c not in per_fold.columns]), "fold")
    summary = M.fold_summary(per_fold, score).first()
    return Experiment(name, summary["mean"], summary["std"], oof, per_fold, None, len(feature_columns(ready, task)), n_unlabelled)


def compare_experiments(train: DataFrame, task: Task, techniques: list[str] | None = None) -> list[Experiment]:
    """One experiment per technique; a technique that fails is recorded and the next one tried."""
    results = []
    for technique in techniques or technique_ladder(task):
        try:
            results.append(run_experiment(train, task, technique))
        except Exception as error:  # a failed baseline must not stop the ladder
            results.append(Experiment(technique, None, None, None, None, f"{type(error).__name__}: {error}"[:500]))
    return results


def select_best(results: list[Experiment], task: Task) -> Experiment:
    """Best finite score in the direction of the metric; the earlier technique wins a tie."""
    usable = [r for r in results if r.cv_score is not None and math.isfinite(r.cv_score)]
    if not usable:
        raise ValueError("no technique produced a finite score")
    lower = any(mark in task.metric.lower() for mark in ("rmse", "mae", "mse", "loss", "error"))
    return min(usable, key=lambda r: r.cv_score if lower else -r.cv_score)


def save_model(model: PipelineModel, classes: list[str], train_schema: T.StructType, path: str) -> None:
    """Write a fitted model with its class names and the layout it was trained on."""
    model.write().overwrite().save(f"{path}/model")
    facts = [(json.dumps(classes), train_schema.json())]
    SparkSession.active().createDataFrame(facts, "classes string, layout string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], T.StructType]:
    """What ``save_model`` wrote, in the order that ``predict`` takes it."""
    facts = spark.read.parquet(f"{path}/facts").first()
    return PipelineModel.load(f"{path}/model"), json.loads(facts["classes"]), T.StructType.fromJson(json.loads(facts["layout"]))


def fit_final(train: DataFrame, task: Task, technique: str) -> tuple[PipelineModel, list[str]]:
    """Refit on the whole training table; returns the model and the class names."""
    ready, classes = labelled(train, task)
    return fit(ready, task, normalise_technique(technique, task), len(classes)), classes


def predict(model: PipelineModel, classes: list[str], train_schema: T.StructType, test: DataFrame, task: Task) -> DataFrame:
    """``(id, target)`` for a test table of any column order; labels and logs are turned back."""
    wanted = T.StructType([f for f in train_schema if f.name not in (task.target, task.id_column)])
    aligned = align_schema(test, T.StructType([test.schema[task.id_column], *wanted]))
    scored = model.transform(aligned)
    if task.is_regression:
        value = F.expm1("prediction") if task.log_target else F.col("prediction")
    else:
        names = F.array(*[F.lit(c) for c in classes])
        value = F.element_at(names, F.col("prediction").cast("int") + 1).cast(train_schema[task.target].dataType)
    return scored.select(task.id_column, value.alias(task.target))


def submit_saved(spark: SparkSession, path: str, test: DataFrame, sample: DataFrame | None, task: Task) -> DataFrame:
    """Predictions of a saved model, laid out as the sample file, or as (id, target)."""
    predictions = predict(*load_model(spark, path), test, task)
    return predictions if sample is None else attach_predictions(sample, predictions, task.id_column, task.target)


def bundle(experiment: Experiment, task: Task) -> DataFrame:
    """Evaluation bundle of an experiment's out-of-fold predictions: metrics, confusion, cv."""
    if task.is_regression:
        return M.regression_bundle(experiment.oof, task.log_target)
    score = M.score_column(task.metric, False)
    in_counts = score if score in ("accuracy", "balanced_accuracy", "f1") else "f1"
    return M.evaluation_bundle(M.confusion_counts(experiment.oof, "y", "pred", ["fold"]), in_counts)


def submission_score(submission: DataFrame, truth: DataFrame, task: Task) -> float | None:
    """The task's metric of (id, target) predictions against known targets; f1 where a metric needs probabilities."""
    known = truth.select(F.col(task.id_column), F.col(task.target).alias("__truth")).where("__truth IS NOT NULL")
    rows = known.join(submission, task.id_column)
    score = M.score_column(task.metric, task.is_regression)
    if task.is_regression:
        return M.regression_metrics(rows, "__truth", task.target).first()[score]
    counts = M.confusion_counts(rows, "__truth", task.target, [])
    found = M.overall_metrics(counts)
    return found.first()[score if score in found.columns else "f1"]


def score_and_submit(train: DataFrame, test: DataFrame, sample: DataFrame | None, task: Task, technique: str, path: str | None = None) -> DataFrame:
    """Refit, save, and let the saved model predict."""
    path = path or shared_folder(train.sparkSession, "model")
    model, classes = fit_final(train, task, technique)
    save_model(model, classes, train.schema, path)
    return submit_saved(train.sparkSession, path, test, sample, task)
