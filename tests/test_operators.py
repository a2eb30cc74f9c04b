"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import metricrules, numbers, text
from millrace.operators import contracts, corpus, extract, folds, metrics, models, prep, profile, quality, roles, runlog, usercode


def column(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_golden_confusion_matrix(spark):
    cells = [(0, 0, 3879), (0, 1, 463), (1, 0, 1060), (1, 1, 2211)]
    counts = spark.createDataFrame(cells, "y int, pred int, n long")
    row = metrics.overall_metrics(counts).first()
    assert row["accuracy"] == pytest.approx(0.79995, abs=1e-5)
    assert row["balanced_accuracy"] == pytest.approx(0.78465, abs=1e-5)
    assert row["f1"] == pytest.approx(0.744, abs=1e-3)
    assert [tuple(r) for r in metrics.confusion_matrix(counts).orderBy("y").collect()] == [(0, 3879, 463), (1, 1060, 2211)]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "a"), (-0.0, "b"), (0.0, "b")], "x double, s string")
    rows = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (rows["x"]["n_missing"], rows["x"]["n_distinct"]) == (2, 2)
    assert (rows["s"]["n_missing"], rows["s"]["n_distinct"]) == (1, 2)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5, 2), (2.0, 5, 4), (3.0, 5, 7)], "y double, c int, x int")
    assert [r["column"] for r in profile.target_correlations(df, "y").collect()] == ["x"]


PROFILE = "column string, dtype string, n_rows long, n_missing long, n_distinct long, is_constant boolean"


def test_roles_of_social_posts(spark):
    rows = [("UserName", "int", 40, 0, 40), ("ScreenName", "int", 40, 0, 40), ("Location", "string", 40, 8, 22),
            ("TweetAt", "string", 40, 0, 12), ("OriginalTweet", "string", 40, 0, 40), ("Sentiment", "string", 40, 0, 5)]
    table = spark.createDataFrame([(*r, False) for r in rows], PROFILE)
    found = {r["role"]: r["column"] for r in roles.infer_roles(table).collect()}
    assert found == {"target": "Sentiment", "id": "UserName"}
    hints = roles.hints_from_rows(roles.infer_hints(table, list(found.values())).collect())
    assert hints.text_free[0] == "OriginalTweet" and hints.text_led


def test_quality_gate_documented_missing(spark):
    rows = [("sparse_cat", "string", 100, 70, 3, False), ("mild_num", "float", 100, 10, 40, False), ("label", "int", 100, 0, 2, False)]
    table = spark.createDataFrame(rows, PROFILE)
    plain = {r["column"]: (r["rule"], r["severity"]) for r in quality.quality_gate(table, "label").collect()}
    assert plain == {"sparse_cat": ("undocumented_missing", "blocker"), "mild_num": ("some_missing", "tolerable")}
    known = quality.quality_gate(table, "label", high_missing=["sparse_cat"]).where("column = 'sparse_cat'").first()
    assert known["severity"] == "tolerable"


def test_file_roles(spark):
    names = ["Corona_NLP_train.csv", "x_test.csv", "holdout.csv", "sample_submission.csv", "contest.csv", "widgets.csv"]
    found = column(spark, roles.file_role(F.col("n")), [(n,) for n in names], "n string")
    assert found == ["train", "test", "test", "sample_submission", None, None]


def test_imputation_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(1, 1.0, "b"), (2, 2.0, "a"), (3, 4.0, None), (4, 9.0, "b"), (5, None, "a")], "y int, x double, s string")
    test = spark.createDataFrame([(None, None), (100.0, "z")], "x double, s string")
    filled, other, values = prep.clean(train, test, "y")
    assert values.numbers == {"x": 3.0} and values.texts == {"s": "a"}
    assert [tuple(r) for r in other.collect()] == [(3.0, "a"), (100.0, "z")]
    assert filled.where("x is null or s is null").isEmpty()


def test_modes_of_long_and_unrepeated_texts(spark):
    long_b, long_a = "b" * 200, "a" * 200
    rows = [(long_b, "z", None, "k"), (long_a, "y", None, "k"), (long_b, "x", None, "j"), (long_a, None, None, "j")]
    df = spark.createDataFrame(rows, "l string, u string, n string, s string")
    assert profile.column_modes(df, ["l", "u", "n", "s"]) == {"l": long_a, "u": "x", "s": "j"}


def test_stratified_holdout_shares(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 900, 0).otherwise(1))
    split = prep.stratified_holdout(df, "y", ["id"]).where("is_holdout").groupBy("y").count()
    assert {r["y"]: r["count"] for r in split.collect()} == {0: 180, 1: 20}


def test_format_tables_aligns_test(spark):
    train = spark.createDataFrame([(1, 0, "t", 2.0, 1)], "id long, y int, note string, a double, extra int")
    test = spark.createDataFrame([(9, 3.0, "u")], "id long, a double, note string")
    hints = roles.Hints(text_free=("note",), categorical=("c",))
    left, right = prep.format_tables(train, test, "y", "id", hints)
    assert left.columns == ["y", "a", "extra"] and right.columns == ["id", "a", "extra"]
    assert right.first()["extra"] is None


@pytest.mark.parametrize("metric,scores,best", [("rmse", [0.40, 0.12, 0.25], "b"), ("auc", [0.70, 0.85], "b"), ("rmse", [float("nan"), 0.5, 0.5], "b")])
def test_best_candidate_direction(spark, metric, scores, best):
    rows = [("g", "abc"[i], s, i) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "g string, name string, score double, pos int")
    assert metrics.best_candidate(df, ["g"], "score", "pos", metricrules.direction(F.lit(metric))).first()["name"] == best


def test_thresholds(spark):
    rows = [("rmse_log", 0.1355, 0.15), ("rmse_log", 0.16, 0.15), ("accuracy", 0.82, 0.77), ("accuracy", 0.70, 0.77)]
    way = metricrules.direction(F.col("m"))
    assert column(spark, metricrules.meets(F.col("s"), F.col("t"), way), rows, "m string, s double, t double") == [True, False, True, False]


def test_submission_contract(spark):
    sample = spark.createDataFrame([(i, 0.0) for i in range(4)], "Id long, SalePrice double")
    predictions = spark.createDataFrame([(3, 30.0), (1, 10.0), (0, 0.5), (2, 20.0)], "Id long, SalePrice double")
    good = contracts.attach_predictions(sample, predictions, "Id", "SalePrice")
    assert contracts.submission_violations(good, sample, "Id").isEmpty()
    assert good.where("Id = 3").first()["SalePrice"] == 30.0
    bad = spark.createDataFrame([(0, 1.0), (None, 1.0), (7, 1.0)], "Id long, SalePrice double")
    rules = {r["rule"]: r["detail"] for r in contracts.submission_violations(bad, sample, "Id").collect()}
    assert rules == {"row_count": "3", "null_ids": "1", "missing_ids": "3", "unknown_ids": "1"}


REPLIES = [
    ('{"a": 1}', '{"a":1}'),
    ('---\n```json\n{"a": 1}\n```\n', '{"a":1}'),
    ('```json\n{"a": [1, 2,],}\n```', '{"a":[1,2]}'),
    ('Here you go: {"a": {"b": "x } y"}} thanks {"c": 2}', '{"a":{"b":"x } y"}}'),
    ('<think>{"no": 1}</think>{"a": 1} // done', '{"a":1}'),
    ('{{"a": 1}}', '{"a":1}'),
    ("no object", None),
    ("{broken", None),
    ("[1, 2]", None),
    ("", None),
]


def test_extract_json(spark):
    df = spark.createDataFrame(list(enumerate(r for r, _ in REPLIES)), "id long, reply string")
    found = [r["object"] for r in extract.extract_json(df, "reply").orderBy("id").collect()]
    assert found == [e for _, e in REPLIES]


def test_brace_matcher_is_linear_in_unclosed_braces():
    assert extract.first_object("{" * 20_000 + '"') is None


def test_markdown_chunks(spark):
    body = "# Title\nintro\n\n## One\nfirst\n\nsecond\n## Two\n" + "x" * 1300 + "\n# Late\nend"
    files = spark.createDataFrame([("a.md", body), ("b.md", "## Only heading"), ("c.md", "plain\r\n\r\ntext")], "name string, body string")
    rows = [(r["source"], r["chunk_no"], r["section"], r["text"]) for r in corpus.chunk_documents(files, "name", "body").orderBy("source", "chunk_no").collect()]
    assert rows[:5] == [
        ("a.md", 0, None, "intro"),
        ("a.md", 1, "One", "first\n\nsecond"),
        ("a.md", 2, "Two", "x" * 1200),
        ("a.md", 3, "Two", "x" * 100),
        ("a.md", 4, "Late", "end"),
    ]
    assert rows[5:] == [("c.md", 0, None, "plain\n\ntext")]


def test_merge_stops_at_the_limit_and_at_sections(spark):
    body = "a" * 199 + "\n\n" + "b" * 199 + "\n\n" + "c" * 10 + "\n## S\n" + "d"
    files = spark.createDataFrame([("f", body)], "name string, body string")
    assert [len(r["text"]) for r in corpus.chunk_documents(files, "name", "body").orderBy("chunk_no").collect()] == [400, 10, 1]


def brute_force_keyword(chunks, query, k):
    import re

    terms = {w.lower() for w in re.findall(r"[a-zA-Z0-9_]{3,}", query)}
    scored = [(sum(w in c.lower() for w in terms), i) for i, c in enumerate(chunks)]
    hits = sorted([s for s in scored if s[0]], key=lambda s: (-s[0], s[1]))
    return [i for _, i in hits[:k]] if hits else list(range(min(k, len(chunks))))


def test_keyword_top_against_brute_force(spark):
    chunks = ["Alpha beta", "betamax tape", "gamma", "alpha ALPHA beta", "delta beta-carotene"]
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(chunks)], "source string, chunk_no int, text string")
    queries = [("q1", "alpha beta"), ("q2", "BETA"), ("q3", "zzz"), ("q4", "a b"), ("q5", "  ")]
    rows = corpus.keyword_top(df, queries, 2).orderBy("query_id", "rank").collect()
    for name, query in queries[:4]:
        assert [r["chunk_no"] for r in rows if r["query_id"] == name] == brute_force_keyword(chunks, query, 2)
    assert not [r for r in rows if r["query_id"] == "q5"]


def test_embedding_top(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    rows = corpus.embedding_top(df, [(7, [2.0, 0.0]), (8, [0.0, 0.0])], "id", "v", 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [(7, 1), (7, 3), (8, 1), (8, 2)]


def test_dedupe_keeps_first_and_drops_blank(spark):
    rows = [(0, "[a] Same  text"), (1, "[b] same text"), (2, "[c] # Heading"), (3, "other")]
    df = spark.createDataFrame(rows, "pos int, passage string")
    assert sorted(r["pos"] for r in corpus.dedupe_passages(df, "passage", ["pos"]).collect()) == [0, 3]


def test_error_classes(spark):
    rows = [("KeyError: 'x'", False), ("SyntaxError", False), ("SyntaxError", True), ("MemoryError", False), (None, False)]
    found = column(spark, text.error_class(F.col("e"), F.col("t")), rows, "e string, t boolean")
    assert found == ["schema_error", "syntax_error", "timeout", "oom", "other"]


def test_percent_rounds_half_to_even(spark):
    assert column(spark, numbers.percent(F.col("a"), F.col("b")), [(1, 1600), (40, 1000), (1, 0)], "a long, b long") == [0.1, 4.0, None]


def test_contract_with_fallback(spark):
    df = spark.range(3)
    contract = usercode.TableContract(columns={"id": "bigint"}, row_rules={"small": lambda: F.col("id") < 2})
    outcome = usercode.apply_with_contract(df, [lambda d: d, lambda d: d.select("nope")], contract, df.limit(0))
    assert outcome.degraded and outcome.attempts == 2 and outcome.errors[0] == "1:rows:small"
    assert outcome.errors[1].startswith("2:raised:")


def test_folds_are_even(spark):
    df = spark.range(103).withColumn("y", F.when(F.col("id") < 70, 0).otherwise(1))
    sizes = folds.stratified_folds(df, "y", ["id"]).groupBy("y", "fold").count().collect()
    for label, total in ((0, 70), (1, 33)):
        found = [r["count"] for r in sizes if r["y"] == label]
        assert sum(found) == total and max(found) - min(found) <= 1


def test_since_unknown_id_gives_everything(spark):
    events = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id long, ts long")
    assert runlog.since(events, 2).count() == 1 and runlog.since(events, 99).count() == 3


def test_ladder():
    task = models.Task("y", "id")
    assert models.technique_ladder(task, "rf") == ["random_forest", "logistic_regression", "hist_gradient_boosting"]
    assert models.technique_ladder(models.Task("y", "id", hints=roles.Hints(text_free=("t",)))) == ["tfidf_logreg"]


def test_tabular_experiment_learns(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 3 + F.rand(1) / 5).alias("x"), F.lit("c").alias("s"))
    task = models.Task("y", "id", metric="accuracy")
    result = models.run_experiment(df, task, "logistic_regression", k=3)
    assert result.cv_score > 0.95 and result.oof.count() == 300
    test = df.select("x", "id", F.lit("unseen").alias("s"))
    predicted = models.score_and_submit(df, test, None, task, "logistic_regression").join(df.select("id", F.col("y").alias("truth")), "id")
    assert predicted.where("y = truth").count() > 280
    failed = models.compare_experiments(df.drop("x", "s"), task, ["logistic_regression"])
    assert failed[0].error and failed[0].cv_score is None


def test_raw_profile_reads_long_cells_again(spark):
    from millrace.operators.profile import raw_string_profile

    long = ["x" * 300 + str(i) for i in range(8)]
    rows = [(i, long[i % 8] if i % 3 else " ", str(i % 2)) for i in range(60)]
    got = {r["column"]: r for r in raw_string_profile(spark.createDataFrame(rows, "pos int, body string, flag string"), "pos").collect()}
    assert got["body"].n_missing == 20 and got["body"].n_unique == 8 and got["body"].dtype == "text"
    assert got["body"].samples == [long[1], long[2], long[4], long[5], long[7]]
    assert got["flag"].dtype == "integer" and got["flag"].samples == ["0", "1"]
    empty = raw_string_profile(spark.createDataFrame([(1, None)], "pos int, body string"), "pos").first()
    assert (empty.n_missing, empty.n_unique, empty.dtype, empty.samples) == (1, 0, "empty", [])


def test_wide_text_columns_count_distinct_values(spark):
    from millrace.operators.prep import wide_text_columns
    from millrace.operators.roles import Hints

    rows = [(f"t{i}", "w" * 100 + str(i), str(i % 50), None) for i in range(120)]
    df = spark.createDataFrame(rows, "text string, wide string, few string, none string")
    led = Hints(text_free=("text", "few", "none", "wide"), representation_options=("tfidf_logreg",))
    assert wide_text_columns(df, led) == ["wide"]
    assert wide_text_columns(df, Hints(text_free=("text", "wide"), categorical=("few",))) == ["text", "wide"]
