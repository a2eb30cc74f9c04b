"""End to end: sources to submission; sources read back from files."""

import pytest
from pyspark.sql import functions as F

from millrace import project
from millrace.operators import corpus
from millrace.operators.roles import Hints
from millrace.session import shared_folder
from millrace.sources import csvfiles, jsonlines, listing, stages


def people(spark, n=240):
    return spark.range(n).select(
        F.col("id").alias("person_id"),
        (F.col("id") % 2).cast("int").alias("survived"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 2) * 10 + F.col("id") % 5).cast("double").alias("age"),
        F.when(F.col("id") % 11 != 0, F.when(F.col("id") % 3 == 0, "m").otherwise("f")).alias("sex"),
    )


def test_project_from_tables_to_submission(spark):
    everyone = people(spark)
    train, test = everyone.where("person_id < 200"), everyone.where("person_id >= 200").drop("survived")
    store = stages.StageStore(spark, shared_folder(spark, "project"), "raw.parquet", "raw_test.parquet")
    settings = project.Settings(hints=Hints(categorical=("sex",), high_missing=("age",)), preferred="logistic_regression", metric="f1")
    understanding = project.understand(train, test, settings)
    assert (understanding.settings.target, understanding.settings.id_column) == ("survived", "person_id")
    ready, ready_test = project.prepare(train, test, understanding.settings, store)
    assert ready.where("age is null or sex is null").isEmpty() and ready.agg(F.sum("age_missing")).first()[0] == 29
    assert "survived" not in ready_test.columns and store.inputs("3.5")[0].endswith("train_integrated.parquet")
    sample = test.select("person_id", F.lit(0).alias("survived"))
    task_settings = project.replace(settings, hints=Hints(categorical=("sex",)), preferred="logistic_regression")
    from unittest.mock import patch

    with patch("millrace.operators.models.technique_ladder", lambda task, preferred=None: ["logistic_regression"]):
        result = project.run(train, test, sample, task_settings)
    assert result.best.cv_score > 0.9 and result.violations.isEmpty() and result.submission.count() == 40


def test_project_without_a_test_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("millrace.operators.models.technique_ladder", lambda task, preferred=None: ["logistic_regression"])
    settings = project.Settings("survived", "person_id", hints=Hints(categorical=("sex",)), metric="accuracy")
    result = project.run(people(spark), settings=settings, model_path=f"file://{tmp_path}/model")
    assert result.train.count() == 192 and result.submission.count() == 48 and "survived" not in result.test.columns
    assert result.holdout_score > 0.9 and result.violations.isEmpty()
    bundle = result.bundle.first()
    assert sum(c.n for c in bundle.confusion) == 192 and bundle.cv["mean"] == pytest.approx(result.best.cv_score)
    from millrace.operators import models

    task = models.Task("survived", "person_id")
    again = models.submit_saved(spark, f"file://{tmp_path}/model", result.test, None, task)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in result.submission.collect()}


def test_project_of_numbers_without_a_test_table(spark, monkeypatch):
    monkeypatch.setattr("millrace.operators.models.technique_ladder", lambda task, preferred=None: ["ridge"])
    rows = spark.range(150).selectExpr("id AS key", "CAST(id % 13 AS double) AS a", "IF(id % 5 = 0, NULL, CAST(id % 7 AS double)) AS b", "3.0 * (id % 13) + 2 + (id % 3) * 0.1 AS price")
    result = project.run(rows, settings=project.Settings("price", "key", "regression", "rmse", Hints()))
    bundle = result.bundle.first()
    assert bundle.confusion == [] and bundle.cv["n_folds"] == 5 and bundle.metrics["rmse"] == pytest.approx(result.best.cv_score)
    assert 0 < bundle.metrics["rmse"] < 1 and result.holdout_score < 1 and result.submission.count() + result.train.count() == 150


def test_stage_resolver_walks_back(spark):
    root = shared_folder(spark, "stages")
    store = stages.StageStore(spark, root, "train.csv", "test.csv")
    assert store.inputs("3.4") == ("train.csv", "test.csv")
    df = people(spark, 4)
    store.write("clean", df, df)
    assert store.inputs("3.5")[0].endswith("train_clean.parquet") and store.inputs("3.2") == ("train.csv", "test.csv")
    with pytest.raises(FileNotFoundError):
        stages.read_table(spark, f"{root}/nothing.csv")


@pytest.mark.parametrize("encoding,text", [("utf-8", "café €"), ("utf-8-sig", "naïve"), ("cp1252", "café €"), ("latin-1", "caf\xe9 \x81")])
def test_csv_encodings(spark, tmp_path, encoding, text):
    path = tmp_path / "t.csv"
    path.write_bytes(f"rec_id,note,label\n1,{text},x\n2,NA,1.5\n".encode(encoding))
    rows = stages.read_table(spark, str(path)).orderBy("rec_id").collect()
    assert rows[0]["note"] == text and rows[1]["note"] is None and rows[0].asDict().keys() == {"rec_id", "note", "label"}


def test_run_catalog_and_corpus_and_listing(spark, tmp_path):
    for case, run in (("a", "r1"), ("a", "r2"), ("b", "r1")):
        folder = tmp_path / case / "runs" / run
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text('{"model": "%s"}' % (case + run))
    rows = jsonlines.run_catalog(spark, str(tmp_path), "model string").collect()
    assert sorted((r["case_id"], r["run_id"], r["model"]) for r in rows) == [("a", "r1", "ar1"), ("a", "r2", "ar2"), ("b", "r1", "br1")]
    (tmp_path / "a" / "runs" / "r1" / "status.json").write_text('{"halted": true}')
    (tmp_path / "b" / "runs" / "r1" / "status.json").write_text('{"workflow_complete": true}')
    status = jsonlines.run_catalog(spark, str(tmp_path), "halted boolean, workflow_complete boolean", "status.json")
    joined = jsonlines.with_status(jsonlines.run_catalog(spark, str(tmp_path), "model string"), status)
    assert {(r.case_id, r.run_id): r.state for r in joined.collect()} == {("a", "r1"): "halted", ("a", "r2"): "running", ("b", "r1"): "complete"}
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "one.md").write_text("# T\n\ntext")
    (notes / "skip.txt").write_text("a;b\n1;2\n")
    read = listing.read_corpus(spark, str(notes))
    assert [(r["source"], r["text"]) for r in corpus.chunk_documents(read, "name", "text").collect()] == [("one.md", "text")]
    found = listing.list_files(spark, str(notes))
    assert found.count() == 2 and listing.inspect_folder(found).first()["runnable"]
    seps = {r["path"][-8:]: r["sep"] for r in csvfiles.file_heads(found).select("path", csvfiles.sniff_delimiter(F.col("head")).alias("sep")).collect()}
    assert seps["skip.txt"] == ";"


def test_traces_and_broken_lines(spark, tmp_path):
    trace = tmp_path / "trace.json"
    trace.write_text('{"run_id": "r", "case_id": "c",\n "events": [{"id": "1", "type": "loop", "attributes": {"label": "A"}}, {"id": "2"}]}')
    rows = jsonlines.read_traces(spark, str(trace)).collect()
    assert [(r["position"], r["id"], (r["attributes"] or {}).get("label")) for r in rows] == [(0, "1", "A"), (1, "2", None)]
    log = tmp_path / "log.jsonl"
    log.write_text('{"seq": 1, "ok": true}\n\n{"seq": 2,\n{"seq": 3, "ok": false}\n')
    counted = jsonlines.read_tolerant(spark, str(log), "seq long, ok boolean", keep_malformed=True)
    assert counted.count() == 3 and counted.where("malformed").count() == 1
    assert jsonlines.read_tolerant(spark, str(log), "seq long, ok boolean", keep_malformed=False).count() == 2
