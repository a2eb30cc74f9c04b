"""Cases beyond earlier limits: deep documents, cycles, large ids, quoted line breaks, many classes."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import prep, runlog, setops
from millrace.plans import ranks
from millrace.plans.ranks import with_share
from millrace.sources import csvfiles


def nested(depth, leaf):
    value = {"leaf": leaf, "same": 1}
    for k in reversed(range(depth)):
        value = {f"k{k}": value, "same": [1, {"x": 2}]}
    return json.dumps(value)


@pytest.mark.parametrize("depth", [0, 3, 4, 9, 17])
def test_json_difference_opens_every_level(spark, depth):
    df = spark.createDataFrame([(1, nested(depth, "a"), nested(depth, "b")), (2, nested(depth, "a"), nested(depth, "a"))], "id int, base string, overlay string")
    rows = setops.json_difference(df, "id", "base", "overlay").collect()
    path = "$" + "".join(f".k{k}" for k in range(depth)) + ".leaf"
    assert [tuple(r) for r in rows] == [(1, path, '"b"')]


def test_tree_with_cycles_and_a_deep_chain(spark):
    chain = [(i, i - 1) for i in range(1, 300)] + [(0, None)]
    cycle = [(1000, 1002), (1001, 1000), (1002, 1001), (1003, 1001), (1004, 1003), (2000, 2000), (2001, 2000)]
    rows = {r.id: r for r in runlog.event_tree(spark.createDataFrame(chain + cycle + [(3000, 9999)], "id long, parent_id long")).collect()}
    assert len(rows) == 300 + 7 + 1
    assert all(rows[i].depth == i and rows[i].path == list(range(i + 1)) for i in range(300))
    assert all(rows[i].depth is None and rows[i].path is None for i, _ in cycle) and rows[3000].depth == 0


def test_large_ids_survive_preparation(spark):
    ids = [2**53 + 1, 2**53 + 3, 2**53 + 5, -(2**53) - 7]
    train = spark.createDataFrame([(i, k if k else None, i - 1, "y") for k, i in enumerate(ids)], "id long, gap int, whole long, label string")
    test = spark.createDataFrame([(ids[0], 1, None), (ids[1], None, 2**60 + 1)], "id long, gap int, whole long")
    a, b, values = prep.clean(train, test, "label", id_column="id")
    assert dict(a.dtypes) == {"id": "bigint", "gap": "double", "whole": "bigint", "label": "string"}
    assert [r.id for r in a.collect()] == ids and [r.whole for r in a.collect()] == [i - 1 for i in ids]
    rows = b.collect()
    assert rows[1].whole == 2**60 + 1 and rows[1].gap == 2.0 and rows[0].whole is not None and "id" not in values.numbers


def test_csv_with_line_breaks_and_two_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"two\nlines, and ""quotes"""\n2,x\n')
    (tmp_path / "b.csv").write_bytes("v,id\nn\xe9,3\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("﻿id,extra\n4,z\n", encoding="utf-8")
    rows = {r.id: r for r in csvfiles.read_csv(spark, str(tmp_path)).collect()}
    assert rows[1].v == 'two\nlines, and "quotes"' and rows[2].v == "x" and rows[3].v == "né"
    assert rows[4].extra == "z" and rows[4].v is None and len(rows) == 4


def test_sniffing_reads_lines_not_bytes(spark, tmp_path):
    wide = "|".join(["a, b" * 2000] * 3)
    (tmp_path / "w.txt").write_text("\n".join(["h1|h2|h3", *[wide] * 25]))
    heads = csvfiles.file_heads(spark.createDataFrame([(f"file://{tmp_path}/w.txt",)], "path string"))
    assert heads.select(csvfiles.sniff_delimiter(F.col("head"))).first()[0] == "|"


@pytest.mark.parametrize("bound", [100_000, 0])
def test_shares_do_not_move_rows_of_few_classes(spark, tables, monkeypatch, bound):
    monkeypatch.setattr(ranks, "BROADCAST_CLASSES", bound)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        df = with_share(tables.lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 7, [0.25, 0.5], "fold")
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {(r[0], r[1]): r[2] for r in df.groupBy("l_returnflag", "fold").count().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("hashpartitioning" in plan) == (bound == 0)
    totals = {r[0]: r[1] for r in tables.lineitem.groupBy("l_returnflag").count().collect()}
    assert all(abs(counts[c, 0] - 0.25 * n) <= 1 and abs(counts[c, 2] - 0.5 * n) <= 1 for c, n in totals.items())


def test_tfidf_features_keeps_every_term(spark):
    from types import SimpleNamespace

    from millrace.catalog.modelling import tfidf_features

    text = " ".join(f"w{i}" for i in range(140_000))
    rows = spark.createDataFrame([(1, 1, text), (2, 1, text.upper()), (3, 1, None), (4, 1, "w1")], "conv_id long, turn int, text string")
    got = tfidf_features(SimpleNamespace(spark=spark, conversations=rows))
    assert got.count() == 140_000 + 139_999
    assert {r.term: r.n_documents for r in got.filter("term IN ('w1', 'w0 w1', 'w139998 w139999')").collect()} == {"w1": 3, "w0 w1": 2, "w139998 w139999": 2}
