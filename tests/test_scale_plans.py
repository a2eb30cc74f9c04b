"""The plans for hot groups must give what the plain plans give."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import runlog, spend
from millrace.plans import quantiles, ranks, scan


def hot_log(spark, n=400):
    """A log in which one run holds nearly all rows."""
    rng = np.random.default_rng(7)
    kinds = ["substep.dispatch", "substep.end", "llm.start", "llm.end", "exception"]
    frame = pd.DataFrame(
        {
            "run_id": np.where(rng.random(n) < 0.9, 1, rng.integers(2, 6, n)),
            "id": np.arange(n),
            "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, n // 2, n), unit="s"),
            "type": rng.choice(kinds, n),
            "agent": rng.choice(["pm", "domain", "developer"], n),
            "value": rng.integers(0, 50, n),
        }
    )
    frame.loc[~frame["type"].isin(["substep.dispatch", "exception"]), "agent"] = None
    return spark.createDataFrame(frame).withColumn("communication_id", F.lit(None).cast("long"))


@pytest.mark.parametrize("by", [["run_id"], ["type"], []])
def test_split_scan_equals_plain_scan(spark, by):
    log = hot_log(spark)
    marked = F.when(F.col("type") == "llm.start", F.col("id"))
    outputs = {
        "total": scan.running_sum(F.when(F.col("type") != "exception", F.col("value"))),
        "place": scan.row_number(),
        "held": scan.last(marked),
        "before": scan.previous(marked),
        "after": scan.following(marked),
    }
    plain = scan.ordered_scan(log, by, ["ts", "id"], outputs)
    split = scan.ordered_scan(log, by, ["ts", "id"], outputs, hot_rows=1)
    assert plain.count() == split.count() == 400
    assert plain.exceptAll(split).isEmpty()


def test_log_operators_do_not_depend_on_the_plan(spark):
    log = hot_log(spark)
    for operator in (runlog.with_current_agent, runlog.agent_states, runlog.agent_edges):
        assert operator(log).exceptAll(operator(log, hot_rows=1)).isEmpty()
        assert operator(log, hot_rows=1).exceptAll(operator(log)).isEmpty()
    rows = log.select("run_id", "id", F.col("id").alias("seq"), F.col("ts").alias("started_at"), F.col("value").alias("tokens"))
    assert spend.soft_limit_crossing(rows, 500).exceptAll(spend.soft_limit_crossing(rows, 500, hot_rows=1)).isEmpty()


def test_correlate_does_not_depend_on_the_plan(spark):
    log = hot_log(spark)
    records = log.where("type = 'substep.dispatch'").select(
        "run_id", F.col("id").alias("comm_no"), "agent", F.lit(None).cast("string").alias("call_id"),
        F.col("ts").alias("opened_at"), (F.col("ts") + F.expr("interval 20 seconds")).alias("closed_at"),
    )
    records = records.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened_at", "closed_at")})
    events = log.where("type = 'exception'").select("run_id", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "agent", F.lit(None).cast("string").alias("call_id"))
    plain, split = runlog.correlate(events, records), runlog.correlate(events, records, hot_rows=1)
    assert plain.count() == events.count()
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def plain_correlation(events, records):
    """The routes of ``correlate``, event by event."""
    out, taught = {}, {}
    for run, number, ts, agent, call in sorted(events, key=lambda e: (e[2], e[1])):
        live = sorted(((o, n, a, c, z) for r, n, a, c, o, z in records if r == run and o is not None and o <= ts and (z is None or z > ts)))
        until = {n: z for _, n, _, _, z in live}
        of_call = [n for _, n, _, c, _ in live if call and c == call]
        of_agent = [n for _, n, a, _, _ in live if agent and a == agent]
        led = of_agent[-1] if of_agent else live[0][1] if len(live) == 1 else None
        if of_call:
            led = of_call[-1]
        elif call:
            held = taught.get((run, call))
            if held is None or held not in until:
                taught[run, call] = held = led
            led = held
        out[run, number] = led
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_correlate_event_by_event(spark, hot_rows):
    rng = random.Random(hot_rows)
    start = dt.datetime(2024, 1, 1, 12)
    moment = lambda s: start + dt.timedelta(seconds=s)
    records, events = [], []
    for i in range(400):
        opened = None if i % 97 == 5 else moment(rng.randrange(3000))
        length = rng.choice([0, 3, 30, 300, 2000, None])
        closed = None if length is None or opened is None or i % 50 else opened + dt.timedelta(seconds=length)
        if length is not None and opened is not None:
            closed = opened + dt.timedelta(seconds=length)
        records.append((rng.choice([1, 1, 1, 2]), i + 1, rng.choice("abc") if i % 11 else None, rng.choice(["x", "y", None, None]), opened, closed))
    for i in range(600):
        events.append((rng.choice([1, 1, 2, 3]), i, moment(rng.randrange(-5, 3500)), rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", "z", "w", None])))
    left = spark.createDataFrame(events, "run_id long, id long, ts timestamp_ntz, agent string, call_id string")
    right = spark.createDataFrame(records, "run_id long, comm_no long, agent string, call_id string, opened_at timestamp_ntz, closed_at timestamp_ntz")
    got = {(r.run_id, r.id): r.comm_no for r in runlog.correlate(left, right, hot_rows=hot_rows).collect()}
    assert got == plain_correlation(events, records)
    zoned = runlog.correlate(left.withColumn("ts", F.col("ts").cast("timestamp")), right.withColumns({c: F.col(c).cast("timestamp") for c in ("opened_at", "closed_at")}), hot_rows=hot_rows)
    assert {(r.run_id, r.id): r.comm_no for r in zoned.collect()} == got


def test_the_newest_record_still_open_is_found(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    records = [(1, 1, "a", None, at(1), None), (1, 2, "a", None, at(2), None), (1, 3, "a", None, at(3), at(4))]
    right = spark.createDataFrame(records, "run_id long, comm_no long, agent string, call_id string, opened_at timestamp_ntz, closed_at timestamp_ntz")
    left = spark.createDataFrame([(1, 9, at(5), "a", None)], "run_id long, id long, ts timestamp_ntz, agent string, call_id string")
    for hot_rows in (100, 1):
        assert runlog.correlate(left, right, hot_rows=hot_rows).first().comm_no == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50), st.sampled_from([1.0, 2.0, float("nan")])), min_size=1, max_size=120))
def test_bracketed_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    clean = [v for v in values if v is not None and not np.isnan(v)]
    found = quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.9], direct_rows=3)["x"]
    if clean:
        assert found == pytest.approx(list(np.quantile(clean, [0.25, 0.5, 0.9])))
    else:
        assert found == [None, None, None]


@pytest.mark.parametrize("digits", [1, 4])
def test_class_shares_are_exact(spark, digits):
    df = spark.range(500).withColumn("label", F.when(F.col("id") < 450, "big").when(F.col("id") < 487, "small"))
    shares = [0.01, 0.5, 0.9]
    rows = ranks.with_share(df, ["label"], ["id"], 42, shares, "after", digits).toPandas().fillna("none")
    for label, n in (("big", 450), ("small", 37), ("none", 13)):
        ends = [0, *[int(n * s + 0.5) for s in shares], n]
        found = rows[rows["label"] == label]["after"].value_counts().to_dict()
        assert found == {i: b - a for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a}
    plain = ranks.with_share(df, [], ["id"], 42, [0.2], "after", digits).groupBy("after").count().collect()
    assert {r["after"]: r["count"] for r in plain} == {0: 100, 1: 400}


def test_event_tree_of_a_chain_and_a_star(spark):
    chain = [(i, i - 1 if i else None) for i in range(20)]
    star = [(100 + i, 19) for i in range(50)] + [(500, 499)]  # 499 does not exist
    nodes = spark.createDataFrame(chain + star, "id long, parent_id long")
    rows = {r["id"]: r for r in runlog.event_tree(nodes).collect()}
    assert rows[19]["depth"] == 19 and rows[19]["path"] == list(range(20))
    assert rows[149]["depth"] == 20 and rows[500]["depth"] == 0
    # A cycle is flagged by NULLs and does not end the job for the other nodes.
    looped = runlog.event_tree(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, parent_id long"))
    assert {r["id"]: r["depth"] for r in looped.collect()} == {1: None, 2: None, 3: 0}
