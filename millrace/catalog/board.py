"""Leaderboard, run catalog and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import board, setops

_RUNS = """runs AS (SELECT o_custkey AS case_id, o_orderkey AS run_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS started_at,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS ended_at, o_orderstatus = 'P' AS halted, CASE WHEN o_custkey < 700 THEN 'rmse' ELSE 'f1' END AS metric,
      CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS score, o_totalprice FROM orders)"""


def _runs(t):
    return t.orders.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_at"), (F.col("o_orderstatus") == "P").alias("halted"),
        F.when(F.col("o_custkey") < 700, "rmse").otherwise("f1").alias("metric"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("score"), "o_totalprice",
    )


@query(
    "run_catalog",
    f"""WITH {_RUNS} SELECT run_id, started_at, CASE WHEN halted THEN 'halted' WHEN ended_at IS NOT NULL THEN 'complete' ELSE 'running' END AS status,
      CASE WHEN NOT halted THEN metric END AS metric, CASE WHEN NOT halted THEN score END AS score,
      CASE WHEN NOT halted THEN CASE WHEN metric = 'rmse' THEN score <= 200000 ELSE score >= 200000 END END AS meets_threshold,
      CASE WHEN NOT halted AND case_id <> 0 THEN case_id END AS total_tokens FROM runs""",
)
def run_catalog(t):
    runs = _runs(t)
    states = runs.where("not halted").select(
        "run_id", "metric", F.lit(None).cast("string").alias("explicit_direction"),
        F.create_map("metric", "score", F.lit("other"), F.lit(1.0)).alias("metrics"),
        F.lit(200000.0).alias("threshold"), F.col("case_id").alias("tokens"),
    )
    return board.leaderboard(runs.select("run_id", "started_at", "ended_at", "halted"), states)


@query("runs_newest", f"WITH {_RUNS} SELECT run_id, started_at FROM runs")
def runs_newest(t):
    return board.newest_first(_runs(t).select("run_id", "started_at"))


@query(
    "badges",
    f"""WITH {_RUNS}, r AS (SELECT *, length(CAST(run_id AS VARCHAR)) * 100 + run_id % 7 AS tokens, run_id % 11 AS tp, run_id % 5 AS fn FROM runs),
    b AS (SELECT case_id, run_id, 'best_score' AS badge, row_number() OVER (PARTITION BY case_id, metric ORDER BY CASE WHEN metric = 'rmse' THEN score ELSE -score END, run_id) AS rk FROM r WHERE score IS NOT NULL
      UNION ALL SELECT case_id, run_id, 'fewest_tokens', row_number() OVER (PARTITION BY case_id ORDER BY tokens, run_id) FROM r
      UNION ALL SELECT case_id, run_id, 'best_recall', row_number() OVER (PARTITION BY case_id ORDER BY tp / (tp + fn) DESC, run_id) FROM r WHERE tp + fn > 0)
    SELECT case_id, run_id, badge FROM b WHERE rk = 1""",
)
def badges(t):
    key = F.col("run_id")
    runs = _runs(t).withColumns({"position": key, "tokens": F.length(key.cast("string")) * 100 + key % 7, "tp": key % 11, "fn": key % 5})
    return board.badges(runs)


@query(
    "feature_frequency",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS feature FROM lineitem)
    SELECT feature, count(*) AS n, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_runs, count(*) < (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS differs FROM r GROUP BY 1""",
)
def feature_frequency(t):
    runs = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("features"))
    return board.feature_frequency(runs)


@query(
    "missing_handling",
    """SELECT o_orderkey AS run_id, concat_ws(',', CASE WHEN o_custkey % 3 > 0 THEN 'age' END, CASE WHEN o_custkey % 2 > 0 AND o_orderstatus <> 'F' THEN 'cabin' END) AS filled,
      CASE WHEN o_custkey % 2 > 0 AND o_orderstatus = 'F' THEN 'cabin' ELSE '' END AS dropped FROM orders""",
)
def missing_handling(t):
    before = F.create_map(F.lit("cabin"), F.col("o_custkey") % 2, F.lit("age"), F.col("o_custkey") % 3)
    dropped = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("cabin"), F.lit("ticket")))
    reports = t.orders.select(F.col("o_orderkey").alias("run_id"), before.alias("missing_before"), dropped.alias("columns_dropped"))
    out = board.missing_handling(reports)
    return out.select("run_id", F.array_join("filled", ",").alias("filled"), F.array_join("dropped", ",").alias("dropped"))


@query(
    "runs_upsert",
    """WITH c AS (SELECT o_custkey AS id, o_orderkey AS version, o_totalprice AS amount, 0 AS src FROM orders UNION ALL SELECT c_custkey, 7000, c_acctbal, 1 FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, src DESC) AS rk FROM c) SELECT id, version, amount FROM r WHERE rk = 1""",
)
def runs_upsert(t):
    current = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("amount"))
    changes = t.customer.select(F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("id"), F.lit(7000).cast("long").alias("version"))
    return board.upsert(current, changes, ["id"], "version")


@query(
    "case_union",
    """SELECT 'demo' AS origin, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'user', s_suppkey, s_name, NULL FROM supplier""",
)
def case_union(t):
    demo = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return board.case_union(demo, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("runs_across_cases", "SELECT CAST(sum(n) AS BIGINT) AS runs, count(*) AS cases FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def runs_across_cases(t):
    return board.runs_across_cases(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("run_count")))


@query(
    "ordered_distinct",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || CASE WHEN l_linestatus <> l_returnflag THEN ',' || l_linestatus ELSE '' END
      || CASE WHEN 'F' NOT IN (l_returnflag, l_linestatus) THEN ',F' ELSE '' END AS names FROM lineitem""",
)
def ordered_distinct(t):
    names = setops.ordered_distinct(F.array("l_returnflag", "l_linestatus", "l_returnflag"), F.array(F.lit("F"), F.col("l_linestatus")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(names, ",").alias("names"))


@query(
    "map_diff",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'O' THEN 'status=' || o_orderstatus END, CASE WHEN o_orderpriority <> '5-LOW' THEN 'priority=' || o_orderpriority END, 'extra=1') AS changes FROM orders""",
)
def map_diff(t):
    base = F.create_map(F.lit("status"), F.lit("O"), F.lit("priority"), F.lit("5-LOW"))
    overlay = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("extra"), F.lit("1"))
    entries = F.map_entries(setops.map_difference(base, overlay))
    return t.orders.select("o_orderkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("changes"))


@query(
    "nested_diff",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN '$.kind="' || event_type || '"' END AS kind, CASE WHEN k <> 10 THEN '$.p.k=' || k END AS inner_k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
)
def nested_diff(t):
    """Difference of two JSON documents, nested keys included."""
    overlay = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "p": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "same": [1, 2]}}'))
    base = F.lit('{"p": {"same": [1, 2], "k": 10}, "kind": "view"}')
    rows = t.events.select("event_id", base.alias("base"), overlay.alias("overlay"))
    paths = setops.json_difference(rows, "event_id", "base", "overlay")
    shown = F.concat("path", F.lit("="), "value")
    changed = paths.groupBy("event_id").agg(
        F.max(F.when(F.col("path") == "$.kind", shown)).alias("kind"), F.max(F.when(F.col("path") == "$.p.k", shown)).alias("inner_k")
    )
    return t.events.select("event_id").join(changed, "event_id", "left")
