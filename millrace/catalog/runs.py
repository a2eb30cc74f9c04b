"""Run-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.evaluation import STATES, states
from millrace.catalog.fixtures import ATTEMPTS, TRACE_EVENTS, attempts, trace_events
from millrace.catalog.registry import query
from millrace.operators import contracts, dimensions, runlog

_TRACE = f"WITH {TRACE_EVENTS}"
_CURRENT = """cur AS (SELECT *, last_value(CASE WHEN type = 'substep.dispatch' THEN agent END IGNORE NULLS)
      OVER (PARTITION BY run_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS current_agent FROM trace)"""


@query("timeline_filter", f"{_TRACE} SELECT run_id, id, type FROM trace WHERE type IN ('substep.dispatch', 'substep.end', 'llm.start', 'llm.end', 'exception')")
def timeline_filter(t):
    return runlog.timeline(trace_events(t)).select("run_id", "id", "type")


@query("tail_events", f"{_TRACE} SELECT id, type FROM trace ORDER BY ts DESC, id DESC LIMIT 50")
def tail_events(t):
    return runlog.tail(trace_events(t), 50).select("id", "type")


@query(
    "events_since",
    f"""{_TRACE}, pos AS (SELECT max(ts) AS since_ts FROM trace WHERE id = 432)
    SELECT 'known' AS place, id FROM trace WHERE ts > (SELECT since_ts FROM pos) UNION ALL SELECT 'unknown', id FROM trace""",
)
def events_since(t):
    events = trace_events(t)
    known = runlog.since(events, 432).select(F.lit("known").alias("place"), "id")
    return known.unionByName(runlog.since(events, -1).select(F.lit("unknown").alias("place"), "id"))


@query(
    "span_pairing",
    f"""{_TRACE}, s AS (SELECT *, lag(type) OVER w AS pt, lag(ts) OVER w AS pts, lag(id) OVER w AS pid, lag(agent) OVER w AS pa
      FROM trace WHERE type IN ('substep.dispatch', 'substep.end') WINDOW w AS (PARTITION BY run_id ORDER BY ts, id))
    SELECT run_id, id, CASE WHEN pt = 'substep.dispatch' THEN pid END AS start_id,
      CASE WHEN pt = 'substep.dispatch' THEN (epoch_us(ts) - epoch_us(pts)) / 1000.0 END AS duration_ms,
      CASE WHEN pt = 'substep.dispatch' THEN pa END AS agent FROM s WHERE type = 'substep.end'""",
)
def span_pairing(t):
    events = trace_events(t).where(F.col("type").isin("substep.dispatch", "substep.end"))
    return runlog.span_pairs(events.withColumn("is_start", F.col("type") == "substep.dispatch"), ["run_id"], ["agent"])


_FACTS = """facts AS (SELECT run_id, substep, bool_or(type = 'substep.dispatch') AS dispatched, bool_or(type = 'substep.end') AS ended, false AS skipped,
      CAST(trunc(arg_max(ts_mono_ms, ts) FILTER (type = 'substep.end') - arg_max(ts_mono_ms, ts) FILTER (type = 'substep.dispatch')) AS BIGINT) AS duration_ms
      FROM trace WHERE type IN ('substep.dispatch', 'substep.end') GROUP BY 1, 2)"""


@query("substep_durations", f"{_TRACE}, {_FACTS} SELECT * FROM facts")
def substep_durations(t):
    return runlog.substep_facts(trace_events(t))


@query("active_agent_ffill", f"{_TRACE}, {_CURRENT} SELECT run_id, id, type, current_agent FROM cur")
def active_agent_ffill(t):
    return runlog.with_current_agent(trace_events(t)).select("run_id", "id", "type", "current_agent")


@query(
    "agent_final_state",
    f"""{_TRACE}, {_CURRENT},
    changes AS (SELECT run_id, agent, 'active' AS state, ts FROM cur WHERE type = 'substep.dispatch'
      UNION ALL SELECT run_id, current_agent, CASE type WHEN 'substep.end' THEN 'done' ELSE 'error' END, ts FROM cur
        WHERE type IN ('substep.end', 'exception') AND current_agent IS NOT NULL),
    seen AS (SELECT DISTINCT run_id, agent FROM trace WHERE agent IS NOT NULL),
    lasts AS (SELECT s.run_id, s.agent, arg_max(c.state, c.ts) AS state, max(c.ts) AS at FROM seen s
      LEFT JOIN changes c ON c.run_id = s.run_id AND c.agent = s.agent GROUP BY 1, 2)
    SELECT run_id, agent, CASE WHEN state IS NULL THEN 'idle' WHEN state = 'active' AND EXISTS (SELECT 1 FROM trace d
        WHERE d.run_id = lasts.run_id AND d.type = 'substep.dispatch' AND d.agent <> lasts.agent AND d.ts > lasts.at) THEN 'done' ELSE state END AS state FROM lasts""",
)
def agent_final_state(t):
    return runlog.agent_states(trace_events(t))


@query(
    "agent_edges",
    f"""{_TRACE}, {_CURRENT}, calls AS (SELECT *, lead(type) OVER (PARTITION BY run_id, current_agent ORDER BY ts, id) AS nxt
      FROM cur WHERE type IN ('llm.start', 'llm.end') AND current_agent IS NOT NULL)
    SELECT run_id, 'llm-' || current_agent || '-' || id AS edge_id, current_agent AS source, 'llm' AS target, nxt IS DISTINCT FROM 'llm.end' AS animated,
      'interaction' AS edge_type FROM calls WHERE type = 'llm.start'
    UNION ALL SELECT DISTINCT run_id, 'dispatch-flow-' || agent, 'flow', agent, false, 'dispatch' FROM trace WHERE type = 'substep.dispatch'""",
)
def agent_edges(t):
    return runlog.agent_edges(trace_events(t))


@query(
    "event_tree",
    """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
    tree AS (SELECT id, 0 AS depth, id AS path FROM nodes WHERE parent_id IS NULL
      UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.id FROM nodes n JOIN tree t ON n.parent_id = t.id)
    SELECT id, depth, path FROM tree""",
)
def event_tree(t):
    def node(df, mark, key, parent_mark=None, parent=None):
        up = F.concat(F.lit(parent_mark), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), up.alias("parent_id"))

    nodes = (
        node(t.region, "r", "r_regionkey")
        .unionByName(node(t.nation, "n", "n_nationkey", "r", "n_regionkey"))
        .unionByName(node(t.customer, "c", "c_custkey", "n", "c_nationkey"))
        .unionByName(node(t.orders, "o", "o_orderkey", "c", "o_custkey"))
    )
    return runlog.event_tree(nodes).withColumn("path", F.array_join("path", "/"))


_CALLS = """base AS (SELECT user_id AS run_id, event_id AS id, ts, event_type, hash_k % 7 AS who_k,
      CASE WHEN hash_k % 7 < 6 THEN list_extract(['pm', 'domain', 'data_engineer', 'data_scientist', 'developer', 'storyteller'], hash_k % 7 + 1) END AS agent,
      CASE WHEN event_id % 3 > 0 THEN 'c' || (event_id * 31 % 17) END AS call_id
    FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) % 1000 AS hash_k FROM events)),
    rec AS (SELECT run_id, id AS comm_no, agent, CASE WHEN id % 4 = 1 THEN call_id END AS call_id, ts AS opened_at,
      CASE WHEN id % 9 > 0 THEN ts + (id * 7919 % 400) * INTERVAL 1 HOUR END AS closed_at FROM base WHERE event_type = 'signup'),
    ev AS (SELECT run_id, id, ts, agent, call_id FROM base WHERE event_type = 'error')"""


@query(
    "asof_correlation",
    f"""WITH RECURSIVE {_CALLS},
    met AS (SELECT e.run_id, e.id, e.agent AS e_agent, e.call_id AS e_call, r.* EXCLUDE (run_id) FROM ev e JOIN rec r
      ON r.run_id = e.run_id AND r.opened_at <= e.ts AND (r.closed_at IS NULL OR r.closed_at > e.ts)),
    routes AS (SELECT run_id, id, arg_max(comm_no, (opened_at, comm_no)) FILTER (call_id = e_call) AS own,
      arg_max(comm_no, (opened_at, comm_no)) FILTER (agent = e_agent) AS of_agent, CASE WHEN count(*) = 1 THEN max(comm_no) END AS alone FROM met GROUP BY 1, 2),
    led AS (SELECT e.*, own, coalesce(of_agent, alone) AS led, r.closed_at AS until,
      row_number() OVER (PARTITION BY e.run_id, e.call_id, own IS NULL ORDER BY e.ts, e.id) AS place
      FROM ev e LEFT JOIN routes USING (run_id, id) LEFT JOIN rec r ON r.run_id = e.run_id AND r.comm_no = coalesce(of_agent, alone)),
    chain AS (
      SELECT run_id, call_id, place, id, led AS comm_no, until FROM led WHERE call_id IS NOT NULL AND own IS NULL AND place = 1
      UNION ALL
      SELECT n.run_id, n.call_id, n.place, n.id, CASE WHEN c.comm_no IS NOT NULL AND (c.until IS NULL OR c.until > n.ts) THEN c.comm_no ELSE n.led END,
        CASE WHEN c.comm_no IS NOT NULL AND (c.until IS NULL OR c.until > n.ts) THEN c.until ELSE n.until END
      FROM chain c JOIN led n ON n.run_id = c.run_id AND n.call_id = c.call_id AND n.place = c.place + 1 AND n.own IS NULL
    )
    SELECT l.run_id, l.id, CASE WHEN l.call_id IS NULL THEN l.led ELSE coalesce(l.own, c.comm_no) END AS comm_no
    FROM led l LEFT JOIN chain c ON c.run_id = l.run_id AND c.id = l.id""",
)
def asof_correlation(t):
    """Records that open and close independently; call ids come again and some records have one."""
    from millrace.catalog.fixtures import AGENTS

    k = (F.floor(F.col("value") * 100).cast("long") % 1000 % 7).cast("int")
    agent = F.when(k < 6, F.element_at(F.array(*map(F.lit, AGENTS)), F.least(k, F.lit(5)) + 1))
    call = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("c"), (F.col("event_id") * 31 % 17).cast("string")))
    base = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), "ts", "event_type", agent.alias("agent"), call.alias("call_id"))
    hours = F.make_dt_interval(hours=(F.col("id") * 7919 % 400).cast("int"))
    records = base.where("event_type = 'signup'").select(
        "run_id", F.col("id").alias("comm_no"), "agent", F.when(F.col("id") % 4 == 1, F.col("call_id")).alias("call_id"),
        F.col("ts").alias("opened_at"), F.when(F.col("id") % 9 > 0, F.col("ts") + hours).alias("closed_at"),
    )
    return runlog.correlate(base.where("event_type = 'error'"), records)


_STEP_NAMES = "steps AS (SELECT unnest([" + ", ".join(f"'{n}'" for _, n, _ in dimensions.SUBSTEPS) + "]) AS name, unnest([" + ", ".join(f"'{s}'" for s, _, _ in dimensions.SUBSTEPS) + "]) AS substep, unnest([" + ", ".join(f"'{o}'" for _, _, o in dimensions.SUBSTEPS) + "]) AS owner, unnest(range(24)) AS position)"


def _named_substeps(t):
    """Trace events with the sub-step as its dotted name."""
    names = F.array(*[F.lit(s) for s, _, _ in dimensions.SUBSTEPS])
    return trace_events(t).withColumn("substep", F.element_at(names, F.col("substep") + 1))


@query(
    "dimension_lookup",
    f"""{_TRACE}, {_STEP_NAMES} SELECT t.id, s.name AS step_name, CASE agent WHEN 'pm' THEN 'Project Manager' WHEN 'domain' THEN 'Domain Expert' WHEN 'data_engineer' THEN 'Data Engineer'
      WHEN 'data_scientist' THEN 'Data Scientist' ELSE agent END AS agent_label FROM trace t JOIN steps s ON s.position = t.substep""",
)
def dimension_lookup(t):
    """Some agents are left out of the label table, so the key itself must show."""
    known = [(a, l) for a, l in runlog.AGENT_LABELS.items() if a not in ("developer", "storyteller")]
    labels = t.spark.createDataFrame(known, "agent string, label string")
    named = dimensions.lookup(_named_substeps(t), "substep", dimensions.substep_dimension(t.spark), "substep", "name", "step_name")
    return dimensions.lookup(named, "agent", labels, "agent", "label", "agent_label").select("id", "step_name", "agent_label")


@query(
    "process_view",
    f"""{_TRACE}, {_STEP_NAMES}, {_FACTS}, runs AS (SELECT run_id, arg_max(substep, ts) AS at FROM trace GROUP BY 1),
    g AS (SELECT r.run_id, r.at, s.* FROM runs r, steps s)
    SELECT g.run_id, g.substep, g.owner, CASE WHEN g.position = g.at THEN 'active' WHEN f.ended THEN 'done' WHEN g.position < g.at THEN 'done' ELSE 'pending' END AS status, f.duration_ms
    FROM g LEFT JOIN facts f ON f.run_id = g.run_id AND f.substep = g.position""",
)
def process_view(t):
    events = _named_substeps(t)
    runs = events.groupBy("run_id").agg(F.max_by("substep", F.struct("ts", "id")).alias("current_substep"))
    return runlog.process_view(runs, events, dimensions.substep_dimension(t.spark))


@query(
    "resolve_agent",
    f"""{_TRACE} SELECT id, CASE WHEN type = 'exception' THEN 'pm' WHEN type = 'llm.start' THEN 'helper' WHEN type = 'llm.end' THEN 'developer' ELSE agent END AS who FROM trace""",
)
def resolve_agent(t):
    events = trace_events(t)
    roles = {label: agent for agent, label in runlog.AGENT_LABELS.items()}
    role = F.when(F.col("type") == "exception", "Project Manager")
    name = F.when(F.col("type") == "llm.start", "helper").when(F.col("type") == "llm.end", "Developer")
    who = runlog.resolve_agent(list(runlog.AGENT_LABELS), roles, role, name, F.col("agent"))
    return events.select("id", who.alias("who"))


_ATT = f"WITH {ATTEMPTS}"


@query(
    "attempt_stats",
    f"""{_ATT}, a AS (SELECT *, label = 'error' AS malformed FROM attempts)
    SELECT 'counted' AS policy, run_id, count(*) AS attempts, count(*) FILTER (malformed OR NOT coalesce(ok, false)) AS failures FROM a GROUP BY 2
    UNION ALL SELECT 'skipped', run_id, count(*), count(*) FILTER (NOT coalesce(ok, false)) FROM a WHERE NOT malformed GROUP BY 2""",
)
def attempt_stats(t):
    log = attempts(t).withColumn("malformed", F.col("label") == "error")
    counted = runlog.attempt_stats(log, True).withColumn("policy", F.lit("counted"))
    return counted.unionByName(runlog.attempt_stats(log, False).withColumn("policy", F.lit("skipped")))


@query(
    "attempt_highlights",
    f"""{_ATT}, m AS (SELECT label, seq, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS rk FROM attempts WHERE NOT coalesce(ok, false))
    SELECT a.label, count(*) AS attempts, max(seq) FILTER (ok) AS winner_seq, (SELECT string_agg(seq, ',' ORDER BY seq) FROM m WHERE m.label = a.label AND rk <= 3) AS near_miss_seqs
    FROM attempts a GROUP BY a.label""",
)
def attempt_highlights(t):
    return runlog.attempt_highlights(attempts(t)).withColumn("near_miss_seqs", F.array_join("near_miss_seqs", ","))


@query(
    "winning_attempt",
    f"{_ATT} SELECT run_id, substep, max(seq) AS seq, arg_max(label, seq) AS label FROM attempts WHERE ok GROUP BY 1, 2",
)
def winning_attempt(t):
    return runlog.winning_attempt(attempts(t), ["run_id", "substep"]).select("run_id", "substep", "seq", "label")


@query("failed_attempts", f"{_ATT} SELECT run_id, substep, label, seq FROM attempts WHERE NOT coalesce(ok, false)")
def failed_attempts(t):
    return runlog.failed_attempts(attempts(t), ["run_id", "substep", "label", "seq"])


@query(
    "substep_debug_union",
    f"""{_TRACE}, {ATTEMPTS} SELECT 'event' AS kind, run_id, CAST(id AS VARCHAR) AS id, ts FROM trace WHERE substep = 7
    UNION ALL SELECT 'attempt', run_id, CAST(seq AS VARCHAR), ts FROM attempts WHERE substep = 7
    UNION ALL SELECT 'communication', run_id, CAST(id AS VARCHAR), ts FROM trace WHERE type = 'llm.end' AND substep = 7""",
)
def substep_debug_union(t):
    events = trace_events(t)
    return runlog.substep_debug(
        7, events.where("type = 'llm.end'"), events, attempts(t).withColumn("id", F.col("seq"))
    )


@query(
    "learnable_runs",
    """SELECT o_orderkey, NOT (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AS learnable FROM orders""",
)
def learnable_runs(t):
    reason = F.when(F.col("o_orderstatus") == "P", "LLM said: Error code: 400 (bad)").when(F.col("o_orderpriority") == "5-LOW", "Train file NOT FOUND: x")
    return t.orders.select("o_orderkey", runlog.is_learnable(reason).alias("learnable"))


@query("owner_scan", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def owner_scan(t):
    owners = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("user_id"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("task_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return runlog.owned_by(rows, owners, "P").withColumnRenamed("task_id", "l_orderkey")


@query("first_occurrence", f"{_TRACE} SELECT run_id, substep, min(ts) AS ts, arg_min(id, ts) AS id FROM trace WHERE type = 'substep.dispatch' GROUP BY 1, 2")
def first_occurrence(t):
    dispatched = trace_events(t).where("type = 'substep.dispatch'").select("run_id", "substep", "ts", "id")
    return runlog.first_occurrence(dispatched, ["run_id", "substep"], ["ts", "id"])


@query(
    "recent_n",
    f"""{_TRACE} SELECT run_id, type, id, CAST(rk AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY ts DESC, id DESC) AS rk FROM trace) WHERE rk <= 3""",
)
def recent_n(t):
    return runlog.recent_per_group(trace_events(t), ["run_id", "type"], 3).select("run_id", "type", "id", "recency")


_MANIFEST = """manifest AS (SELECT c_custkey AS run_id, CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2023-12-01' END AS started_at,
      CASE WHEN c_acctbal > 4000 THEN TIMESTAMP '2023-12-02' END AS ended_at, CASE WHEN c_acctbal > 8000 THEN 5::BIGINT END AS duration_ms FROM customer),
    tr AS (SELECT run_id, min(ts) AS t0, max(ts) AS t1, CAST(trunc(arg_max(ts_mono_ms, ts)) AS BIGINT) AS ms FROM trace GROUP BY 1),
    timing AS (SELECT m.run_id, coalesce(t0, started_at) AS started_at, coalesce(t1, ended_at, TIMESTAMP '2023-12-03') AS ended_at,
      coalesce(ms, duration_ms, epoch_ms(coalesce(t1, ended_at, TIMESTAMP '2023-12-03')) - epoch_ms(coalesce(t0, started_at))) AS duration_ms
      FROM manifest m LEFT JOIN tr ON tr.run_id = m.run_id)"""


def _timing(t):
    def stamp(text):
        return F.lit(text).cast("timestamp_ntz")

    balance = F.col("c_acctbal")
    manifest = t.customer.select(
        F.col("c_custkey").alias("run_id"), F.when(balance > 0, stamp("2023-12-01")).alias("started_at"),
        F.when(balance > 4000, stamp("2023-12-02")).alias("ended_at"), F.when(balance > 8000, F.lit(5).cast("long")).alias("duration_ms"),
    )
    reports = t.customer.select(
        F.col("c_custkey").alias("run_id"), F.lit(None).cast("timestamp_ntz").alias("started_at"),
        stamp("2023-12-03").alias("ended_at"), F.lit(None).cast("long").alias("duration_ms"),
    )
    return manifest, runlog.run_timing(manifest, trace_events(t), reports)


@query("run_elapsed", f"{_TRACE}, {_MANIFEST} SELECT * FROM timing")
def run_elapsed(t):
    return _timing(t)[1]


@query(
    "timing_backfill",
    f"""{_TRACE}, {_MANIFEST} SELECT m.run_id, coalesce(t.started_at, m.started_at) AS started_at, coalesce(t.ended_at, m.ended_at) AS ended_at, coalesce(t.duration_ms, m.duration_ms) AS duration_ms,
      concat_ws(',', CASE WHEN t.started_at IS NOT NULL AND t.started_at IS DISTINCT FROM m.started_at THEN 'started_at' END,
        CASE WHEN t.ended_at IS NOT NULL AND t.ended_at IS DISTINCT FROM m.ended_at THEN 'ended_at' END,
        CASE WHEN t.duration_ms IS NOT NULL AND t.duration_ms IS DISTINCT FROM m.duration_ms THEN 'duration_ms' END) AS changed
    FROM manifest m JOIN timing t ON t.run_id = m.run_id""",
)
def timing_backfill(t):
    manifest, timing = _timing(t)
    return runlog.timing_backfill(manifest, timing).withColumn("changed", F.array_join("changed", ","))


@query(
    "completed_substeps",
    f"""{_TRACE}, l AS (SELECT run_id, count(DISTINCT CASE WHEN type = 'substep.end' THEN substep END) AS n FROM trace GROUP BY 1)
    SELECT c_custkey AS run_id, greatest(coalesce(n, 0), c_nationkey) AS completed, CASE WHEN coalesce(n, 0) > c_nationkey THEN 'trace' ELSE 'counter' END AS source
    FROM customer LEFT JOIN l ON run_id = c_custkey""",
)
def completed_substeps(t):
    counters = t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").cast("long").alias("completed"))
    return runlog.completed_substeps(trace_events(t), counters)


@query("loop_counts", f"{_TRACE} SELECT run_id, chr(CAST(65 + substep % 4 AS INTEGER)) AS label, count(*) AS n FROM trace WHERE type = 'exception' GROUP BY 1, 2")
def loop_counts(t):
    loops = trace_events(t).where("type = 'exception'").withColumn("label", F.char(65 + F.col("substep") % 4))
    return runlog.loop_counts(loops)


@query(
    "loop_union",
    f"""{_TRACE} SELECT run_id, agent AS label, type AS reason, ts, 'trace' AS origin FROM trace WHERE type = 'exception'
    UNION ALL SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderdate, 'snapshot' FROM orders WHERE o_orderstatus = 'P'""",
)
def loop_union(t):
    snapshot = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("ts")
    )
    events = trace_events(t).select(
        "run_id", F.col("agent").alias("label"), F.col("type").alias("reason"), "ts", F.when(F.col("type") == "exception", "loop").otherwise(F.col("type")).alias("type")
    )
    return runlog.loop_union(snapshot, events)


@query(
    "dotted_sort",
    f"""SELECT p_partkey, row_number() OVER (ORDER BY p_size, a) AS place FROM (SELECT *, CAST(substr(p_brand, 7) AS INTEGER) * 100000 + p_partkey AS a FROM part)""",
)
def dotted_sort(t):
    """Place of every part when its dotted name is sorted number by number."""
    from millrace.plans.scan import ordered_scan, row_number

    name = F.concat_ws(".", F.col("p_size").cast("string"), F.substring("p_brand", 7, 9), F.col("p_partkey").cast("string"))
    parts = t.part.select("p_partkey", runlog.dotted_order(name).alias("k"))
    return ordered_scan(parts, [], ["k"], {"place": row_number()}).select("p_partkey", "place")


@query(
    "conclusion_join",
    f"""{_TRACE}, {ATTEMPTS}, w AS (SELECT run_id, substep, max(seq) AS seq FROM attempts WHERE ok GROUP BY 1, 2),
    c AS (SELECT run_id, substep, max(id) AS conclusion FROM trace WHERE type = 'substep.end' GROUP BY 1, 2)
    SELECT c.run_id, CAST(c.substep AS VARCHAR) AS substep, conclusion, seq FROM c LEFT JOIN w ON w.run_id = c.run_id AND w.substep = c.substep""",
)
def conclusion_join(t):
    conclusions = trace_events(t).where("type = 'substep.end'").groupBy("run_id", F.col("substep").cast("string").alias("substep")).agg(F.max("id").alias("conclusion"))
    scripts = runlog.winning_attempt(attempts(t).withColumn("substep", F.col("substep").cast("string")), ["run_id", "substep"])
    return runlog.join_conclusions(conclusions, scripts.select("run_id", "substep", "seq"))


@query(
    "decision_chain",
    f"""{_TRACE}, {_STEP_NAMES}, r AS (SELECT t.run_id, s.substep, t.id, row_number() OVER (PARTITION BY t.run_id, s.substep ORDER BY ts, id) AS rk FROM trace t JOIN steps s ON s.position = t.substep
      WHERE type = 'llm.end' AND s.substep IN ('1.1', '1.3', '2.4', '3.1', '3.5', '4.1', '4.4', '5.1', '5.3', '6.1'))
    SELECT run_id, substep, id, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 3""",
)
def decision_chain(t):
    records = _named_substeps(t).withColumn("closed", F.col("type") == "llm.end")
    return runlog.decision_chain(records).select("run_id", "substep", "id", "rank")


@query(
    "run_catalog_latest",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rk FROM orders)
    SELECT o_custkey AS case_id, max(o_orderkey) FILTER (rk = 1) AS latest, max(o_orderkey) FILTER (rk = 2) AS previous FROM r GROUP BY 1""",
)
def run_catalog_latest(t):
    runs = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ended_at"))
    return runlog.latest_and_previous(runs, "case_id", ["ended_at", "run_id"])


@query("previous_run", "SELECT o_custkey AS case_id, o_orderkey AS run_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_run FROM orders")
def previous_run(t):
    runs = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ended_at"))
    return runlog.with_previous_run(runs, "case_id", ["ended_at", "run_id"]).select("case_id", "run_id", "previous_run")


@query(
    "run_fact_row",
    f"""WITH {STATES}, {ATTEMPTS}, {TRACE_EVENTS},
    a AS (SELECT run_id, count(*) AS attempts, count(*) FILTER (NOT coalesce(ok, false)) AS failures FROM attempts GROUP BY 1),
    s AS (SELECT run_id, count(DISTINCT CASE WHEN type = 'substep.end' THEN substep END) AS completed, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, max(ts) AS ended_at FROM trace GROUP BY 1)
    SELECT st.run_id, chosen_model IS NOT NULL AND submission_path IS NOT NULL AND coalesce(meets, false) AS ml_success,
      halted AND phase = 6 AND substep = '6.4' AS workflow_complete, attempts, failures, completed, tokens, ended_at
    FROM states st LEFT JOIN a ON a.run_id = st.run_id LEFT JOIN s ON s.run_id = st.run_id""",
)
def run_fact_row(t):
    events = trace_events(t)
    flags = contracts.outcome_flags(states(t)).drop("deficits")
    tries = runlog.attempt_stats(attempts(t).withColumn("malformed", F.lit(False)))
    log = events.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("type") == "substep.end", F.col("substep"))).alias("completed"),
        F.sum(F.floor("value").cast("long")).alias("tokens"), F.max("ts").alias("ended_at"),
    )
    return runlog.run_facts(flags, tries, log)
