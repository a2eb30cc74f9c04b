"""Streaming jobs over the event table written as JSON files; the oracle is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.fixtures import SPEND, TRACE_EVENTS, spend, trace_events
from millrace.catalog.registry import query
from millrace.session import shared_folder
from millrace.sources import jsonlines
from millrace.streaming import keyed, live

_COLUMNS = ["run_id", "id", "ts", "ts_mono_ms", "type", "substep", "agent", "value"]
FILES = 3
#: State rows of the registry, of one or a few thousand records each.
GROUPS = 4096


def _in_order(rows, order: str, folder: str):
    """Write rows as JSON-lines files that arrive one after another, each with a later part of ``order``."""
    place = F.unix_micros(F.col(order).cast("timestamp")) if order == "ts" else F.col(order)
    low, high = rows.agg(F.min(place), F.max(place)).first()
    cuts = [low + (high - low) * i // FILES for i in range(FILES)] + [high + 1]
    for a, b in zip(cuts, cuts[1:]):
        jsonlines.append(rows.where((place >= a) & (place < b)).coalesce(1), folder)


def _log(t, folder: str, part: str | None = None):
    """Write the trace events as a few JSON-lines files in time order."""
    events = trace_events(t).select(*_COLUMNS)
    if part is not None:
        events = events.where(part)
    jsonlines.append(events.repartitionByRange(FILES, "ts"), folder)


@query("stream_ingest", f"WITH {TRACE_EVENTS} SELECT id, run_id, type, ts FROM trace")
def stream_ingest(t):
    root = shared_folder(t.spark, "ingest")
    _log(t, f"{root}/log")
    stream = live.event_stream(t.spark, f"{root}/log", files_per_batch=1)
    live.append_available(stream, f"{root}/out", f"{root}/cursor")
    return t.spark.read.parquet(f"{root}/out").select("id", "run_id", "type", "ts")


@query("stream_resume", f"WITH {TRACE_EVENTS} SELECT type, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM trace GROUP BY 1")
def stream_resume(t):
    """The log grows between two runs of the job; every event is taken once."""
    root = shared_folder(t.spark, "resume")
    for part in ("type in ('exception', 'llm.start')", "type not in ('exception', 'llm.start')"):
        _log(t, f"{root}/log", part)
        live.append_available(live.event_stream(t.spark, f"{root}/log"), f"{root}/out", f"{root}/cursor")
    rows = t.spark.read.parquet(f"{root}/out")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query(
    "live_summary",
    f"""WITH {TRACE_EVENTS} SELECT run_id, count(*) AS n_events, CAST(count(DISTINCT CASE WHEN type = 'substep.end' THEN substep END) AS INTEGER) AS completed, arg_max(substep, ts) AS last_substep,
      arg_max(type, ts) AS last_type, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS elapsed_ms FROM trace GROUP BY 1""",
)
def live_summary(t):
    root = shared_folder(t.spark, "summary")
    _log(t, f"{root}/log")
    sink = live.SnapshotSink(t.spark, f"{root}/out", ["run_id"])
    stream = live.event_stream(t.spark, f"{root}/log", files_per_batch=1)
    live.run_available(live.live_summary(stream), sink, f"{root}/cursor")
    return live.with_elapsed(sink.latest()).drop("started_at", "last_at")


_MESSAGES = """m AS (SELECT o_custkey * 10 + length(o_orderpriority) AS comm_id, (o_custkey * 10 + length(o_orderpriority)) % 50 AS run_id, o_orderstatus AS s, o_orderkey AS pos,
      CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS model, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS tokens FROM orders),
    c AS (SELECT comm_id, min(pos) FILTER (s = 'F') AS closed_at FROM m GROUP BY 1),
    r AS (SELECT comm_id, any_value(run_id) AS run_id, min(pos) FILTER (s = 'O') AS opened_at, arg_max(model, pos) FILTER (model IS NOT NULL) AS model, arg_max(tokens, pos) FILTER (tokens IS NOT NULL) AS tokens,
      any_value(closed_at) AS closed_at, CASE WHEN any_value(closed_at) IS NULL THEN 'open' ELSE 'closed' END AS status FROM m JOIN c USING (comm_id) WHERE closed_at IS NULL OR pos <= closed_at GROUP BY 1)"""


def _registry(t, label: str):
    """Orders as open, enrich and close messages of communication records, through the registry stream."""
    root = shared_folder(t.spark, label)
    status = F.col("o_orderstatus")
    messages = t.orders.select(
        (F.col("o_custkey") * 10 + F.length("o_orderpriority")).alias("comm_id"), ((F.col("o_custkey") * 10 + F.length("o_orderpriority")) % 50).alias("run_id"),
        F.when(status == "O", "open").when(status == "P", "enrich").otherwise("close").alias("action"), F.col("o_orderkey").alias("at"),
        F.when(status == "P", F.col("o_orderpriority")).alias("model"), F.when(status == "F", F.floor("o_totalprice").cast("long")).alias("tokens"),
    )
    _in_order(messages, "at", f"{root}/log")
    schema = "comm_id long, run_id long, action string, at long, model string, tokens long"
    changes = keyed.registry_stream(live.event_stream(t.spark, f"{root}/log", schema, 1), groups=GROUPS)
    sink = live.SnapshotSink(t.spark, f"{root}/out", ["comm_id"])
    exported = live.SnapshotSink(t.spark, f"{root}/closed", ["comm_id", "closed_at"], keep="first")
    live.run_available(changes, sink, f"{root}/cursor", {"status = 'closed'": exported}, by_clock=True)
    return sink, exported


@query("open_close_stream", f"WITH {_MESSAGES} SELECT *, CASE WHEN closed_at IS NULL THEN 0 ELSE 1 END AS exports FROM r")
def open_close_stream(t):
    """The newest state of every record, and how often it was exported: once, when it closed."""
    sink, exported = _registry(t, "records")
    times = exported.current().groupBy("comm_id").agg(F.count(F.lit(1)).cast("int").alias("exports"))
    return sink.current().join(times, "comm_id", "left").withColumn("exports", F.coalesce("exports", F.lit(0)))


@query(
    "in_flight",
    f"""WITH {_MESSAGES} SELECT run_id, arg_max(comm_id, (opened_at, comm_id)) FILTER (status = 'open') AS in_flight, count(*) FILTER (status = 'open') AS n_in_flight,
      arg_max(comm_id, (opened_at, comm_id)) AS last_comm, arg_max(struct_pack(v := tokens), (opened_at, comm_id)).v AS last_tokens FROM r WHERE opened_at IS NOT NULL GROUP BY 1""",
)
def in_flight(t):
    """The communication in flight and the last one of every run."""
    return keyed.communications_view(_registry(t, "in-flight")[0].current())


CAP = 4000
AGENT_CAPS = {"pm": 900, "developer": 700, "domain": 10**6}


@query(
    "budget_guard_stream",
    f"""WITH {SPEND} SELECT run_id, CAST(sum(tokens) AS BIGINT) AS spent, sum(tokens) >= {CAP} * 0.8 AS soft, sum(tokens) >= {CAP} AS halt, CASE WHEN sum(tokens) >= {CAP} * 0.8 THEN 1 ELSE 0 END AS alerts FROM spend GROUP BY 1""",
)
def budget_guard_stream(t):
    """Totals after each batch; a run that crossed the soft limit has exactly one alert."""
    root = shared_folder(t.spark, "budget")
    jsonlines.append(spend(t).drop("started_at").repartitionByRange(FILES, "seq"), f"{root}/log")
    sink = live.SnapshotSink(t.spark, f"{root}/out", ["run_id"])
    first = live.SnapshotSink(t.spark, f"{root}/alerts", ["run_id"], keep="first")
    stream = live.event_stream(t.spark, f"{root}/log", "run_id long, agent string, seq long, tokens long", 1)
    live.run_available(live.budget_flags(live.run_spend(stream), CAP), sink, f"{root}/cursor", {"soft": first})
    alerts = first.current().groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("alerts"))
    return sink.current().join(alerts, "run_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


@query(
    "agent_budget_stream",
    f"""WITH {SPEND}, c AS (SELECT unnest({list(AGENT_CAPS)}) AS agent, unnest({list(AGENT_CAPS.values())})::BIGINT AS cap)
    SELECT run_id, agent, CAST(sum(tokens) AS BIGINT) AS spent, any_value(cap) AS cap, coalesce(sum(tokens) >= any_value(cap), false) AS over FROM spend LEFT JOIN c USING (agent) GROUP BY 1, 2""",
)
def agent_budget_stream(t):
    root = shared_folder(t.spark, "agent-budget")
    jsonlines.append(spend(t).drop("started_at").repartitionByRange(FILES, "seq"), f"{root}/log")
    sink = live.SnapshotSink(t.spark, f"{root}/out", ["run_id", "agent"])
    stream = live.event_stream(t.spark, f"{root}/log", "run_id long, agent string, seq long, tokens long", 1)
    live.run_available(live.agent_flags(live.run_spend(stream, ("run_id", "agent")), AGENT_CAPS), sink, f"{root}/cursor")
    return sink.current()


DEADLINE_MS = 2_500_000_000


@query(
    "deadline_guard",
    f"""WITH {TRACE_EVENTS}, e AS (SELECT run_id, ts, id, type = 'substep.end' AND substep = 23 AS ended FROM trace),
    r AS (SELECT run_id, min(ts) AS started_at, count(*) AS n_all, min(ts) FILTER (ended) AS end_at FROM e GROUP BY 1),
    w AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS mark FROM e)
    SELECT run_id, epoch_us(started_at) // 1000 + {DEADLINE_MS} AS deadline_ms FROM r, w
    WHERE (end_at IS NULL OR epoch_us(end_at) // 1000 - epoch_us(started_at) // 1000 >= {DEADLINE_MS}) AND epoch_us(started_at) // 1000 + {DEADLINE_MS} <= mark""",
)
def deadline_guard(t):
    """Runs that a timer of the stream halts; a run that comes to its last sub-step in time is finished."""
    root = shared_folder(t.spark, "deadline")
    _in_order(trace_events(t).select(*_COLUMNS), "ts", f"{root}/log")
    stream = live.event_stream(t.spark, f"{root}/log", files_per_batch=1)
    ended = (F.col("type") == "substep.end") & (F.col("substep") == 23)
    sink = live.SnapshotSink(t.spark, f"{root}/out", ["run_id", "status"], keep="first")
    live.run_available(keyed.deadline_stream(stream, DEADLINE_MS, ended, remember_ms=2 * DEADLINE_MS), sink, f"{root}/cursor")
    halted = sink.current().where("status = 'halted'")
    return halted.select("run_id", F.unix_millis(F.col("deadline_at").cast("timestamp")).alias("deadline_ms"))


@query(
    "deadline_flags",
    f"""WITH {TRACE_EVENTS} SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS elapsed_ms, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 >= 2500000000 AS halt,
      (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(ts))) // 1000 >= 2590000000 AS silent_halt FROM trace GROUP BY 1""",
)
def deadline_flags(t):
    """The same rule over a whole log, up to the last event and up to a given moment."""
    summary = live.live_summary(trace_events(t))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    silent = live.deadline_flags(summary, 2_590_000_000, now).select("run_id", F.col("halt").alias("silent_halt"))
    return live.deadline_flags(summary, 2_500_000_000).join(silent, "run_id")


@query(
    "run_caps",
    f"""WITH {TRACE_EVENTS}, v AS (SELECT run_id, substep % 6 AS phase, count(*) AS visits, count(*) FILTER (type = 'exception') AS inner_n FROM trace WHERE type IN ('exception', 'substep.dispatch') GROUP BY 1, 2),
    r AS (SELECT run_id, CAST(sum(visits) AS BIGINT) AS transitions, max(visits) AS most_visits, CAST(sum(inner_n) AS BIGINT) AS inner_loops FROM v GROUP BY 1)
    SELECT *, transitions >= 12 OR most_visits > 3 OR inner_loops > 3 AS halt FROM r""",
)
def run_caps(t):
    root = shared_folder(t.spark, "caps")
    _log(t, f"{root}/log", "type in ('exception', 'substep.dispatch')")
    stream = live.event_stream(t.spark, f"{root}/log", files_per_batch=1)
    transitions = stream.select("run_id", (F.col("substep") % 6).alias("phase"), F.when(F.col("type") == "exception", "B").alias("label"))
    sink = live.SnapshotSink(t.spark, f"{root}/out", ["run_id", "phase"])
    live.run_available(live.phase_visits(transitions), sink, f"{root}/cursor")
    return live.cap_flags(sink.latest())
