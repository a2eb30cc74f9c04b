"""Analytics over run logs: events, spans, agents, attempts and communications.

Event tables have ``run_id, id, ts, ts_mono_ms, type`` and optional ``agent``, ``substep`` and
``communication_id``. The order inside a run is ``(ts, id)``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import elapsed_ms
from millrace.plans.openset import newest_open
from millrace.plans.scan import HOT_ROWS, following, largest_group, last, ordered_scan, previous, running_sum
from millrace.session import cut_lineage

# Vocabulary of the logs.
TIMELINE_TYPES = [
    "run.start",
    "run.end",
    "phase.transition",
    "substep.dispatch",
    "substep.end",
    "agent.activate",
    "agent.complete",
    "crew.start",
    "crew.end",
    "task.start",
    "task.end",
    "tool.start",
    "tool.end",
    "llm.start",
    "llm.end",
    "python.subprocess",
    "flow.start",
    "flow.end",
    "branch",
    "loop",
    "exception",
]
AGENT_LABELS = {
    "pm": "Project Manager",
    "domain": "Domain Expert",
    "data_engineer": "Data Engineer",
    "data_scientist": "Data Scientist",
    "developer": "Developer",
    "storyteller": "Storyteller",
}
INFRASTRUCTURE_MARKS = [
    "preflight",
    "train file not found",
    "not found or not a file",
    "reasoning_effort",
    "unsupported value",
    "error code: 400",
    "invalid_request_error",
]
PRIORITY_SUBSTEPS = ["1.1", "1.3", "2.4", "3.1", "3.5", "4.1", "4.4", "5.1", "5.3", "6.1"]
NEAR_MISSES = 3
LOG_MESSAGE_CHARS = 200

ORDER = ["ts", "id"]
def _at() -> Column:
    return F.struct("ts", "id")


def timeline(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").isin(TIMELINE_TYPES))


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows in log order."""
    return events.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def since(events: DataFrame, since_id) -> DataFrame:
    """Rows strictly after the row with ``since_id``; an unknown id gives everything."""
    cursor = events.where(F.col("id") == since_id).agg(F.max(_at()).alias("at")).scalar()
    return events.where(F.coalesce(_at() > cursor, F.lit(True)))


def span_pairs(events: DataFrame, span: list[str], copied: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """End rows with duration and with the attributes their start row had.

    ``events`` has ``is_start``. An end belongs to the row right before it in its span when
    that row is a start; otherwise it has no start and no duration.
    """
    before = F.struct("is_start", "ts", F.col("id").alias("start_id"), *copied)
    scanned = ordered_scan(events, span, ORDER, {"__before": previous(before)}, hot_rows)
    opened = F.coalesce(F.col("__before.is_start"), F.lit(False))
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("__before.ts").cast("timestamp"))
    return scanned.where(~F.col("is_start")).select(
        *span,
        "id",
        F.when(opened, F.col("__before.start_id")).alias("start_id"),
        F.when(opened, elapsed / 1000.0).alias("duration_ms"),
        *[F.coalesce(F.col(c), F.when(opened, F.col(f"__before.{c}"))).alias(c) for c in copied],
    )


def substep_facts(events: DataFrame) -> DataFrame:
    """Per run and sub-step: dispatched, ended, skipped, and whole milliseconds from last dispatch to last end."""

    def mono(kind: str) -> Column:
        return F.max_by("ts_mono_ms", F.when(F.col("type") == kind, _at()))

    facts = (
        events.where(F.col("type").isin("substep.dispatch", "substep.end", "branch") & F.col("substep").isNotNull())
        .groupBy("run_id", "substep")
        .agg(
            F.bool_or(F.col("type") == "substep.dispatch").alias("dispatched"),
            F.bool_or(F.col("type") == "substep.end").alias("ended"),
            F.bool_or(F.col("type") == "branch").alias("skipped"),
            mono("substep.dispatch").alias("__from"),
            mono("substep.end").alias("__to"),
        )
    )
    duration = (F.col("__to") - F.col("__from")).cast("long")
    return facts.select("run_id", "substep", "dispatched", "ended", "skipped", duration.alias("duration_ms"))


def resolve_agent(known: list[str], roles: dict[str, str], role: Column, *names: Column) -> Column:
    """Agent id of an event: a known role wins, then the first known or free-standing name."""
    by_role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    choices = [F.try_element_at(by_role, role)]
    for name in names:
        choices.append(F.when(name.isin(known), name).otherwise(F.coalesce(F.try_element_at(by_role, name), name)))
    return F.coalesce(*choices)


def with_current_agent(events: DataFrame, hot_rows: int = HOT_ROWS, at_most: int | None = None) -> DataFrame:
    """Add ``current_agent``: the agent last dispatched or activated in the run so far."""
    setter = F.when(F.col("type").isin("substep.dispatch", "agent.activate"), F.col("agent"))
    return ordered_scan(events, ["run_id"], ORDER, {"current_agent": last(setter)}, hot_rows, at_most)


def agent_states(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Final state of every agent seen in a run: idle, active, done or error.

    A dispatch makes its agent active and any other active agent done. So an agent that is
    active after its own last change is done when another agent was dispatched later.
    """
    current = with_current_agent(events, hot_rows)
    kind, agent, active = F.col("type"), F.col("agent"), F.col("current_agent")
    state = (
        F.when(kind.isin("substep.dispatch", "agent.activate") & agent.isNotNull(), "active")
        .when(kind.isin("agent.complete", "substep.end"), "done")
        .when(kind == "exception", "error")
    )
    changed = (
        F.when(kind.isin("substep.dispatch", "agent.activate"), agent)
        .when(kind == "agent.complete", F.coalesce(agent, active))
        .when(kind.isin("substep.end", "exception"), active)
    )
    rows = current.select(
        "run_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(agent.isNotNull(), F.struct(agent.alias("agent"), F.lit(None).cast("string").alias("state"), F.lit(False).alias("dispatch"))),
                    F.when(changed.isNotNull(), F.struct(changed.alias("agent"), state.alias("state"), (kind == "substep.dispatch").alias("dispatch"))),
                )
            )
        ).alias("c"),
        _at().alias("at"),
    ).select("run_id", "c.*", "at")
    own = rows.groupBy("run_id", "agent").agg(
        F.max_by("state", F.when(F.col("state").isNotNull(), F.col("at"))).alias("state"),
        F.max(F.when(F.col("state").isNotNull(), F.col("at"))).alias("changed_at"),
        F.max(F.when(F.col("dispatch"), F.col("at"))).alias("dispatched_at"),
    )
    # Latest dispatch per run, and the latest by any agent other than that one.
    first = own.groupBy("run_id").agg(F.max_by(F.struct("agent", "dispatched_at"), "dispatched_at").alias("top"))
    joined = own.join(first, "run_id")
    is_top = F.col("agent") == F.col("top.agent")
    second = (
        joined.where(~is_top).groupBy("run_id").agg(F.max("dispatched_at").alias("second_at"))
    )
    other = F.when(is_top, F.col("second_at")).otherwise(F.col("top.dispatched_at"))
    final = (
        F.when(F.col("state").isNull(), "idle")
        .when((F.col("state") == "active") & F.coalesce(other > F.col("changed_at"), F.lit(False)), "done")
        .otherwise(F.col("state"))
    )
    return joined.join(second, "run_id", "left").select("run_id", "agent", final.alias("state"))


def agent_edges(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges of the interaction graph: dispatches once per agent, calls one by one.

    A model call stays open (``animated``) unless the agent's next model event is its end.
    """
    biggest = largest_group(events, ["run_id"])
    current = with_current_agent(events, hot_rows, biggest)
    caller = F.coalesce("current_agent", "agent")
    calls = current.where(F.col("type").isin("llm.start", "llm.end")).withColumn("caller", caller)
    calls = ordered_scan(
        calls.where("caller is not null"), ["run_id", "caller"], ORDER, {"__next": following(F.col("type"))},
        hot_rows, biggest,
    )
    call_key = F.coalesce(F.col("communication_id").cast("string"), F.col("id").cast("string"))

    def edge(prefix: str, target: str, key: Column, open_: Column):
        return [
            "run_id",
            F.concat(F.lit(prefix + "-"), F.col("caller"), F.lit("-"), key).alias("edge_id"),
            F.col("caller").alias("source"),
            F.lit(target).alias("target"),
            open_.alias("animated"),
            F.struct("ts", "id").alias("__at"),
        ]

    still_open = ~F.coalesce(F.col("__next") == "llm.end", F.lit(False))
    model = calls.where("type = 'llm.start'").select(*edge("llm", "llm", call_key, still_open))
    others = current.withColumn("caller", caller).where("caller is not null")
    code = others.where("type = 'python.subprocess'").select(*edge("py", "python_exec", F.col("id").cast("string"), F.lit(False)))
    tool = others.where("type = 'tool.start'").select(*edge("tool", "tool", F.col("id").cast("string"), F.lit(False)))
    interactions = (
        model.unionByName(code)
        .unionByName(tool)
        .groupBy("run_id", "edge_id")
        .agg(
            F.min_by("source", "__at").alias("source"),
            F.min_by("target", "__at").alias("target"),
            F.bool_and("animated").alias("animated"),
        )
        .withColumn("edge_type", F.lit("interaction"))
    )
    dispatches = (
        events.where("type = 'substep.dispatch' and agent is not null")
        .select("run_id", F.col("agent").alias("target"))
        .distinct()
        .select(
            "run_id",
            F.concat(F.lit("dispatch-flow-"), "target").alias("edge_id"),
            F.lit("flow").alias("source"),
            "target",
            F.lit(False).alias("animated"),
            F.lit("dispatch").alias("edge_type"),
        )
    )
    return interactions.unionByName(dispatches)


def correlate(events: DataFrame, records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Communication record each event belongs to.

    ``events``: run_id, id, ts, agent, call_id. ``records``: run_id, comm_no, agent, call_id, opened_at,
    closed_at. Records open and close independently and may overlap. Routes in order: the newest open
    record with the event's call id; the record that an earlier event taught the call id, while it is
    open; the newest open record of the agent; the only record open in the run. An event with a call id
    teaches it to the record that its agent or the run leads to. An event that is led nowhere has NULL.
    """
    facts = records.select("run_id", "agent", "call_id", F.col("comm_no").alias("no"), "opened_at", "closed_at")
    asked = events.select("run_id", "agent", "call_id", "id", "ts")

    def route(by: list[str], name: str) -> DataFrame:
        found = newest_open(facts, asked, by, hot_rows).where("open_no IS NOT NULL")
        return found.select("run_id", "id", F.struct(F.col("open_no").alias("no"), F.col("open_until").alias("until")).alias(name))

    moves = facts.where("opened_at IS NOT NULL").select("run_id", F.lit(0).alias("rank"), F.col("no").alias("id"), F.col("opened_at").alias("ts"), F.lit(1).alias("step"))
    # A record that closes before it opens is never open.
    closes = facts.where("opened_at IS NOT NULL AND closed_at IS NOT NULL")
    moves = moves.unionByName(closes.select("run_id", F.lit(0).alias("rank"), F.col("no").alias("id"), F.greatest("opened_at", "closed_at").alias("ts"), F.lit(-1).alias("step")))
    moves = moves.unionByName(asked.select("run_id", F.lit(1).alias("rank"), "id", "ts", F.lit(0).alias("step")))
    counted = ordered_scan(moves, ["run_id"], ["ts", "rank", "id", "step"], {"n_open": running_sum(F.col("step"))}, hot_rows)
    alone = counted.where("rank = 1 AND n_open = 1").select("run_id", "id")
    key = ["run_id", "id"]
    routed = asked.join(route(["run_id", "agent"], "by_agent"), key, "left")
    routed = routed.join(route(["run_id"], "newest").join(alone, key), key, "left")
    routed = routed.select(*key, "ts", "call_id", F.coalesce("by_agent", "newest").alias("led"))
    own = route(["run_id", "call_id"], "by_call")
    # Events without a call id stay out of this join and of the scan, where they would all meet in one task.
    named = routed.where("call_id IS NOT NULL").join(own, key, "left")
    direct = named.where("by_call IS NOT NULL").select(*key, F.col("by_call.no").alias("comm_no"))
    taught = _taught(named.where("by_call IS NULL"))
    unnamed = routed.where("call_id IS NULL").select(*key, F.col("led.no").alias("comm_no"))
    return unnamed.unionByName(direct).unionByName(taught)


def _taught(events: DataFrame) -> DataFrame:
    """``run_id, id, comm_no`` of events (run_id, call_id, ts, id, led) by what call ids were taught.

    A scan over each call id in order; its state is one record. A partition is streamed, so a call id with
    very many events costs time in one task, but no memory.
    """

    def scan(batches):
        key = record = until = None
        for batch in batches:
            numbers = []
            runs, calls, times, ids = (batch.column(c) for c in range(4))
            led_no, led_until = batch.column(4).to_pylist(), batch.column(5).cast("int64").to_pylist()
            for i, (run, call, at) in enumerate(zip(runs.to_pylist(), calls.to_pylist(), times.cast("int64").to_pylist())):
                if (run, call) != key:
                    key, record, until = (run, call), None, None
                if record is None or (until is not None and (at is None or until <= at)):
                    record, until = led_no[i], led_until[i]
                numbers.append(record)
            yield pa.RecordBatch.from_arrays([runs, ids, pa.array(numbers, pa.int64())], ["run_id", "id", "comm_no"])

    order = ["run_id", "call_id", "ts", "id"]
    rows = events.select(*order, F.col("led.no").alias("led_no"), F.col("led.until").alias("led_until"))
    rows = rows.repartition("run_id", "call_id").sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return rows.mapInArrow(scan, f"run_id {kinds['run_id']}, id {kinds['id']}, comm_no long")


def event_tree(nodes: DataFrame) -> DataFrame:
    """Depth and path of every node ``(id, parent_id)``; siblings sort by id.

    Each round doubles the distance walked towards the root, so a tree of depth d takes about
    log2(d) joins. Nodes that reached a root leave the working set, and so do nodes that meet
    themselves or another node twice: nodes on or below a cycle have NULL depth and path.
    """
    ids = nodes.select(F.col("id").alias("__known"))
    linked = nodes.join(ids, F.col("parent_id") == F.col("__known"), "left").select(
        "id", F.col("__known").alias("up"), F.array(F.col("id")).alias("path"), F.col("__known").eqNullSafe(F.col("id")).alias("bad")
    )
    table = cut_lineage(linked)
    finished = table.where("up is null or bad")
    walking = table.where("up is not null and not bad")
    while not walking.isEmpty():
        hop = finished.unionByName(walking).select(
            F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("bad").alias("__bad")
        )
        whole = F.concat("__path", "path")
        again = F.col("__bad") | F.arrays_overlap("__path", "path") | F.coalesce(F.array_contains(whole, F.col("__up")), F.lit(False))
        stepped = cut_lineage(
            walking.join(hop, F.col("up") == F.col("__id")).select("id", F.col("__up").alias("up"), whole.alias("path"), again.alias("bad"))
        )
        finished = finished.unionByName(stepped.where("up is null or bad"))
        walking = stepped.where("up is not null and not bad")
    sound = ~F.col("bad")
    return finished.select("id", F.when(sound, F.size("path") - 1).alias("depth"), F.when(sound, F.col("path")).alias("path"))


def process_view(runs: DataFrame, events: DataFrame, substeps: DataFrame) -> DataFrame:
    """Every run crossed with the fixed list of sub-steps: status and duration of each.

    ``runs``: run_id, current_substep. ``substeps``: substep, position, owner (a small fixed table).
    Precedence of the status: active, skipped, done, then by position.
    """
    steps = substeps.agg(F.sort_array(F.collect_list(F.struct("position", "substep", "owner"))).alias("s")).scalar()
    expanded = runs.withColumn("steps", steps)
    here = F.filter("steps", lambda s: s["substep"] == F.col("current_substep"))[0]["position"]
    grid = expanded.select("run_id", "current_substep", here.alias("at"), F.explode("steps").alias("s")).select(
        "run_id", "current_substep", "at", "s.*"
    )
    status = (
        F.when(F.col("substep") == F.col("current_substep"), "active")
        .when(F.col("skipped"), "skipped")
        .when(F.col("ended"), "done")
        .when(F.col("position") < F.col("at"), "done")
        .otherwise("pending")
    )
    return grid.join(substep_facts(events), ["run_id", "substep"], "left").select(
        "run_id", "substep", "owner", status.alias("status"), "duration_ms"
    )


def attempt_stats(attempts: DataFrame, count_malformed: bool = True) -> DataFrame:
    """Attempts and failures per run; a malformed line is either a failed attempt or left out."""
    rows = attempts if count_malformed else attempts.where(~F.col("malformed"))
    failed = F.col("malformed") | ~F.coalesce("ok", F.lit(False))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(failed).alias("failures"))


def attempt_highlights(attempts: DataFrame) -> DataFrame:
    """Per label: attempts, last successful one and the last three failed ones in order."""
    good = F.coalesce("ok", F.lit(False))
    label = F.coalesce("label", F.lit("unknown"))
    rows = attempts.withColumn("label", label)
    summary = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("attempts"), F.max(F.when(good, F.col("seq"))).alias("winner_seq")
    )
    recent = Window.partitionBy("label").orderBy(F.col("seq").desc())
    misses = (
        rows.where(~good)
        .withColumn("rank", F.row_number().over(recent))
        .where(F.col("rank") <= NEAR_MISSES)
        .groupBy("label")
        .agg(F.sort_array(F.collect_list("seq")).alias("near_miss_seqs"))
    )
    none = F.array().cast("array<bigint>")
    return summary.join(misses, "label", "left").withColumn("near_miss_seqs", F.coalesce("near_miss_seqs", none))


def winning_attempt(attempts: DataFrame, key: list[str]) -> DataFrame:
    """Last successful attempt per key, as an aggregate so that no key is sorted whole."""
    rest = [c for c in attempts.columns if c not in key]
    best = attempts.where("ok").groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("w"))
    return best.select(*key, "w.*")


def failed_attempts(attempts: DataFrame, columns: list[str]) -> DataFrame:
    """Attempts that did not succeed; an unknown outcome counts as a failure."""
    return attempts.where(~F.coalesce("ok", F.lit(False))).select(*columns)


def substep_debug(substep, communications: DataFrame, events: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows of three logs that belong to one sub-step, tagged by kind."""
    def tagged(df, kind):
        return df.where(F.col("substep") == substep).select(
            F.lit(kind).alias("kind"), "run_id", F.col("id").cast("string").alias("id"), "ts"
        )

    return (
        tagged(communications, "communication")
        .unionByName(tagged(events, "event"))
        .unionByName(tagged(attempts, "attempt"))
    )


def is_learnable(halt_reason: Column) -> Column:
    """False when the run stopped for reasons outside the data work."""
    text = F.lower(F.coalesce(halt_reason, F.lit("")))
    hit = F.lit(False)
    for mark in INFRASTRUCTURE_MARKS:
        hit = hit | F.contains(text, F.lit(mark))
    return ~hit


def owned_by(rows: DataFrame, owners: DataFrame, user) -> DataFrame:
    """Rows whose owning task belongs to ``user``."""
    mine = owners.where(F.col("user_id") == user).select("task_id")
    return rows.join(mine, "task_id", "left_semi")


def first_occurrence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key in order."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*key, "r.*")


def recent_per_group(df: DataFrame, group: list[str], n: int, order: list[str] = ORDER) -> DataFrame:
    """The last ``n`` rows per group; map tasks already keep only their own last ``n``."""
    latest = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(latest)).where(F.col("recency") <= n)


def log_preview(message: Column) -> Column:
    return F.substring(message, 1, LOG_MESSAGE_CHARS)


def run_timing(manifest: DataFrame, events: DataFrame, reports: DataFrame) -> DataFrame:
    """Start, end and duration of runs from the best source at hand.

    The trace wins over the manifest, the manifest over the reports; without any stated duration
    the difference of the two times is used.
    """
    trace = events.groupBy("run_id").agg(
        F.min("ts").alias("trace_start"), F.max("ts").alias("trace_end"),
        F.max_by("ts_mono_ms", _at()).cast("long").alias("trace_ms"),
    )
    joined = manifest.join(trace, "run_id", "left").join(
        reports.select("run_id", *[F.col(c).alias(f"report_{c}") for c in ("started_at", "ended_at", "duration_ms")]),
        "run_id", "left",
    )
    started = F.coalesce("trace_start", "started_at", "report_started_at")
    ended = F.coalesce("trace_end", "ended_at", "report_ended_at")
    apart = elapsed_ms(started, ended)
    return joined.select(
        "run_id",
        started.alias("started_at"),
        ended.alias("ended_at"),
        F.coalesce("trace_ms", "duration_ms", "report_duration_ms", apart).alias("duration_ms"),
    )


def timing_backfill(manifest: DataFrame, timing: DataFrame) -> DataFrame:
    """Manifest rows with better timing filled in and the names of the fields that changed."""
    fields = ["started_at", "ended_at", "duration_ms"]
    new = timing.select("run_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = manifest.join(new, "run_id", "left")

    def differs(c):
        return F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c))

    return joined.select(
        *[c for c in manifest.columns if c not in fields],
        *[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) for c in fields],
        F.array_compact(F.array(*[F.when(differs(c), c) for c in fields])).alias("changed"),
    )


def completed_substeps(events: DataFrame, counters: DataFrame) -> DataFrame:
    """Finished sub-steps per run: from the log or from the progress counter, whichever is larger."""
    ended = events.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("type") == "substep.end", F.col("substep"))).alias("from_log")
    )
    both = ended.join(counters, "run_id", "full_outer")
    in_log, counted = F.coalesce("from_log", F.lit(0)), F.coalesce("completed", F.lit(0))
    return both.select(
        "run_id",
        F.greatest(in_log, counted).alias("completed"),
        F.when(in_log > counted, "trace").otherwise("counter").alias("source"),
    )


def loop_counts(loops: DataFrame) -> DataFrame:
    return loops.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))


def loop_union(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Loops told by the snapshot together with the loop events of the log."""
    columns = ["run_id", "label", "reason", "ts"]
    told = snapshot.select(*columns, F.lit("snapshot").alias("origin"))
    return told.unionByName(events.where("type = 'loop'").select(*columns, F.lit("trace").alias("origin")))


def dotted_order(key: Column) -> Column:
    """Sort key for names such as 2.10: numbers compared one by one."""
    return F.transform(F.split(key, r"\."), lambda p: p.try_cast("int"))


def join_conclusions(conclusions: DataFrame, scripts: DataFrame) -> DataFrame:
    """Conclusions with the winning script of the same sub-step, in sub-step order."""
    return conclusions.join(scripts, ["run_id", "substep"], "left").orderBy("run_id", dotted_order(F.col("substep")))


def decision_chain(records: DataFrame, n: int = 3) -> DataFrame:
    """First closed records of every priority sub-step."""
    wanted = records.where(F.col("closed") & F.col("substep").isin(PRIORITY_SUBSTEPS))
    early = Window.partitionBy("run_id", "substep").orderBy("ts", "id")
    return wanted.withColumn("rank", F.row_number().over(early)).where(F.col("rank") <= n)


def latest_and_previous(runs: DataFrame, case: str, order: list[str]) -> DataFrame:
    """Latest run per case and the one before it, from the two newest rows only."""
    newest = Window.partitionBy(case).orderBy(*[F.col(c).desc() for c in order])
    top = runs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= 2)
    return top.groupBy(case).agg(
        F.max(F.when(F.col("rank") == 1, F.col("run_id"))).alias("latest"),
        F.max(F.when(F.col("rank") == 2, F.col("run_id"))).alias("previous"),
    )


def with_previous_run(runs: DataFrame, case: str, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``previous_run`` to every run of a case."""
    return ordered_scan(runs, [case], order, {"previous_run": previous(F.col("run_id"))}, hot_rows)


def run_facts(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """One wide row per run: left joins of per-run aggregates."""
    out = base
    for part in parts:
        out = out.join(part, "run_id", "left")
    return out
