"""Live views of growing logs: ingest, summary, open records, budget, deadline and run caps.

Every rule is a plain aggregate that accepts a batch or a streaming DataFrame, so the batch result
over the whole log is what the stream converges to. State is one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import elapsed_ms
from millrace.operators.spend import SOFT_LIMIT_PERCENT
from millrace.sources.stages import children, exists, remove

# Limits of a run.
MAX_TRANSITIONS = 12
MAX_VISITS = 3
MAX_INNER_LOOPS = 3

EVENT_FIELDS = (
    "run_id long, id long, ts timestamp_ntz, ts_mono_ms double, type string, substep int, agent string, value double"
)


def event_stream(spark: SparkSession, path: str, schema: str = EVENT_FIELDS, files_per_batch: int | None = None) -> DataFrame:
    """New JSON-lines files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def live_summary(events: DataFrame) -> DataFrame:
    """Per run: events so far, finished sub-steps, last sub-step and elapsed time.

    The set of sub-steps is bounded by the fixed list of sub-steps.
    """
    at = F.struct("ts", "id")
    ended = F.when(F.col("type") == "substep.end", F.col("substep"))
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.size(F.collect_set(ended)).alias("completed"),
        F.max_by("substep", at).alias("last_substep"),
        F.max_by("type", at).alias("last_type"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_at"),
    )


def with_elapsed(summary: DataFrame) -> DataFrame:
    return summary.withColumn("elapsed_ms", elapsed_ms(F.col("started_at"), F.col("last_at")))


def record_registry(messages: DataFrame) -> DataFrame:
    """State of every communication record from its open, enrich and close messages.

    ``messages``: comm_id, action, at, model, tokens. A later message fills what earlier ones left out.
    """
    def latest(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("at")))

    return messages.groupBy("comm_id").agg(
        F.min(F.when(F.col("action") == "open", F.col("at"))).alias("opened_at"),
        F.min(F.when(F.col("action") == "close", F.col("at"))).alias("closed_at"),
        latest("model").alias("model"),
        latest("tokens").alias("tokens"),
        F.bool_or(F.col("action") == "close").alias("closed"),
    )


def run_spend(spend: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Tokens per run, or per run and agent."""
    return spend.groupBy(*by).agg(F.sum("tokens").alias("spent"))


def agent_flags(totals: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Agents over the cap of their own; an agent without a cap is never over."""
    cap = F.element_at(F.create_map(*[F.lit(v) for kv in caps.items() for v in kv]), F.col("agent")) if caps else F.lit(None)
    return totals.select("run_id", "agent", "spent", cap.cast("long").alias("cap"), F.coalesce(F.col("spent") >= cap, F.lit(False)).alias("over"))


def budget_flags(totals: DataFrame, cap: int, soft_percent: float = SOFT_LIMIT_PERCENT) -> DataFrame:
    return totals.select(
        "run_id",
        "spent",
        (F.col("spent") >= cap * soft_percent / 100.0).alias("soft"),
        (F.col("spent") >= cap).alias("halt"),
    )


def deadline_flags(summary: DataFrame, cap_ms: int, now: Column | None = None) -> DataFrame:
    """Runs over their time: measured up to the last event, or up to ``now`` for runs gone silent."""
    end = F.coalesce(now, F.col("last_at")) if now is not None else F.col("last_at")
    spent = elapsed_ms(F.col("started_at"), end)
    return summary.select("run_id", spent.alias("elapsed_ms"), (spent >= cap_ms).alias("halt"))


def phase_visits(transitions: DataFrame) -> DataFrame:
    """Visits per run and phase and how many of them were inner loops (``run_id, phase, label``)."""
    return transitions.groupBy("run_id", "phase").agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(F.col("label") == "B").alias("inner")
    )


def cap_flags(visits: DataFrame) -> DataFrame:
    per_run = visits.groupBy("run_id").agg(
        F.sum("visits").alias("transitions"), F.max("visits").alias("most_visits"), F.sum("inner").alias("inner_loops")
    )
    over = (
        (F.col("transitions") >= MAX_TRANSITIONS)
        | (F.col("most_visits") > MAX_VISITS)
        | (F.col("inner_loops") > MAX_INNER_LOOPS)
    )
    return per_run.withColumn("halt", over)


class SnapshotSink:
    """Keyed result table fed by ``foreachBatch``, kept small by merging.

    Each micro-batch writes a folder of its own. ``FAN`` folders of one level are merged into one of the next level with
    one row per key, so a reader opens at most ``FAN`` folders of each level, whose number is the logarithm of the number of
    batches. A batch or a merge that runs twice after a failure leaves the same rows. Readers take the newest row per
    key, or with ``keep="first"`` the oldest one, which is how an alert is raised once.
    """

    FAN = 8

    def __init__(self, spark: SparkSession, root: str, key: list[str], keep: str = "last"):
        self.spark, self.root, self.key, self.keep = spark, root.rstrip("/"), key, keep

    def _folder(self, level: int, number: int) -> str:
        return f"{self.root}/level={level}/part={number}"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        if self._covered(0, batch_id):
            return  # a repeated batch that was merged already
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(self._folder(0, batch_id))
        level, number = 0, batch_id
        while (number + 1) % self.FAN == 0:
            children = [self._folder(level, n) for n in range(number + 1 - self.FAN, number + 1)]
            level, number = level + 1, number // self.FAN
            present = [c for c in children if exists(self.spark, f"{c}/_SUCCESS")]
            if present and not exists(self.spark, f"{self._folder(level, number)}/_SUCCESS"):
                merged = self._pick(self.spark.read.parquet(*present))
                merged.write.mode("overwrite").parquet(self._folder(level, number))
        # What was merged two levels down is not read any more, also not by a reader that began before the merge.
        if level >= 2:
            remove(self.spark, [self._folder(level - 2, n) for n in range(number * self.FAN**2, (number + 1) * self.FAN**2)])

    def _covered(self, level: int, number: int) -> bool:
        while number >= 0:
            level, number = level + 1, number // self.FAN
            if exists(self.spark, f"{self._folder(level, number)}/_SUCCESS"):
                return True
            if number == 0 and not exists(self.spark, f"{self.root}/level={level}"):
                return False
        return False

    def folders(self) -> list[str]:
        """What a reader opens: on each level the folders that no higher level has merged."""
        levels = sorted(int(n.removeprefix("level=")) for n in children(self.spark, self.root) if n.startswith("level="))
        found, merged_to = [], 0
        for level in reversed(levels):
            parts = sorted(int(n.removeprefix("part=")) for n in children(self.spark, f"{self.root}/level={level}") if n.startswith("part="))
            for n in parts:
                if n * self.FAN**level >= merged_to and exists(self.spark, f"{self._folder(level, n)}/_SUCCESS"):
                    found.append((level, n))
            merged_to = max([merged_to, *[(n + 1) * self.FAN**level for k, n in found if k == level]])
        return [self._folder(level, n) for level, n in found]

    def _pick(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        pick = F.max_by if self.keep == "last" else F.min_by
        best = rows.groupBy(*self.key).agg(pick(F.struct(*rest), F.col("batch")).alias("r"))
        return best.select(*self.key, "r.*")

    def current(self) -> DataFrame:
        """One row per key."""
        folders = self.folders()
        if not folders:
            raise FileNotFoundError(f"no batch was written to {self.root}")
        return self._pick(self.spark.read.parquet(*folders)).drop("batch")

    latest = current


def run_available(aggregate: DataFrame, sink: SnapshotSink, checkpoint: str, alerts: dict[str, SnapshotSink] | None = None, by_clock: bool = False) -> None:
    """Process everything that has arrived since the checkpoint, then stop.

    ``alerts``: sinks that get the rows of each batch that meet a condition. State that expires by the clock
    (``by_clock``) would keep asking for batches without data; as the job stops when all data is read, it goes without them.
    """
    conf, spark = "spark.sql.streaming.noDataMicroBatches.enabled", aggregate.sparkSession
    before = spark.conf.get(conf)

    def write(batch: DataFrame, batch_id: int) -> None:
        if alerts:
            batch.persist()
        sink.write(batch, batch_id)
        for condition, other in (alerts or {}).items():
            other.write(batch.where(condition), batch_id)
        batch.unpersist()

    writer = aggregate.writeStream.outputMode("update").foreachBatch(write)
    try:
        if by_clock:
            spark.conf.set(conf, "false")
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(conf, before)


def append_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append new rows exactly once to a Parquet folder; the checkpoint is the resume cursor."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
