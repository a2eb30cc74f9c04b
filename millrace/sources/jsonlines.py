"""JSON lines, nested traces and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_tolerant(spark: SparkSession, path: str, schema: str | T.StructType, keep_malformed: bool) -> DataFrame:
    """JSON lines with a ``malformed`` flag; blank lines are ignored.

    ``keep_malformed`` keeps unreadable lines as rows of NULLs, so they can be counted.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    with_corrupt = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", with_corrupt, options).alias("r")).select("r.*")
    flagged = rows.withColumn("malformed", F.col(CORRUPT).isNotNull()).drop(CORRUPT)
    return flagged if keep_malformed else flagged.where(~F.col("malformed"))


def append(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines, times to the microsecond."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer = df.write.mode("append").option("timestampNTZFormat", micros).option("timestampFormat", micros + "XXX")
    writer.json(path)


EVENT_SCHEMA = (
    "id string, parent_id string, ts timestamp, ts_mono_ms double, duration_ms double, type string, "
    "source string, name string, attributes map<string,string>"
)
TRACE_SCHEMA = f"run_id string, case_id string, started_at timestamp, ended_at timestamp, events array<struct<{EVENT_SCHEMA.replace(' string', ':string').replace(' timestamp', ':timestamp').replace(' double', ':double').replace(' map', ':map')}>>"


def read_traces(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Trace documents, one row per event with its position in the trace.

    A file is one document, or with ``multi_line=False`` one document on each line.
    """
    runs = spark.read.schema(TRACE_SCHEMA).option("multiLine", multi_line).json(path)
    return explode_traces(runs)


def explode_traces(runs: DataFrame) -> DataFrame:
    rows = runs.select("run_id", "case_id", F.posexplode_outer("events").alias("position", "e"))
    return rows.where("e is not null").select("run_id", "case_id", "position", "e.*")


def read_first_available(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Documents of the primary source, with the fallback where a key is missing there."""
    return primary.unionByName(fallback.join(primary.select(key), key, "left_anti"), allowMissingColumns=True)


def run_catalog(spark: SparkSession, root: str, schema: str, file: str = "manifest.json") -> DataFrame:
    """Files ``<root>/<case>/runs/<run>/<file>`` with case and run from the path."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/runs/*/{file}")
    place = F.col("_metadata.file_path")
    return rows.select(
        F.regexp_extract(place, rf"/([^/]+)/runs/[^/]+/{file}", 1).alias("case_id"),
        F.regexp_extract(place, rf"/runs/([^/]+)/{file}", 1).alias("run_id"),
        *rows.columns,
    )


def with_status(manifests: DataFrame, status: DataFrame) -> DataFrame:
    """Manifests with the status of their run (``case_id, run_id, halted, workflow_complete``): ``state`` is complete,
    halted, or running where a run has no status yet or says neither."""
    known = status.select("case_id", "run_id", "halted", "workflow_complete")
    done, stopped = F.coalesce("workflow_complete", F.lit(False)), F.coalesce("halted", F.lit(False))
    state = F.when(stopped, "halted").when(done, "complete").otherwise("running")
    return manifests.join(known, ["case_id", "run_id"], "left").withColumn("state", state)
