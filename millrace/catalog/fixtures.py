"""Inputs derived from the driver tables, once as DataFrames and once as SQL text.

The tables hold no NULLs, so missing values come from what the values say: an order priority of
"4-NOT SPECIFIED" and very high order totals count as not recorded, and documents without a label
row have no quality. Every rule keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_UNTIL = "2000-01-01"
ORDERS_DTYPES = {
    "o_orderkey": "int",
    "o_custkey": "int",
    "o_orderstatus": "string",
    "o_totalprice": "float",
    "o_orderdate": "datetime",
    "o_orderpriority": "string",
}
DOCS_DTYPES = {
    "doc_id": "int",
    "lang": "string",
    "source": "string",
    "n_chars": "int",
    "quality": "int",
    "toxic": "int",
}


def orders_with_gaps(t) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
    )


ORDERS_WITH_GAPS = """gaps AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS o_totalprice, o_orderdate,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)"""


def orders_train(t) -> DataFrame:
    return orders_with_gaps(t).where(F.col("o_orderdate") < F.lit(TRAIN_UNTIL).cast("timestamp_ntz"))


def orders_test(t) -> DataFrame:
    later = orders_with_gaps(t).where(F.col("o_orderdate") >= F.lit(TRAIN_UNTIL).cast("timestamp_ntz"))
    return later.drop("o_orderstatus")


ORDERS_SPLIT = f"""{ORDERS_WITH_GAPS},
train AS (SELECT * FROM gaps WHERE o_orderdate < TIMESTAMP '{TRAIN_UNTIL}'),
test AS (SELECT * EXCLUDE (o_orderstatus) FROM gaps WHERE o_orderdate >= TIMESTAMP '{TRAIN_UNTIL}')"""


def labelled_documents(t) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


LABELLED_DOCUMENTS = """docs AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def scored_labels(t) -> DataFrame:
    """Labels with a length-rule prediction: long documents are predicted to be good."""
    joined = t.labels.join(t.documents, "doc_id")
    return joined.select(
        "doc_id",
        "lang",
        F.col("quality").alias("y"),
        F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("pred"),
    )


SCORED_LABELS = """scored AS (
  SELECT l.doc_id, d.lang, l.quality AS y, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS pred
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def profile_sql(table: str, dtypes: dict[str, str]) -> str:
    """SELECT giving one row per column of ``table``, as the column profile does."""
    parts = [
        f"SELECT '{c}' AS \"column\", {i} AS position, '{d}' AS dtype, count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, "
        f"count(DISTINCT {c}) <= 1 AS is_constant FROM {table}"
        for i, (c, d) in enumerate(dtypes.items())
    ]
    return "\nUNION ALL ".join(parts)


TRACE_TYPES = {
    "signup": "substep.dispatch",
    "purchase": "substep.end",
    "click": "llm.start",
    "view": "llm.end",
    "error": "exception",
}
AGENTS = ["pm", "domain", "data_engineer", "data_scientist", "developer", "storyteller"]
SUBSTEP_COUNT = 24


def trace_events(t) -> DataFrame:
    """The event table read as a run log: one run per user.

    The numeric property picks the agent and the sub-step, so all agents and sub-steps occur.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.create_map(*[F.lit(x) for pair in TRACE_TYPES.items() for x in pair])
    owner = F.element_at(F.array(*map(F.lit, AGENTS)), (k % len(AGENTS) + 1).cast("int"))
    kind = F.try_element_at(kinds, F.col("event_type"))
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("id"),
        "ts",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ts_mono_ms"),
        kind.alias("type"),
        (k % SUBSTEP_COUNT).cast("int").alias("substep"),
        F.lit(None).cast("long").alias("communication_id"),
        # Only dispatches and exceptions name their agent, as in a real log.
        F.when(kind.isin("substep.dispatch", "exception"), owner).alias("agent"),
        "value",
    )


TRACE_EVENTS = """trace AS (
  SELECT *, CASE WHEN type IN ('substep.dispatch', 'exception') THEN
      list_extract(['pm', 'domain', 'data_engineer', 'data_scientist', 'developer', 'storyteller'],
                   (k % 6) + 1) END AS agent
  FROM (SELECT user_id AS run_id, event_id AS id, ts, epoch_us(ts) / 1000.0 AS ts_mono_ms,
      CASE event_type WHEN 'signup' THEN 'substep.dispatch' WHEN 'purchase' THEN 'substep.end'
        WHEN 'click' THEN 'llm.start' WHEN 'view' THEN 'llm.end' ELSE 'exception' END AS type,
      k, CAST(k % 24 AS INTEGER) AS substep, value
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))"""


def attempts(t) -> DataFrame:
    """Event rows as an attempt log."""
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("label"),
        F.col("event_id").alias("seq"),
        (F.get_json_object("props", "$.k").cast("int") % SUBSTEP_COUNT).cast("int").alias("substep"),
        F.when(F.col("value") < 400, F.col("value") >= 50).alias("ok"),
        "ts",
    )


ATTEMPTS = """attempts AS (
  SELECT user_id AS run_id, event_type AS label, event_id AS seq,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 24 AS INTEGER) AS substep,
         CASE WHEN value < 400 THEN value >= 50 END AS ok, ts FROM events)"""


def spend(t) -> DataFrame:
    """Event rows as token spend: agent = event type, tokens = whole part of the value."""
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("agent"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("started_at"),
        F.floor("value").cast("long").alias("tokens"),
    )


SPEND = """spend AS (
  SELECT user_id AS run_id, event_type AS agent, event_id AS seq, ts AS started_at,
         CAST(floor(value) AS BIGINT) AS tokens FROM events)"""
