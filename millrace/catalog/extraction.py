"""Extraction from model text and record shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import records, text
from millrace.operators import extract, usercode


def replies(t):
    """Event properties as model replies, wrapped in a way the event type decides."""
    kind, props = F.col("event_type"), F.col("props")
    wrapped = (
        F.when(kind == "view", props)
        .when(kind == "click", F.concat(F.lit("```json\n---\n"), props, F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit("<think>maybe {\"k\": 0}</think>\n"), F.regexp_replace(props, "\\}$", ", // note\n}")))
        .when(kind == "signup", F.concat(F.lit("Sure {as asked} here: "), F.regexp_replace(props, "\\}$", ",}"), F.lit(" done {\"x\": 1}")))
        .otherwise(F.concat(F.lit("no object: {{"), F.substr(props, F.lit(2)), F.lit(" ["),))
    )
    return t.events.select("event_id", "event_type", "props", wrapped.alias("reply"))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(
    "extract_json",
    f"""SELECT event_id, CASE WHEN event_type <> 'error' OR {_K} IS NULL THEN '{{"k":' || {_K} || '}}' ELSE '{{"k":' || {_K} || '}}' END AS object FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'""",
)
def extract_json(t):
    broken = replies(t).withColumn("reply", F.when(F.col("event_type") == "error", F.regexp_replace("reply", "\\}", ";")).otherwise(F.col("reply")))
    return extract.extract_json(broken, "reply").select("event_id", "object")


@query(
    "response_shape",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'json_code_wrapper' WHEN 'click' THEN 'markdown_fence' WHEN 'purchase' THEN 'other_json' WHEN 'signup' THEN 'other_json' ELSE 'plain_text' END AS shape,
      CASE event_type WHEN 'view' THEN 'x = ' || {_K} WHEN 'click' THEN 'y = ' || {_K} END AS code, CASE event_type WHEN 'purchase' THEN 'no' || {_K} WHEN 'signup' THEN 'status=BLOCKED' END AS refusal FROM events""",
)
def response_shape(t):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    reply = (
        F.when(kind == "view", F.concat(F.lit('{"note": 1, "code": "```python\\nx = '), k, F.lit('\\n```"}')))
        .when(kind == "click", F.concat(F.lit("```python\ny = "), k, F.lit("\n```\nand text")))
        .when(kind == "purchase", F.concat(F.lit('{"status": "refused", "message": "no'), k, F.lit('"}')))
        .when(kind == "signup", F.lit('  {"status": "BLOCKED"}'))
        .otherwise(F.concat(F.lit("just words "), k))
    )
    parsed = extract.extract_json(t.events.select("event_id", reply.alias("reply")), "reply", "parsed")
    return parsed.select(
        "event_id", extract.response_shape(F.col("reply"), F.col("parsed")).alias("shape"),
        extract.extract_code(F.col("reply")).alias("code"), extract.refusal(F.col("reply")).alias("refusal"),
    )


@query("last_json_line", f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN '{{"k": ' || {_K} || '}}' END AS line FROM events""")
def last_json_line(t):
    output = F.concat(F.lit('{"k": -1}\nlog {x}\n'), F.when(F.col("event_type") != "error", F.col("props")).otherwise(""), F.lit("\n{broken\ntail\n"))
    output = F.when(F.col("event_type") == "error", F.lit("log\n{broken\n")).otherwise(output)
    return t.events.select("event_id", extract.last_json_line(output).alias("line"))


@query(
    "error_class",
    """SELECT event_id, CASE WHEN value > 400 THEN 'timeout' ELSE CASE event_type WHEN 'view' THEN 'syntax_error' WHEN 'click' THEN 'schema_error' WHEN 'purchase' THEN 'shape_mismatch' WHEN 'signup' THEN 'lib_version' ELSE 'other' END END AS error_class FROM events""",
)
def error_class(t):
    kind = F.col("event_type")
    stderr = (
        F.when(kind == "view", "File x\nIndentationError: bad").when(kind == "click", "KeyError: 'a' (shape?)")
        .when(kind == "purchase", "ValueError: n_features 3 vs 4").when(kind == "signup", "module has no attribute 'y'").otherwise("Traceback")
    )
    return t.events.select("event_id", text.error_class(stderr, F.col("value") > 400).alias("error_class"))


@query(
    "contract_errors",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'missing:status,not_array:items' WHEN 'purchase' THEN 'wrong_kind:status,forbidden:diagnosis' WHEN 'signup' THEN 'not_object:updates' ELSE 'not_object' END AS errors FROM events""",
)
def contract_errors(t):
    kind = F.col("event_type")
    reply = (
        F.when(kind == "view", F.concat(F.lit('{"status": "OK", "items": [], "updates": '), "props", F.lit("}")))
        .when(kind == "click", '{"items": ""}').when(kind == "purchase", '{"status": 3, "diagnosis": "x"}')
        .when(kind == "signup", '{"status": "OK", "updates": "none"}').otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    )
    contract = extract.ReplyContract(required={"status": "STRING"}, arrays=("items",), objects=("updates",), forbidden=("diagnosis",))
    return t.events.select("event_id", F.array_join(extract.contract_errors(reply, contract), ",").alias("errors"))


@query(
    "list_coerce",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN '{{"k":' || {_K} || '}}' WHEN 'click' THEN '{{"statement":"a"}};{{"k":' || {_K} || '}}' WHEN 'purchase' THEN '{{"statement":"word"}}' ELSE '' END AS items FROM events""",
)
def list_coerce(t):
    kind = F.col("event_type")
    value = (
        F.when(kind == "view", F.concat(F.lit("["), "props", F.lit("]"))).when(kind == "click", F.concat(F.lit('["a", '), "props", F.lit("]")))
        .when(kind == "purchase", F.lit('"  word "')).when(kind == "signup", F.lit('" "'))
    )
    items = F.transform(records.object_list(value), lambda v: F.to_json(F.parse_json(v)))
    return t.events.select("event_id", F.array_join(items, ";").alias("items"))


@query(
    "shape_normalize",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN '{{"facts":[{{"statement":"one"}}],"n":' || {_K} || ',"notes":["x y"],"updates":{{}}}}' ELSE '{{"facts":[{{"k":' || {_K} || '}},{{"statement":"b"}}],"notes":[],"updates":{{"a":1}}}}' END AS reply FROM events""",
)
def shape_normalize(t):
    k = F.get_json_object("props", "$.k")
    loose = F.concat(F.lit('{"notes": "x y", "facts": "one", "updates": "", "n": '), k, F.lit("}"))
    mixed = F.concat(F.lit('{"notes": "", "facts": ['), "props", F.lit(', "b"], "updates": {"a": 1}}'))
    reply = F.when(F.col("event_type") == "view", loose).otherwise(mixed)
    once = extract.normalise_shape(F.col("reply"), lists=["notes"], object_lists=["facts"], objects=["updates"])
    first = t.events.select("event_id", reply.alias("reply")).withColumn("reply", once)
    return first.withColumn("reply", once)  # a second pass must not change anything


@query(
    "inclusion_split",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'a,b' ELSE 'a,c' END AS included, CASE WHEN event_type = 'view' THEN 'view' ELSE 'b,' || event_type END AS excluded FROM events""",
)
def inclusion_split(t):
    last = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "action": "Exclude"}]'))
    view = F.concat(F.lit('["a", {"field": "b", "decision": "include"}, {"decision": "exclude"}, '), last)
    other = F.concat(F.lit('["a", {"column": "b", "decision": "EXCLUDED"}, {"feature": "c"}, '), last)
    split = records.inclusion_split(F.when(F.col("event_type") == "view", view).otherwise(other))
    return t.events.select("event_id", split.alias("s")).select(
        "event_id", F.array_join("s.included", ",").alias("included"), F.array_join("s.excluded", ",").alias("excluded")
    )


@query(
    "truncate_preview",
    """SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS preview, CASE WHEN length(text) > 200 THEN length(text)::INTEGER END AS preview_len,
      '' AS off_text, length(text)::INTEGER AS off_len, CASE WHEN length(text) > 200 THEN length(text)::INTEGER END AS message_len FROM conversations""",
)
def truncate_preview(t):
    body = F.col("text")
    messages = text.stored_messages(F.array(F.struct("role", F.col("text").alias("content"))), limit=200)
    return t.conversations.select(
        "conv_id", "turn", text.stored_text(body, limit=200).alias("preview"), text.stored_length(body, limit=200).alias("preview_len"),
        text.stored_text(body, "off").alias("off_text"), text.stored_length(body, "off").alias("off_len"), messages[0]["content_len"].alias("message_len"),
    )


@query(
    "preview_tail",
    "SELECT doc_id, CASE WHEN length(b) <= 1200 THEN b ELSE right(b, 1200) END AS excerpt FROM (SELECT doc_id, trim(text, ' ' || chr(10)) AS b FROM documents)",
)
def preview_tail(t):
    return t.documents.select("doc_id", text.tail_excerpt(F.col("text")).alias("excerpt"))


@query(
    "sanitize_map",
    """SELECT conv_id, turn, '<truncated len=' || length(text) || '>' AS hidden, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS clipped, role AS kept FROM conversations""",
)
def sanitize_map(t):
    clean = extract.sanitise_attributes(F.create_map(F.lit("x.input.value"), "text", F.lit("body"), "text", F.lit("role"), "role"))
    rows = t.conversations.select("conv_id", "turn", clean.alias("m"))
    return rows.select("conv_id", "turn", F.col("m")["x.input.value"].alias("hidden"), F.col("m")["body"].alias("clipped"), F.col("m")["role"].alias("kept"))


@query(
    "record_compact",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'other' END AS provider_response, text AS outcome_response, CASE WHEN role <> 'user' THEN 'provider.raw_response' END AS response_ref FROM conversations""",
)
def record_compact(t):
    provider = F.when(F.col("role") == "user", "other").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", extract.compact_record(provider, F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


@query(
    "apply_with_contract",
    """SELECT o_orderkey, round(o_totalprice / 1000.0, 6) AS thousands, 2 AS attempts, 'rows:positive' AS broken FROM orders""",
)
def apply_with_contract(t):
    """The first transform breaks a row rule, the second one is accepted."""
    def wrong(frame):
        return frame.assign(thousands=frame["o_totalprice"] / 1000 - 100)[["o_orderkey", "thousands"]]

    def right(frame):
        return frame.assign(thousands=frame["o_totalprice"] / 1000)[["o_orderkey", "thousands"]]

    schema = "o_orderkey long, thousands double"
    contract = usercode.TableContract(
        columns={"o_orderkey": "bigint", "thousands": "double"}, row_rules={"positive": lambda: F.col("thousands") > 0}, same_row_count=True
    )
    orders = t.orders.select("o_orderkey", "o_totalprice")
    outcome = usercode.apply_with_contract(
        orders, [usercode.pandas_transform(wrong, schema), usercode.pandas_transform(right, schema)], contract,
        orders.select("o_orderkey", F.lit(None).cast("double").alias("thousands")),
    )
    broken = ",".join(e.split(":", 1)[1] for e in outcome.errors)
    return outcome.table.select("o_orderkey", F.round("thousands", 6).alias("thousands"), F.lit(outcome.attempts).alias("attempts"), F.lit(broken).alias("broken"))
