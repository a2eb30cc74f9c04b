"""Structured data out of free-form model text: JSON objects, code, contract checks, compaction."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.records import json_kind, kind_of_valid, object_list
from millrace.functions.text import ELLIPSIS, strip

# Patterns and vocabulary of the replies.
THINKING = r"(?is)<think(?:ing)?>.*?</think(?:ing)?>"
FENCED_ALL = r"(?s)^```(?:json|JSON)?\s*\n?(.*?)\n?```\s*$"
FENCE_OPEN = r"^```(?:json|JSON)?\s*\n?"
FENCE_CLOSE = r"\n?```\s*$"
RULE_LINE = r"(?m)^\s*(-{3,}|\*{3,}|_{3,})\s*$\n?"
LINE_COMMENT = r"""//[^\n"]*"""
TRAILING_COMMA = r",(\s*[}\]])"
CODE_FENCE = r"(?s)```(?:[a-zA-Z0-9_+\-]+)?[ \t]*\r?\n?(.*?)```"
CODE_KEYS = ["code", "python", "source", "script", "content"]
REFUSALS = ["BLOCKED", "ERROR", "REFUSED"]
SENSITIVE_KEYS = [
    "llm.input_messages",
    "agent.backstory",
    "agent.goal",
    "input.value",
    "output.value",
    "crew_agents",
    "crew_tasks",
]
MAX_ATTRIBUTE_CHARS = 200


def strip_reasoning(text: Column) -> Column:
    return strip(F.regexp_replace(text, THINKING, ""))


def strip_wrappers(text: Column) -> Column:
    """Remove a surrounding code fence and horizontal rules."""
    bare = strip(text)
    inner = F.when(bare.rlike(FENCED_ALL), strip(F.regexp_extract(bare, FENCED_ALL, 1)))
    opened = F.regexp_replace(F.regexp_replace(bare, FENCE_OPEN, ""), FENCE_CLOSE, "")
    return strip(F.regexp_replace(F.coalesce(inner, opened), RULE_LINE, ""))


def repair_json(text: Column) -> Column:
    """Drop line comments and trailing commas."""
    return F.regexp_replace(F.regexp_replace(text, LINE_COMMENT, ""), TRAILING_COMMA, "$1")


def _object_or_null(text: Column) -> Column:
    # The first character is looked at before anything is parsed.
    return F.when(F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull(), text)


_MARK = re.compile(r'[{}"\\]')


def _closing_braces(text: str, start: int, known: dict[int, int | None]) -> None:
    """Record the end of every object opened from ``start`` on, up to the end of the first."""
    stack, quoted, skip = [], False, -1
    for mark in _MARK.finditer(text, start):
        at, char = mark.start(), mark.group()
        if at <= skip:
            continue
        if quoted:
            if char == "\\":
                skip = at + 1
            elif char == '"':
                quoted = False
        elif char == '"':
            quoted = True
        elif char == "{":
            stack.append(at)
        elif char == "}":
            known[stack.pop()] = at + 1
            if not stack:
                return
    known.update((at, None) for at in stack)


def first_object(text: str | None) -> str | None:
    """First balanced ``{...}`` that is valid JSON, as it stands or after repair."""
    if not text:
        return None
    known: dict[int, int | None] = {}
    at = text.find("{")
    while at >= 0:
        if at not in known:
            _closing_braces(text, at, known)
        end = known.get(at)
        if end is not None:
            piece = text[at:end]
            for body in (piece, re.sub(TRAILING_COMMA, r"\1", re.sub(LINE_COMMENT, "", piece))):
                try:
                    return json.dumps(json.loads(body), ensure_ascii=False)
                except ValueError:
                    continue
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


def extract_json(df: DataFrame, text: str, out: str = "object") -> DataFrame:
    """Add ``out``: the JSON object of a reply in canonical text, or NULL.

    Replies that are one object, also when fenced or slightly broken, are parsed natively. Only
    the others are sent, in Arrow batches, to the brace matcher.
    """
    clean = strip_reasoning(F.col(text))
    staged = df.withColumn("__clean", clean).withColumn("__bare", strip_wrappers(F.col("__clean")))
    whole = F.coalesce(
        _object_or_null(F.col("__clean")),
        _object_or_null(repair_json(F.col("__clean"))),
        _object_or_null(F.col("__bare")),
        _object_or_null(repair_json(F.col("__bare"))),
    )
    staged = staged.withColumn("__whole", whole)
    hard = F.when(F.col("__whole").isNull() & F.contains("__clean", F.lit("{")), F.col("__clean"))
    staged = staged.withColumn("__hard", hard).withColumn("__found", _first_object("__hard"))
    found = F.coalesce("__whole", "__found")
    return staged.withColumn(out, F.to_json(F.try_parse_json(found))).drop(
        "__clean", "__bare", "__whole", "__hard", "__found"
    )


def strip_fence(text: Column) -> Column:
    """Contents of the first code fence, or the text itself."""
    return F.when(text.rlike(CODE_FENCE), strip(F.regexp_extract(text, CODE_FENCE, 1))).otherwise(strip(text))


def _wrapped_code(json_text: Column) -> Column:
    variant = F.try_parse_json(json_text)
    fields = [F.try_variant_get(variant, f"$.{k}", "string") for k in CODE_KEYS]
    kinds = [F.to_json(F.try_variant_get(variant, f"$.{k}", "variant")).startswith('"') for k in CODE_KEYS]
    return F.coalesce(*[F.when(k & (F.trim(f) != ""), f) for k, f in zip(kinds, fields)])


def extract_code(text: Column) -> Column:
    """Code of a reply: out of a JSON wrapper, else out of the first fence, else NULL."""
    bare = strip(text)
    plain = F.when(json_kind(bare) == "STRING", F.try_variant_get(F.try_parse_json(bare), "$", "string"))
    unwrapped = F.coalesce(plain, _wrapped_code(bare))
    fenced = F.when(bare.rlike(CODE_FENCE), strip(F.regexp_extract(bare, CODE_FENCE, 1)))
    code = F.coalesce(strip_fence(unwrapped), fenced)
    return F.when(code != "", code)


def response_shape(text: Column, parsed: Column) -> Column:
    """markdown_fence, json_code_wrapper, other_json or plain_text."""
    return (
        F.when(strip(text).startswith("```"), "markdown_fence")
        .when(_wrapped_code(parsed).isNotNull(), "json_code_wrapper")
        .when(parsed.isNotNull(), "other_json")
        .otherwise("plain_text")
    )


def refusal(text: Column) -> Column:
    """Message of a reply that refuses, or NULL."""
    bare = strip(text)
    record = F.when(bare.startswith("{"), _object_or_null(bare))
    status = F.upper(F.coalesce(F.get_json_object(record, "$.status"), F.lit("")))
    told = F.get_json_object(record, "$.message")
    return F.when(
        status.isin(REFUSALS), F.coalesce(F.when(told != "", told), F.concat(F.lit("status="), status))
    )


def last_json_line(output: Column) -> Column:
    """Last line of a program's output that is a JSON object."""
    lines = F.transform(F.split(output, r"\R"), lambda l: F.trim(l))
    objects = F.filter(lines, lambda l: l.startswith("{") & F.try_parse_json(l).isNotNull())
    return F.try_element_at(objects, F.lit(-1))


@dataclass(frozen=True)
class ReplyContract:
    """What a reply object must look like: kinds per required key and keys that must not occur."""

    required: dict[str, str] = field(default_factory=dict)
    arrays: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


def contract_errors(json_text: Column, contract: ReplyContract) -> Column:
    """Array of ``rule:key`` for everything the reply breaks; a reply that is no object breaks all."""
    keys = list(dict.fromkeys([*contract.required, *contract.arrays, *contract.objects, *contract.forbidden]))
    names = {key: f"k{i}" for i, key in enumerate(keys)}

    def members(reply: Column) -> Column:
        """JSON text of every key the contract mentions; NULL where it is absent."""
        found = [F.to_json(F.try_variant_get(reply, f"$.{k}", "variant")).alias(n) for k, n in names.items()]
        return F.struct(F.to_json(reply).startswith("{").alias("is_object"), *found)

    def broken(m: Column) -> Column:
        kinds = {k: kind_of_valid(m[n]) for k, n in names.items()}
        checks = []
        for key, wanted in contract.required.items():
            kind = kinds[key]
            if wanted in ("NUMBER", "BOOLEAN"):
                is_flag = m[names[key]].isin("true", "false")
                kind = F.when(kind == "SCALAR", F.when(is_flag, "BOOLEAN").otherwise("NUMBER")).otherwise(kind)
            checks.append(F.when(kind.isNull(), f"missing:{key}").when(kind != wanted, f"wrong_kind:{key}"))
        checks += [F.when(kinds[k] != "ARRAY", f"not_array:{k}") for k in contract.arrays]
        checks += [F.when(kinds[k] != "OBJECT", f"not_object:{k}") for k in contract.objects]
        checks += [F.when(m[names[k]].isNotNull(), f"forbidden:{k}") for k in contract.forbidden]
        is_object = F.coalesce(m["is_object"], F.lit(False))
        none = F.array().cast("array<string>")
        return F.when(is_object, F.array_compact(F.array(*checks)) if checks else none).otherwise(F.array(F.lit("not_object")))

    # Arrays of one turn the parsed reply and its members into variables that are built once.
    parsed = F.transform(F.array(F.try_parse_json(json_text)), members)
    return F.transform(parsed, broken)[0]


def normalise_shape(json_text: Column, lists: list[str] = (), object_lists: list[str] = (), objects: list[str] = ()) -> Column:
    """Reply with list fields as lists and object fields as objects; applying it twice changes nothing."""
    members = F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>")

    def json_array(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    def repaired(key: Column, value: Column) -> Column:
        text = F.to_json(value)
        is_text = text.startswith('"')
        as_list = F.when(F.trim(F.try_variant_get(value, "$", "string")) == "", "[]").otherwise(
            F.concat(F.lit("["), text, F.lit("]"))
        )
        changed = (
            F.when(text == "null", F.lit(None).cast("string"))
            .when(key.isin(list(object_lists)), json_array(object_list(text)))
            .when(key.isin(list(lists)) & is_text, as_list)
            .when(key.isin(list(objects)) & is_text, F.lit("{}"))
        )
        return F.coalesce(F.try_parse_json(changed), value)

    return F.to_json(F.transform_values(members, repaired))


def sanitise_attributes(attributes: Column) -> Column:
    """Attribute map without prompt bodies and with long values clipped."""

    def stored(key: Column, value: Column) -> Column:
        hidden = F.lit(False)
        for mark in SENSITIVE_KEYS:
            hidden = hidden | F.contains(key, F.lit(mark))
        size = F.concat(F.lit("<truncated len="), F.length(value).cast("string"), F.lit(">"))
        clipped = F.concat(F.substring(value, 1, MAX_ATTRIBUTE_CHARS), F.lit(ELLIPSIS))
        return F.when(hidden, size).when(F.length(value) > MAX_ATTRIBUTE_CHARS, clipped).otherwise(value)

    return F.transform_values(attributes, stored)


def compact_record(provider_response: Column, outcome_response: Column) -> Column:
    """Keep one copy of a response stored twice: struct of what stays and a reference."""
    same = provider_response.isNotNull() & provider_response.eqNullSafe(outcome_response)
    return F.struct(
        F.when(~same, provider_response).alias("provider_response"),
        outcome_response.alias("outcome_response"),
        F.when(same, "provider.raw_response").alias("response_ref"),
    )
