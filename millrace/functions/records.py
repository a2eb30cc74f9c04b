"""Shape repair of semi-structured records kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.metricrules import direction, meets

# Alternative keys under which the same fact is stored.
SCORE_KEYS = ["achieved_score", "cv_score"]
NESTED_SCORE_KEYS = ["cv_mean", "mean", "score", "value", "f1"]
MEETS_KEYS = ["meets", "success_criterion_met", "meets_success_criterion"]
NAME_KEYS = ["field", "column", "name", "feature"]
DECISION_KEYS = ["decision", "action"]
CV_RENAMES = {"cv_f1_mean": "mean", "cv_f1_std": "std"}


def _first(json: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])


def score_of(json: Column, fallback: Column | None = None) -> Column:
    """Score as a number, from a number, numeric text or a nested object."""
    raw = _first(json, SCORE_KEYS)
    nested = F.coalesce(*[F.get_json_object(raw, f"$.{k}").try_cast("double") for k in NESTED_SCORE_KEYS])
    own = F.coalesce(raw.try_cast("double"), nested)
    return F.coalesce(own, fallback) if fallback is not None else own


def assessment(json: Column, metric: Column, threshold: Column, way: Column, cv_score: Column) -> Column:
    """Canonical assessment struct from a loosely keyed one plus the configured defaults."""
    chosen_metric = F.coalesce(_first(json, ["metric", "evaluation_metric"]), metric)
    chosen_way = direction(chosen_metric, F.coalesce(F.get_json_object(json, "$.direction"), way))
    limit = F.coalesce(_first(json, ["threshold", "success_threshold"]).try_cast("double"), threshold)
    score = score_of(json, cv_score)
    stated = _first(json, MEETS_KEYS).try_cast("boolean")
    return F.struct(
        chosen_metric.alias("metric"),
        chosen_way.alias("direction"),
        limit.alias("threshold"),
        score.alias("score"),
        F.coalesce(meets(score, limit, chosen_way), stated, F.lit(False)).alias("meets"),
    )


def _numbers(entries: Column) -> Column:
    """Keep the entries whose text value is a number."""
    typed = F.transform(
        entries, lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("double").alias("value"))
    )
    return F.filter(typed, lambda e: e["value"].isNotNull())


def flat_metrics(json: Column, labels: Column) -> Column:
    """Metric map of a bundle: per-class scores become ``<metric>_<class name>``."""
    flat = F.map_entries(F.from_json(json, "map<string,string>"))
    own = F.filter(flat, lambda e: (e["key"] != "per_class") & ~e["key"].startswith("cv_"))
    per_class = F.from_json(F.get_json_object(json, "$.per_class"), "map<string,map<string,string>>")

    def named(entry: Column) -> Column:
        name = F.coalesce(F.try_element_at(labels, entry["key"]), entry["key"])
        return F.transform(
            F.map_entries(entry["value"]),
            lambda m: F.struct(F.concat(m["key"], F.lit("_"), name).alias("key"), m["value"].alias("value")),
        )

    nested = F.flatten(F.transform(F.map_entries(per_class), named))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(_numbers(F.concat(F.coalesce(nested, empty), own)))


def cv_metrics(json: Column) -> Column:
    """The ``cv_*`` entries of a bundle under their short names."""
    renames = F.create_map(*[F.lit(x) for pair in CV_RENAMES.items() for x in pair])
    flat = F.filter(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: e["key"].startswith("cv_"))
    short = F.transform(
        flat,
        lambda e: F.struct(
            F.coalesce(F.try_element_at(renames, e["key"]), F.substr(e["key"], F.lit(4))).alias("key"),
            e["value"].alias("value"),
        ),
    )
    return F.map_from_entries(_numbers(short))


def json_kind(json: Column) -> Column:
    """OBJECT, ARRAY, STRING or SCALAR for JSON text; NULL for the null literal and for no JSON.

    Valid JSON shows its kind in its first character, which is cheaper than a schema.
    """
    return F.when(F.try_parse_json(json).isNotNull(), kind_of_valid(F.btrim(json, F.lit(" \t\r\n"))))


def kind_of_valid(json: Column) -> Column:
    """:func:`json_kind` for text that is known to be trimmed, valid JSON."""
    first = F.substring(json, 1, 1)
    return (
        F.when(first == "{", "OBJECT")
        .when(first == "[", "ARRAY")
        .when(first == '"', "STRING")
        .when(first != "n", "SCALAR")
    )


def _string_value(json: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(json), "$", "string")


def object_list(json: Column) -> Column:
    """A field that must be a list of objects, as an array of JSON texts.

    NULL becomes an empty list, text one statement, and bare items are wrapped as statements.
    """
    nothing = F.array().cast("array<string>")

    def item(value: Column) -> Column:
        text = F.to_json(value)
        plain = F.coalesce(F.try_variant_get(value, "$", "string"), text)
        return F.when(text.startswith("{"), text).otherwise(F.to_json(F.struct(plain.alias("statement"))))

    def coerced(value: Column) -> Column:
        text = F.to_json(value)
        plain = F.trim(F.coalesce(F.try_variant_get(value, "$", "string"), text))
        one = F.array(F.to_json(F.struct(plain.alias("statement"))))
        return (
            F.when(text.isNull() | (text == "null"), nothing)
            .when(text.startswith("["), F.transform(F.try_variant_get(value, "$", "array<variant>"), item))
            .when(plain == "", nothing)
            .otherwise(one)
        )

    # Parsed once, then used as a variable.
    return F.transform(F.array(F.try_parse_json(json)), coerced)[0]


def text_list(json: Column) -> Column:
    """A field that must be a list: non-blank text becomes a list of one, blank an empty list."""
    kind = json_kind(json)
    nothing = F.array().cast("array<string>")
    text = _string_value(json)
    return (
        F.when(kind == "ARRAY", F.from_json(json, "array<string>"))
        .when(kind == "STRING", F.when(F.trim(text) == "", nothing).otherwise(F.array(text)))
    )


def inclusion_split(json: Column) -> Column:
    """Struct of included and excluded names from a mixed list of texts and decision records."""
    items = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))

    def parsed(item: Column) -> Column:
        is_record = json_kind(item) == "OBJECT"
        name = F.when(F.coalesce(is_record, F.lit(False)), _first(item, NAME_KEYS)).otherwise(item)
        decision = F.lower(F.coalesce(F.when(is_record, _first(item, DECISION_KEYS)), F.lit("include")))
        return F.struct(name.alias("name"), decision.startswith("excl").alias("excluded"))

    records = F.filter(F.transform(items, parsed), lambda r: r["name"].isNotNull())
    return F.struct(
        F.transform(F.filter(records, lambda r: ~r["excluded"]), lambda r: r["name"]).alias("included"),
        F.transform(F.filter(records, lambda r: r["excluded"]), lambda r: r["name"]).alias("excluded"),
    )
