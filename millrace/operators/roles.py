"""Infer which column is the target, the identifier, free text or categorical; which file is what."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import plain_name
from millrace.plans.scan import ordered_scan, row_number

# Scores and patterns that decide the inferred roles.
TARGET_NAME_POINTS = [
    ("target", 100),
    ("label", 90),
    ("sentiment", 90),
    ("survived", 85),
    ("saleprice", 85),
    ("polarity", 80),
    ("outcome", 70),
    ("class", 55),
    ("category", 50),
    ("rating", 50),
    ("price", 45),
]
SHORT_TARGET_NAME = ("y", 40)
DATE_NAME = r"(?i)date|time|timestamp|year|month|day|(?:^|_)at$"
ID_NAME = r"(?i)(?:^|_)id$|userid|user_id|^id$"
TRAIN_FILE = r"(?i)(?:^|[_\-.])train(?:$|[_\-.])"
TEST_FILE = r"(?i)(?:^|[_\-.])(?:test|holdout|unlabelled|unlabeled)(?:$|[_\-.])"
SAMPLE_FILE = r"(?i)(?:sample.?submission)|(?:^|[_\-.])(?:sample|submission)(?:$|[_\-.])"
ROLE_ALIASES = {
    "train": ["train", "labelled", "labeled", "primary"],
    "test": ["test", "holdout", "unlabelled", "unlabeled"],
    "sample_submission": ["sample_submission", "submission"],
}
TABLE_SUFFIXES = ["csv", "tsv", "txt"]
MIN_TARGET_SCORE = 40
MIN_ID_SCORE = 20


@dataclass(frozen=True)
class Hints:
    """What is known about the columns of a case; empty lists mean unknown."""

    categorical: tuple[str, ...] = ()
    numeric_with_missing: tuple[str, ...] = ()
    ordinal: tuple[str, ...] = ()
    ordinal_string_encoded: tuple[str, ...] = ()
    text_free: tuple[str, ...] = ()
    na_means_absent: tuple[str, ...] = ()
    high_missing: tuple[str, ...] = ()
    representation_options: tuple[str, ...] = field(default=())

    @property
    def text_led(self) -> bool:
        """Free text is what the model should learn from."""
        if self.representation_options:
            return True
        structured = self.categorical or self.numeric_with_missing or self.ordinal or self.ordinal_string_encoded
        return bool(self.text_free) and not structured


def target_name_points(column: Column) -> Column:
    name = plain_name(column)
    points = [F.when(F.contains(name, F.lit(t)), p).otherwise(0) for t, p in TARGET_NAME_POINTS]
    short, short_points = SHORT_TARGET_NAME
    return F.greatest(*points, F.when(name == short, short_points).otherwise(0))


def target_candidates(
    profile: DataFrame, only_in_train: list[str] = (), problem_type: str = "classification"
) -> DataFrame:
    """Score of every column that could be the target, best first."""
    k, n, name = F.col("n_distinct"), F.col("n_rows"), F.col("column")
    usable = (k > 1) & (k != n) & ~((n >= 20) & (k >= F.floor(0.95 * n)))
    if "regress" in problem_type.lower():
        shape = F.when(F.col("dtype").isin("int", "float") & (k > 20), 40).otherwise(0)
    else:
        shape = F.when(k.between(2, 20), 40).when(k <= 50, 15).otherwise(0)
    score = (
        target_name_points(name)
        + F.when(name.isin(list(only_in_train)), 80).otherwise(0)
        - F.when(F.col("n_missing") > 0.4 * F.greatest(n, F.lit(1)), 40).otherwise(0)
        - F.when(name.rlike(DATE_NAME), 35).otherwise(0)
        + shape
    )
    return profile.where(usable).select("column", score.alias("score")).orderBy(F.desc("score"), "column")


def id_candidates(profile: DataFrame) -> DataFrame:
    """Score of every column whose values are all different."""
    name = F.lower("column")
    score = (
        F.lit(10)
        + F.when(F.regexp_replace(name, "-", "_").rlike(ID_NAME), 50).otherwise(0)
        + F.when(F.contains(name, F.lit("user")), 10).otherwise(0)
        + F.when(F.col("dtype") == "int", 20).otherwise(0)
    )
    unique = (F.col("n_rows") > 0) & (F.col("n_distinct") == F.col("n_rows"))
    return profile.where(unique).select("column", score.alias("score")).orderBy(F.desc("score"), "column")


def infer_roles(
    profile: DataFrame, only_in_train: list[str] = (), problem_type: str = "classification"
) -> DataFrame:
    """Rows ``(role, column, score)`` for the target and the identifier that were accepted."""
    target = (
        target_candidates(profile, only_in_train, problem_type)
        .limit(1)
        .where(F.col("score") >= MIN_TARGET_SCORE)
        .select(F.lit("target").alias("role"), "column", "score")
    )
    identifier = (
        id_candidates(profile.join(target.select("column"), "column", "left_anti"))
        .limit(1)
        .where(F.col("score") >= MIN_ID_SCORE)
        .select(F.lit("id").alias("role"), "column", "score")
    )
    return target.unionByName(identifier)


def infer_hints(profile: DataFrame, reserved: list[str]) -> DataFrame:
    """Rows ``(column, hint)``: numeric_with_missing, text_free or categorical_weak."""
    k, n = F.col("n_distinct"), F.greatest(F.col("n_rows"), F.lit(1))
    many = (k >= F.greatest(F.lit(50), F.floor(0.3 * n))) | ((n >= 8) & (k >= F.floor(0.8 * n)))
    hint = (
        F.when(
            F.col("dtype").isin("int", "float", "bool"),
            F.when(F.col("n_missing") > 0, "numeric_with_missing"),
        )
        .when(many, "text_free")
        .when(k.between(2, 50), "categorical_weak")
    )
    rows = profile.where(~F.col("column").isin(list(reserved)))
    return rows.select("column", hint.alias("hint"), k.alias("n_distinct")).where("hint is not null")


def hints_from_rows(rows: list) -> Hints:
    """Fold the (few) rows of :func:`infer_hints` into a :class:`Hints` value."""
    def named(hint):
        return [r["column"] for r in sorted(rows, key=lambda r: (-r["n_distinct"], r["column"])) if r["hint"] == hint]

    text = named("text_free")
    return Hints(
        text_free=tuple(text),
        representation_options=("tfidf_logreg",) if text else (),
        numeric_with_missing=tuple(named("numeric_with_missing")),
    )


def file_role(filename: Column) -> Column:
    """train, test, sample_submission or NULL from the stem of a file name."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return (
        F.when(stem.rlike(SAMPLE_FILE), "sample_submission")
        .when(stem.rlike(TRAIN_FILE), "train")
        .when(stem.rlike(TEST_FILE), "test")
    )


def explicit_role(role: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    out = None
    for name, words in ROLE_ALIASES.items():
        out = F.when(plain.isin(words), name) if out is None else out.when(plain.isin(words), name)
    return out


def is_table_file(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^./]*)$", 1)).isin(TABLE_SUFFIXES)


def source_roles(catalog: DataFrame, case: list[str]) -> DataFrame:
    """First file per role in every case; a table file stands in when no train file is named.

    ``catalog`` has ``position, path, role, original_filename`` and the ``case`` columns. The
    stand-in is the first table that is neither test nor sample, else the first that is not
    the sample.
    """
    name = F.coalesce(F.col("original_filename"), F.col("path"))
    resolved = F.coalesce(explicit_role(F.col("role")), file_role(name))
    table = is_table_file(F.col("path"))
    named = catalog.select(*case, "position", "path", resolved.alias("resolved"), table.alias("is_table"))

    def first_path(condition: Column) -> Column:
        return F.min_by("path", F.when(condition, F.col("position")))

    role = F.coalesce(F.col("resolved"), F.lit(""))
    picked = named.groupBy(*case).agg(
        first_path(role == "train").alias("named_train"),
        first_path(F.col("is_table") & ~role.isin("test", "sample_submission")).alias("plain_table"),
        first_path(F.col("is_table") & (role != "sample_submission")).alias("any_table"),
        first_path(role == "test").alias("test"),
        first_path(role == "sample_submission").alias("sample_submission"),
    )
    return picked.select(
        *case, F.coalesce("named_train", "plain_table", "any_table").alias("train"), "test", "sample_submission"
    )


def reconcile_paths(configured: DataFrame, inferred: DataFrame, case: list[str]) -> DataFrame:
    """Correct configured train/test/sample paths with the inferred ones; a test file is never invented."""
    found = inferred.select(*case, *[F.col(c).alias(f"found_{c}") for c in ("train", "test", "sample_submission")])
    both = configured.join(found, case, "left")
    train, found_train = F.col("train"), F.col("found_train")
    wrong = (file_role(train) == "test") & ~train.eqNullSafe(found_train)
    step = both.withColumn(
        "train", F.when(found_train.isNotNull() & (train.isNull() | wrong), found_train).otherwise(train)
    )
    found_test = F.col("found_test")
    step = step.withColumn(
        "test", F.when(F.col("test").isNull() & ~found_test.eqNullSafe(F.col("train")), found_test).otherwise(F.col("test"))
    )
    clash = F.col("train").eqNullSafe(F.col("test")) & F.col("train").isNotNull()
    replace = clash & found_train.isNotNull() & ~found_train.eqNullSafe(F.col("test"))
    return step.select(
        *case,
        F.when(replace, found_train).otherwise(F.col("train")).alias("train"),
        "test",
        F.coalesce("sample_submission", "found_sample_submission").alias("sample_submission"),
    )


def label_codec(df: DataFrame, target: str) -> DataFrame:
    """Rows ``(label, code)``: whole numbers keep their value, other labels get their sorted rank."""
    labels = df.select(F.col(target).cast("string").alias("label")).where("label is not null").distinct()
    number = F.col("label").try_cast("double")
    everyone = labels.agg(F.bool_and(F.coalesce(number == F.rint(number), F.lit(False)))).first()[0]
    if everyone:
        return labels.select("label", number.cast("long").alias("code"))
    ranked = ordered_scan(labels, [], ["label"], {"code": row_number()})
    return ranked.select("label", (F.col("code") - 1).cast("long").alias("code"))
