"""Run catalog and leaderboard: joins with final states, badges, features, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.metricrules import direction, lower_is_better, meets, run_status
from millrace.functions.numbers import ratio

BADGES = ["best_score", "fewest_tokens", "best_recall"]


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc())


def leaderboard(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Run catalog with the final state where there is one.

    ``runs``: run_id, started_at, ended_at, halted. ``states``: run_id, metric, explicit_direction,
    metrics (map), threshold, tokens.
    """
    joined = runs.join(states, "run_id", "left")
    score = F.try_element_at("metrics", F.col("metric"))
    way = direction(F.col("metric"), F.col("explicit_direction"))
    return joined.select(
        "run_id",
        "started_at",
        run_status(F.coalesce("halted", F.lit(False)), F.col("ended_at")).alias("status"),
        "metric",
        score.alias("score"),
        meets(score, F.col("threshold"), way).alias("meets_threshold"),
        F.when(F.col("tokens") != 0, F.col("tokens")).alias("total_tokens"),
    )


def badges(runs: DataFrame) -> DataFrame:
    """Runs that lead their case: ``(case_id, run_id, badge)``.

    ``runs``: case_id, run_id, position, metric, score, tokens, fn, tp. Scores are compared
    within one metric; the earlier run wins a tie.
    """
    signed = F.when(lower_is_better(F.col("metric")), F.col("score")).otherwise(-F.col("score"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    keys = {
        "best_score": (["case_id", "metric"], signed),
        "fewest_tokens": (["case_id"], F.col("tokens").cast("double")),
        "best_recall": (["case_id"], -recall),
    }
    out = None
    for badge in BADGES:
        group, key = keys[badge]
        # An aggregate per group: the leaders come from partial minima, not from a sorted group.
        ranked = runs.where(key.isNotNull()).groupBy(*group).agg(
            F.min_by("run_id", F.struct(key.alias("k"), F.col("position"))).alias("run_id")
        )
        leaders = ranked.select("case_id", "run_id", F.lit(badge).alias("badge"))
        out = leaders if out is None else out.unionByName(leaders)
    return out


def feature_frequency(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """In how many runs each derived feature occurs, and whether it is missing from some.

    ``runs``: run_id, features (array), plus the ``by`` columns.
    """
    by = list(by)
    totals = runs.groupBy(*by).agg(F.count_distinct("run_id").alias("n_runs"))
    used = runs.select(*by, "run_id", F.explode("features").alias("feature")).distinct()
    counts = used.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(totals, by) if by else counts.withColumn("n_runs", totals.scalar())
    return joined.withColumn("differs", F.col("n") < F.col("n_runs"))


def missing_handling(reports: DataFrame) -> DataFrame:
    """Columns with missing values that were filled and those that were dropped.

    ``reports``: run_id, missing_before (map of counts), columns_dropped (array).
    """
    gaps = F.map_keys(F.map_filter("missing_before", lambda _, n: n > 0))
    dropped = F.coalesce("columns_dropped", F.array().cast("array<string>"))
    return reports.select(
        "run_id",
        F.array_sort(F.array_except(gaps, dropped)).alias("filled"),
        F.array_sort(F.array_intersect(gaps, dropped)).alias("dropped"),
    )


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """New snapshot of a keyed table: the newest version of every key, changes winning ties."""
    rest = [c for c in current.columns if c not in key]
    tagged = current.withColumn("__source", F.lit(0)).unionByName(
        changes.select(*current.columns).withColumn("__source", F.lit(1))
    )
    newest = tagged.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "__source")).alias("row"))
    return newest.select(*key, "row.*").select(*current.columns)


def case_union(demo: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in and user cases in one listing; columns one side lacks are NULL."""
    return demo.withColumn("origin", F.lit("demo")).unionByName(
        user.withColumn("origin", F.lit("user")), allowMissingColumns=True
    )


def runs_across_cases(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("run_count").alias("runs"), F.count(F.lit(1)).alias("cases"))
