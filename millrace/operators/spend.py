"""Token spend: totals, shares, budgets, apportioning and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import percent, ratio_or_zero
from millrace.plans.scan import HOT_ROWS, ordered_scan, running_sum

SOFT_LIMIT_PERCENT = 80.0
FREE_PREFIX = "ollama/"


def communications_summary(records: DataFrame) -> DataFrame:
    """Grand total, per agent and per model in one pass.

    ``records``: agent, model, tokens, duration_ms, prompt_chars, response_chars, outcome_known,
    parse_ok. ``level`` tells the three groupings apart. A parse failure needs a known outcome.
    """
    agent, model = F.coalesce("agent", F.lit("unknown")), F.coalesce("model", F.lit("unknown"))
    failed = F.coalesce(F.col("outcome_known"), F.lit(False)) & ~F.coalesce(F.col("parse_ok"), F.lit(True))
    named = records.withColumns({"agent": agent, "model": model, "__failed": failed})
    level = F.when(F.grouping("agent") == 0, "agent").when(F.grouping("model") == 0, "model").otherwise("total")
    return named.groupingSets([[], ["agent"], ["model"]], "agent", "model").agg(
        level.alias("level"),
        F.count(F.lit(1)).alias("turns"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("__failed")).alias("parse_failures"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.coalesce(F.sum("prompt_chars"), F.lit(0)).alias("prompt_chars"),
        F.coalesce(F.sum("response_chars"), F.lit(0)).alias("response_chars"),
    )


def spend_by(spend: DataFrame, keys: list[str]) -> DataFrame:
    return spend.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))


def spend_shares(spend: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """Per run and agent: tokens, share of the run, share of the agent's cap, and the top agent.

    The window sees one row per agent and run, never the spend rows themselves.
    """
    per_agent = spend_by(spend, ["run_id", "agent"])
    run = Window.partitionBy("run_id")
    if caps is not None:
        per_agent = per_agent.join(caps.select("agent", "cap"), "agent", "left")
    else:
        per_agent = per_agent.withColumn("cap", F.lit(None).cast("long"))
    return per_agent.select(
        "run_id",
        "agent",
        "tokens",
        F.coalesce(percent(F.col("tokens"), F.sum("tokens").over(run)), F.lit(0.0)).alias("pct_of_total"),
        "cap",
        percent(F.col("tokens"), F.col("cap")).alias("pct_of_cap"),
        F.min_by("agent", F.struct((-F.col("tokens")).alias("t"), "agent")).over(run).alias("top_agent"),
    )


def budget_status(spend: DataFrame, cap: Column, soft_percent: float = SOFT_LIMIT_PERCENT) -> DataFrame:
    """Spent, remaining, percentage and limit flags per run; ``cap`` may be NULL for no cap."""
    spent = F.col("spent")
    return (
        spend.groupBy("run_id")
        .agg(F.sum("tokens").alias("spent"))
        .withColumn("cap", cap.cast("long"))
        .select(
            "run_id",
            "cap",
            "spent",
            F.when(F.col("cap").isNotNull(), F.greatest(F.col("cap") - spent, F.lit(0))).alias("remaining"),
            percent(spent, F.col("cap")).alias("pct"),
            F.coalesce((F.col("cap") > 0) & (spent >= F.col("cap") * soft_percent / 100.0), F.lit(False)).alias("soft_limit"),
            F.coalesce(spent >= F.col("cap"), F.lit(False)).alias("over"),
        )
    )


def agent_budget(spend: DataFrame, caps: DataFrame) -> DataFrame:
    """Spend of each agent in each run against the agent's own cap."""
    joined = spend_by(spend, ["run_id", "agent"]).join(caps.select("agent", "cap"), "agent", "left")
    return joined.select(
        "run_id",
        "agent",
        F.col("tokens").alias("spent"),
        "cap",
        F.when(F.col("cap").isNotNull(), F.greatest(F.col("cap") - F.col("tokens"), F.lit(0))).alias("remaining"),
        F.coalesce(F.col("tokens") >= F.col("cap"), F.lit(False)).alias("over"),
    )


def cumulative_spend(spend: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running total per run over the records that carry tokens."""
    counted = spend.where(F.col("tokens") > 0)
    return ordered_scan(counted, ["run_id"], ["started_at", "seq"], {"running": running_sum(F.col("tokens"))}, hot_rows)


def soft_limit_crossing(
    spend: DataFrame, cap: int, soft_percent: float = SOFT_LIMIT_PERCENT, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """First record of every run at which the running total reaches the soft limit."""
    reached = cumulative_spend(spend, hot_rows).where(F.col("running") >= cap * soft_percent / 100.0)
    return reached.groupBy("run_id").agg(
        F.min_by(F.struct("seq", "running"), F.struct("started_at", "seq")).alias("first")
    ).select("run_id", "first.*")


def with_price(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Add input and output price per million tokens.

    The model id is looked up whole, then without the part before its first slash; a local model
    without a price is free, any other unknown one has a NULL price.
    """
    short = F.regexp_extract("model", "^[^/]*/(.*)$", 1)
    exact = prices.select(
        F.col("model").alias("__exact"), F.col("input_per_1m").alias("__in"), F.col("output_per_1m").alias("__out")
    )
    stripped = prices.select(
        F.col("model").alias("__short"), F.col("input_per_1m").alias("__in2"), F.col("output_per_1m").alias("__out2")
    )
    joined = rows.join(exact, F.col("model") == F.col("__exact"), "left").join(
        stripped, F.col("__exact").isNull() & (F.when(short != "", short) == F.col("__short")), "left"
    )
    free = F.when(F.col("model").startswith(FREE_PREFIX), F.lit(0.0))
    return joined.select(
        *rows.columns,
        F.coalesce("__in", "__in2", free).alias("input_per_1m"),
        F.coalesce("__out", "__out2", free).alias("output_per_1m"),
    )


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of a priced row; an unknown price costs nothing."""
    return input_tokens / 1e6 * F.coalesce("input_per_1m", F.lit(0.0)) + output_tokens / 1e6 * F.coalesce(
        "output_per_1m", F.lit(0.0)
    )


def apportion(spend: DataFrame, totals: DataFrame, prices: DataFrame) -> DataFrame:
    """Split the input and output totals of a run over its agents by their share, and price them.

    ``totals``: run_id, model, total_input, total_output. Halves round to even.
    """
    per_agent = spend_by(spend, ["run_id", "agent"])
    share = ratio_or_zero(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("run_id")))
    split = (
        per_agent.withColumn("share", share)
        .join(totals, "run_id")
        .select(
            "run_id",
            "agent",
            "model",
            F.bround(F.col("total_input") * F.col("share")).cast("long").alias("input_tokens"),
            F.bround(F.col("total_output") * F.col("share")).cast("long").alias("output_tokens"),
        )
    )
    priced = with_price(split, prices)
    return priced.withColumn("cost_usd", cost(F.col("input_tokens"), F.col("output_tokens")))


def task_cost(rows: DataFrame, task: str) -> DataFrame:
    return rows.groupBy(task).agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("n"))
