"""Token spend and communications."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.fixtures import SPEND, spend
from millrace.catalog.registry import query
from millrace.functions import numbers
from millrace.operators import spend as ops

CAP = 5000
CAPS = [("view", 1000), ("click", 800), ("purchase", 1500), ("signup", 100000)]
_CAPS = "caps AS (SELECT * FROM (VALUES ('view', 1000::BIGINT), ('click', 800), ('purchase', 1500), ('signup', 100000)) v(agent, cap))"


def _caps(t):
    return t.spark.createDataFrame(CAPS, "agent string, cap long")


def _communications(t):
    """Turns as model calls; answers of the assistant carry the outcome."""
    size = F.length("text")
    answer = F.col("role") == "assistant"
    return t.conversations.select(
        F.when(F.col("role") != "system", F.col("role")).alias("agent"),
        F.when(F.col("turn") > 2, "large").otherwise("small").alias("model"),
        F.when(size > 50, size.cast("long")).alias("tokens"),
        F.when(~answer, (size * 2).cast("double")).alias("duration_ms"),
        size.cast("long").alias("prompt_chars"),
        F.when(answer, size.cast("long")).alias("response_chars"),
        answer.alias("outcome_known"),
        F.contains("text", F.lit(".")).alias("parse_ok"),
    )


_COMMUNICATIONS = """comms AS (SELECT CASE WHEN role <> 'system' THEN role ELSE 'unknown' END AS agent, CASE WHEN turn > 2 THEN 'large' ELSE 'small' END AS model, length(text) AS n, role = 'assistant' AS answer, contains(text, '.') AS ok FROM conversations)"""


@query(
    "comm_summary",
    f"""WITH {_COMMUNICATIONS} SELECT agent, model, CASE WHEN grouping(agent) = 0 THEN 'agent' WHEN grouping(model) = 0 THEN 'model' ELSE 'total' END AS level, count(*) AS turns,
      CAST(coalesce(sum(CASE WHEN n > 50 THEN n END), 0) AS BIGINT) AS total_tokens, count(*) FILTER (answer AND NOT ok) AS parse_failures,
      round(avg(CASE WHEN NOT answer THEN n * 2.0::DOUBLE END), 6) AS avg_duration_ms, CAST(sum(n) AS BIGINT) AS prompt_chars, CAST(coalesce(sum(CASE WHEN answer THEN n END), 0) AS BIGINT) AS response_chars
    FROM comms GROUP BY GROUPING SETS ((), (agent), (model))""",
)
def comm_summary(t):
    return ops.communications_summary(_communications(t)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query(
    "spend_shares",
    f"""WITH {SPEND}, {_CAPS}, p AS (SELECT run_id, agent, CAST(sum(tokens) AS BIGINT) AS tokens FROM spend GROUP BY 1, 2)
    SELECT run_id, p.agent, tokens, coalesce(round_even(100.0 * (tokens / sum(tokens) OVER (PARTITION BY run_id)), 1), 0) AS pct_of_total, cap,
      round_even(100.0 * (tokens / cap), 1) AS pct_of_cap, first_value(p.agent) OVER (PARTITION BY run_id ORDER BY tokens DESC, p.agent) AS top_agent FROM p LEFT JOIN caps ON caps.agent = p.agent""",
)
def spend_shares(t):
    return ops.spend_shares(spend(t), _caps(t))


@query("spend_rank", f"""WITH {SPEND} SELECT agent, CAST(sum(tokens) AS BIGINT) AS tokens FROM spend GROUP BY 1""")
def spend_rank(t):
    return ops.spend_by(spend(t), ["agent"]).orderBy(F.desc("tokens"), "agent")


@query(
    "budget_status",
    f"""WITH {SPEND}, s AS (SELECT run_id, CAST(sum(tokens) AS BIGINT) AS spent FROM spend GROUP BY 1)
    SELECT run_id, CASE WHEN run_id % 10 > 0 THEN {CAP}::BIGINT END AS cap, spent, CASE WHEN run_id % 10 > 0 THEN greatest({CAP} - spent, 0) END AS remaining,
      CASE WHEN run_id % 10 > 0 THEN round_even(100.0 * (spent / {CAP}), 1) END AS pct, run_id % 10 > 0 AND spent >= 0.8 * {CAP} AS soft_limit, run_id % 10 > 0 AND spent >= {CAP} AS over FROM s""",
)
def budget_status(t):
    return ops.budget_status(spend(t), F.when(F.col("run_id") % 10 > 0, CAP))


@query(
    "agent_budget",
    f"""WITH {SPEND}, {_CAPS}, s AS (SELECT run_id, agent, CAST(sum(tokens) AS BIGINT) AS spent FROM spend GROUP BY 1, 2)
    SELECT run_id, s.agent, spent, cap, CASE WHEN cap IS NOT NULL THEN greatest(cap - spent, 0) END AS remaining, coalesce(spent >= cap, false) AS over FROM s LEFT JOIN caps ON caps.agent = s.agent""",
)
def agent_budget(t):
    return ops.agent_budget(spend(t), _caps(t))


_RUNNING = "running AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY run_id ORDER BY started_at, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM spend WHERE tokens > 0)"


@query("cumulative_spend", f"WITH {SPEND}, {_RUNNING} SELECT run_id, seq, tokens, running FROM running")
def cumulative_spend(t):
    return ops.cumulative_spend(spend(t)).select("run_id", "seq", "tokens", "running")


@query(
    "soft_limit_crossing",
    f"WITH {SPEND}, {_RUNNING} SELECT run_id, arg_min(seq, started_at) AS seq, min(running) AS running FROM running WHERE running >= {CAP} * 0.8 GROUP BY 1",
)
def soft_limit_crossing(t):
    return ops.soft_limit_crossing(spend(t), CAP)


PRICES = [("alpha-large", 3.0, 15.0), ("ECONOMY", 0.5, 1.5), ("PROMO", 1.0, 2.0)]
_PRICES = "prices AS (SELECT * FROM (VALUES ('alpha-large', 3.0::DOUBLE, 15.0::DOUBLE), ('ECONOMY', 0.5, 1.5), ('PROMO', 1.0, 2.0)) v(model, pin, pout))"


def _prices(t):
    return t.spark.createDataFrame(PRICES, "model string, input_per_1m double, output_per_1m double")


@query(
    "price_lookup",
    f"""WITH {_PRICES}, m AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN p_type WHEN p_size < 30 THEN 'vendor/' || p_type WHEN p_size < 45 THEN 'ollama/' || p_type ELSE 'alpha-large' END AS model FROM part)
    SELECT p_partkey, m.model, coalesce(e.pin, s.pin, CASE WHEN starts_with(m.model, 'ollama/') THEN 0.0 END) AS input_per_1m, coalesce(e.pout, s.pout, CASE WHEN starts_with(m.model, 'ollama/') THEN 0.0 END) AS output_per_1m
    FROM m LEFT JOIN prices e ON e.model = m.model LEFT JOIN prices s ON e.model IS NULL AND contains(m.model, '/') AND s.model = split_part(m.model, '/', 2)""",
)
def price_lookup(t):
    size, kind = F.col("p_size"), F.col("p_type")
    model = F.when(size < 10, kind).when(size < 30, F.concat(F.lit("vendor/"), kind)).when(size < 45, F.concat(F.lit("ollama/"), kind)).otherwise("alpha-large")
    return ops.with_price(t.part.select("p_partkey", model.alias("model")), _prices(t))


_APPORTIONED = f"""{SPEND}, {_PRICES}, p AS (SELECT run_id, agent, CAST(sum(tokens) AS BIGINT) AS tokens FROM spend GROUP BY 1, 2),
    totals AS (SELECT c_custkey AS run_id, CASE WHEN c_acctbal > 0 THEN 'vendor/PROMO' ELSE 'unlisted' END AS model, CAST(floor(abs(c_acctbal)) AS BIGINT) AS total_input, CAST(floor(abs(c_acctbal) * 3) AS BIGINT) AS total_output FROM customer),
    sh AS (SELECT *, tokens / sum(tokens) OVER (PARTITION BY run_id) AS share FROM p),
    split AS (SELECT sh.run_id, agent, model, CAST(round_even(total_input * share, 0) AS BIGINT) AS input_tokens, CAST(round_even(total_output * share, 0) AS BIGINT) AS output_tokens FROM sh JOIN totals ON totals.run_id = sh.run_id),
    priced AS (SELECT *, CASE WHEN model = 'vendor/PROMO' THEN input_tokens / 1e6 * 1.0 + output_tokens / 1e6 * 2.0 ELSE 0 END AS cost_usd FROM split)"""


def _apportioned(t):
    balance = F.abs("c_acctbal")
    totals = t.customer.select(
        F.col("c_custkey").alias("run_id"), F.when(F.col("c_acctbal") > 0, "vendor/PROMO").otherwise("unlisted").alias("model"),
        F.floor(balance).alias("total_input"), F.floor(balance * 3).alias("total_output"),
    )
    return ops.apportion(spend(t), totals, _prices(t))


@query("spend_apportion", f"WITH {_APPORTIONED} SELECT run_id, agent, input_tokens, output_tokens, round(cost_usd, 9) AS cost_usd FROM priced")
def spend_apportion(t):
    return _apportioned(t).select("run_id", "agent", "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query("task_cost", f"WITH {_APPORTIONED} SELECT run_id, round(sum(cost_usd), 8) AS cost_usd, count(*) AS n FROM priced GROUP BY 1")
def task_cost(t):
    return ops.task_cost(_apportioned(t), "run_id").withColumn("cost_usd", F.round("cost_usd", 8))


@query(
    "token_usage_pick",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey + o_orderkey WHEN o_orderstatus = 'F' THEN o_custkey ELSE CAST(floor(o_totalprice) AS BIGINT) END AS tokens FROM orders""",
)
def token_usage_pick(t):
    status = F.col("o_orderstatus")
    prompt = F.when(status != "O", F.col("o_custkey"))
    completion = F.when(status == "P", F.col("o_orderkey"))
    return t.orders.select("o_orderkey", numbers.token_total(prompt, completion, F.floor("o_totalprice")).alias("tokens"))


@query(
    "time_diff",
    "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000 AS elapsed_ms FROM events",
)
def time_diff(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return t.events.select("event_id", numbers.elapsed_ms(start, F.to_timestamp(text)).alias("elapsed_ms"))
