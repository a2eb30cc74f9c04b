"""Profiling, quality and role inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.fixtures import (
    DOCS_DTYPES,
    LABELLED_DOCUMENTS,
    ORDERS_DTYPES,
    ORDERS_WITH_GAPS,
    labelled_documents,
    orders_with_gaps,
    profile_sql,
)
from millrace.catalog.registry import query
from millrace.operators import profile, quality, roles

_ORDERS_PROFILE = profile_sql("gaps", ORDERS_DTYPES)
_DOCS_PROFILE = profile_sql("docs", DOCS_DTYPES)


@query("profile_columns", f"WITH {ORDERS_WITH_GAPS} {_ORDERS_PROFILE}")
def profile_columns(t):
    return profile.column_profile(orders_with_gaps(t))


@query(
    "profile_views",
    f"""WITH {ORDERS_WITH_GAPS}, p AS ({_ORDERS_PROFILE}),
    c AS (SELECT 'o_custkey' AS "column", round(corr(o_custkey, o_totalprice), 6) AS correlation FROM gaps
          UNION ALL SELECT 'o_orderkey', round(corr(o_orderkey, o_totalprice), 6) FROM gaps)
    SELECT p."column", p.dtype, p.n_rows, p.n_missing, p.n_distinct, p.is_constant, c.correlation
    FROM p LEFT JOIN c ON c."column" = p."column" """,
)
def profile_views(t):
    orders = orders_with_gaps(t)
    tables = profile.profile_dataset(orders, target="o_totalprice")
    explored = profile.explore_view(tables["columns"], tables["correlations"])
    return profile.describe_view(tables["columns"]).join(explored.drop("n_missing"), "column").withColumn(
        "correlation", F.round("correlation", 6)
    )


@query(
    "profile_target_distribution",
    f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderpriority AS value, count(*) AS n FROM gaps GROUP BY 1
    ORDER BY n DESC, value NULLS FIRST LIMIT 20""",
)
def profile_target_distribution(t):
    return profile.target_distribution(orders_with_gaps(t), "o_orderpriority")


@query(
    "profile_target_moments",
    """SELECT count(*) - count(l_extendedprice) AS n_missing, count(DISTINCT l_extendedprice) AS n_unique,
    round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem""",
)
def profile_target_moments(t):
    moments = profile.target_moments(t.lineitem, "l_extendedprice")
    return moments.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query(
    "profile_correlations",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS correlation FROM lineitem"
        for c in _LINE_NUMBERS
    ),
)
def profile_correlations(t):
    return profile.target_correlations(t.lineitem, "l_extendedprice").withColumn(
        "correlation", F.round("correlation", 6)
    )


@query(
    "profile_duplicate_keys",
    """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys,
    count(*) - count(DISTINCT l_orderkey) AS duplicate_rows FROM lineitem""",
)
def profile_duplicate_keys(t):
    return profile.duplicate_keys(t.lineitem, ["l_orderkey"])


_CUSTOMER_TEXT = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "raw_string_profile",
    "WITH cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", c_custkey AS pos, NULLIF(trim(CAST({c} AS VARCHAR)), '') AS cell FROM customer"
        for c in _CUSTOMER_TEXT
    )
    + """),
    firsts AS (SELECT "column", cell, min(pos) AS first_at FROM cells WHERE cell IS NOT NULL GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first_at, cell) AS rk FROM firsts),
    samples AS (SELECT "column", string_agg(cell, '|' ORDER BY rk) AS samples,
        bool_and(TRY_CAST(replace(cell, ',', '') AS DOUBLE) IS NOT NULL) AS numeric,
        bool_and(NOT contains(cell, '.') AND NOT contains(lower(cell), 'e')) AS whole,
        bool_or(length(cell) > 80) AS long FROM ranked WHERE rk <= 5 GROUP BY 1)
    SELECT c."column", count(*) - count(cell) AS n_missing, count(DISTINCT cell) AS n_unique,
        CASE WHEN any_value(s.numeric) AND any_value(s.whole) THEN 'integer' WHEN any_value(s.numeric) THEN 'float'
             WHEN any_value(s.long) THEN 'text' ELSE 'string' END AS dtype, any_value(s.samples) AS samples
    FROM cells c JOIN samples s ON s."column" = c."column" GROUP BY c."column" """,
)
def raw_string_profile(t):
    customer = t.customer
    text = customer.select(F.col("c_custkey").alias("pos"), *[F.col(c).cast("string").alias(c) for c in customer.columns])
    return profile.raw_string_profile(text, "pos").withColumn("samples", F.array_join("samples", "|"))


@query(
    "column_set_diff",
    f"""WITH {ORDERS_WITH_GAPS}, p AS ({_ORDERS_PROFILE})
    SELECT "column", CASE WHEN "column" = 'o_totalprice' THEN 'only_train' ELSE 'shared' END AS place,
      n_missing AS missing_in_train FROM p UNION ALL SELECT 'o_score', 'only_test', NULL""",
)
def column_set_diff(t):
    """Column names on either side, with how much of each is missing in train."""
    train = orders_with_gaps(t)
    test = train.drop("o_totalprice").withColumn("o_score", F.lit(0))
    sides = profile.column_set_diff(t.spark, train.columns, test.columns)
    missing = profile.missing_counts(train, "missing_in_train").drop("n_rows")
    return sides.join(missing, "column", "left")


_GATE_RULES = """
    SELECT "column", rule, CASE WHEN rule IN ('structural_absence', 'documented_missing', 'some_missing')
        THEN 'tolerable' ELSE 'blocker' END AS severity, round(n_missing / n_rows, 6) AS rate
    FROM (SELECT *, CASE
            WHEN "column" = 'source' THEN CASE WHEN n_missing > 0 THEN 'target_missing' END
            WHEN n_missing > 0 AND "column" = 'toxic' THEN 'structural_absence'
            WHEN n_missing / n_rows >= 0.6 THEN 'undocumented_missing'
            WHEN n_missing / n_rows >= 0.05 THEN 'some_missing' END AS rule FROM p
          UNION ALL SELECT *, CASE WHEN is_constant AND "column" <> 'source' THEN 'constant' END FROM p)
    WHERE rule IS NOT NULL"""


@query(
    "quality_gate",
    f"""WITH {LABELLED_DOCUMENTS}, p AS ({_DOCS_PROFILE}) {_GATE_RULES}
    UNION ALL SELECT NULL, 'duplicate_ids', 'blocker',
      round((count(*) - count(DISTINCT lang)) / count(*), 6) FROM docs HAVING count(*) > count(DISTINCT lang)""",
)
def quality_gate(t):
    docs = labelled_documents(t)
    findings = quality.quality_gate(
        profile.column_profile(docs), "source", na_means_absent=["toxic"],
        id_duplicates=profile.duplicate_keys(docs, ["lang"]),
    )
    return findings.withColumn("rate", F.round("rate", 6))


@query(
    "null_scan",
    f"WITH {LABELLED_DOCUMENTS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM docs" for c in DOCS_DTYPES
    ),
)
def null_scan(t):
    return profile.missing_counts(labelled_documents(t))


@query(
    "infer_roles",
    f"""WITH {LABELLED_DOCUMENTS}, p AS ({_DOCS_PROFILE}),
    target AS (SELECT 'target' AS role, "column", score FROM (
      SELECT "column", 0 - CASE WHEN n_missing > 0.4 * n_rows THEN 40 ELSE 0 END
        + CASE WHEN n_distinct BETWEEN 2 AND 20 THEN 40 WHEN n_distinct <= 50 THEN 15 ELSE 0 END
        + CASE WHEN "column" IN ('quality') THEN 80 ELSE 0 END AS score
      FROM p WHERE n_distinct > 1 AND n_distinct <> n_rows AND NOT (n_rows >= 20 AND n_distinct >= floor(0.95 * n_rows)))
      WHERE score >= 40 ORDER BY score DESC, "column" LIMIT 1)
    SELECT * FROM target UNION ALL
    (SELECT 'id', "column", 10 + CASE WHEN regexp_matches("column", '(?:^|_)id$') THEN 50 ELSE 0 END
        + CASE WHEN dtype = 'int' THEN 20 ELSE 0 END AS score
     FROM p WHERE n_distinct = n_rows AND "column" NOT IN (SELECT "column" FROM target) ORDER BY score DESC, "column" LIMIT 1)""",
)
def infer_roles(t):
    return roles.infer_roles(profile.column_profile(labelled_documents(t)), only_in_train=["quality"])


_PART_DTYPES = {
    "p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float",
}


@query(
    "target_candidates",
    f"""WITH p AS ({profile_sql('part', _PART_DTYPES)})
    SELECT "column", CAST(CASE WHEN "column" = 'p_retailprice' THEN 45 ELSE 0 END
      + CASE WHEN dtype IN ('int', 'float') AND n_distinct > 20 THEN 40 ELSE 0 END AS INTEGER) AS score
    FROM p WHERE n_distinct > 1 AND n_distinct <> n_rows AND NOT (n_rows >= 20 AND n_distinct >= floor(0.95 * n_rows))""",
)
def target_candidates(t):
    return roles.target_candidates(profile.column_profile(t.part), problem_type="regression")


@query(
    "infer_hints",
    f"""WITH {LABELLED_DOCUMENTS}, p AS ({_DOCS_PROFILE} UNION ALL {profile_sql('part', _PART_DTYPES)})
    SELECT * FROM (SELECT "column", CASE WHEN dtype IN ('int', 'float', 'bool') THEN CASE WHEN n_missing > 0 THEN 'numeric_with_missing' END
      WHEN n_distinct >= greatest(50, floor(0.3 * n_rows)) OR (n_rows >= 8 AND n_distinct >= floor(0.8 * n_rows)) THEN 'text_free'
      WHEN n_distinct BETWEEN 2 AND 50 THEN 'categorical_weak' END AS hint, n_distinct
    FROM p WHERE "column" NOT IN ('doc_id', 'p_partkey')) WHERE hint IS NOT NULL""",
)
def infer_hints(t):
    both = profile.column_profile(labelled_documents(t)).unionByName(profile.column_profile(t.part))
    return roles.infer_hints(both, ["doc_id", "p_partkey"])


@query(
    "preflight_summary",
    f"""WITH {ORDERS_WITH_GAPS}, p AS ({_ORDERS_PROFILE})
    SELECT "column", dtype, n_missing, n_rows AS train_rows, "column" <> 'o_orderstatus' AS in_test,
      "column" = 'o_orderstatus' AS is_target FROM p""",
)
def preflight_summary(t):
    train = orders_with_gaps(t)
    return profile.preflight_summary(train, train.drop("o_orderstatus"), "o_orderstatus")


@query(
    "target_describe",
    f"""WITH {ORDERS_WITH_GAPS}, s AS (SELECT count(o_totalprice)::DOUBLE AS n, avg(o_totalprice) AS m,
      stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS mn, max(o_totalprice) AS mx,
      quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2,
      quantile_cont(o_totalprice, 0.75) AS q3 FROM gaps)
    SELECT statistic, round(value, 4) AS value FROM (
      SELECT 'count' AS statistic, n AS value FROM s UNION ALL SELECT 'mean', m FROM s UNION ALL SELECT 'std', sd FROM s
      UNION ALL SELECT 'min', mn FROM s UNION ALL SELECT '25%', q1 FROM s UNION ALL SELECT '50%', q2 FROM s
      UNION ALL SELECT '75%', q3 FROM s UNION ALL SELECT 'max', mx FROM s)""",
)
def target_describe(t):
    return profile.target_describe(orders_with_gaps(t), "o_totalprice").withColumn("value", F.round("value", 4))


_FILE_NAME = """list_extract(['train', 'test', 'holdout', 'sample_submission', 'contest', 'notes'], CAST(length(text) % 6 + 1 AS INTEGER))
      || '_' || lang || '_' || doc_id || list_extract(['.csv', '.csv', '.tsv', '.md', '.png'], CAST(n_chars % 5 + 1 AS INTEGER))"""

FILES = f"""files AS (SELECT doc_id AS position, source AS case_id, {_FILE_NAME} AS path FROM documents)"""


def files(t):
    """Documents as a catalog of uploaded files: one case per source."""
    stem = F.element_at(
        F.array(*[F.lit(x) for x in ("train", "test", "holdout", "sample_submission", "contest", "notes")]),
        (F.length("text") % 6 + 1).cast("int"),
    )
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".csv", ".tsv", ".md", ".png")]), (F.col("n_chars") % 5 + 1).cast("int"))
    path = F.concat(stem, F.lit("_"), "lang", F.lit("_"), F.col("doc_id").cast("string"), suffix)
    return t.documents.select(
        F.col("doc_id").alias("position"), F.col("source").alias("case_id"), path.alias("path"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("original_filename"),
    )


SOURCE_ROLES = f"""{FILES}, named AS (SELECT *, CASE WHEN path LIKE 'sample_submission%' THEN 'sample_submission'
      WHEN path LIKE 'train%' THEN 'train' WHEN path LIKE 'test%' OR path LIKE 'holdout%' THEN 'test' ELSE '' END AS r,
      path LIKE '%.csv' OR path LIKE '%.tsv' AS is_table FROM files),
    roles AS (SELECT case_id, coalesce(arg_min(path, position) FILTER (r = 'train'),
      arg_min(path, position) FILTER (is_table AND r NOT IN ('test', 'sample_submission')),
      arg_min(path, position) FILTER (is_table AND r <> 'sample_submission')) AS train,
      arg_min(path, position) FILTER (r = 'test') AS test,
      arg_min(path, position) FILTER (r = 'sample_submission') AS sample_submission FROM named GROUP BY case_id)"""


@query("source_roles", f"WITH {SOURCE_ROLES} SELECT * FROM roles")
def source_roles(t):
    return roles.source_roles(files(t), ["case_id"])


@query(
    "reconcile_paths",
    f"""WITH {SOURCE_ROLES}, configured AS (SELECT case_id, arg_min(path, position) AS train, NULL::VARCHAR AS test FROM files GROUP BY 1),
    step AS (SELECT c.case_id, CASE WHEN r.train IS NOT NULL AND (c.train LIKE 'test%' OR c.train LIKE 'holdout%') THEN r.train ELSE c.train END AS train,
      r.train AS found_train, r.test AS found_test, r.sample_submission FROM configured c LEFT JOIN roles r ON r.case_id = c.case_id)
    SELECT case_id, train, CASE WHEN found_test IS DISTINCT FROM train THEN found_test END AS test, sample_submission FROM step""",
)
def reconcile_paths(t):
    catalog = files(t)
    blank = F.lit(None).cast("string")
    configured = catalog.groupBy("case_id").agg(F.min_by("path", "position").alias("train")).select(
        "case_id", "train", blank.alias("test"), blank.alias("sample_submission")
    )
    return roles.reconcile_paths(configured, roles.source_roles(catalog, ["case_id"]), ["case_id"])


@query(
    "label_codec",
    """SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)""",
)
def label_codec(t):
    return roles.label_codec(t.orders, "o_orderpriority")
