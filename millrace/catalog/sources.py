"""Sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.fixtures import ORDERS_SPLIT, ORDERS_WITH_GAPS, orders_test, orders_train, orders_with_gaps
from millrace.catalog.profiling import FILES, files
from millrace.catalog.registry import query
from millrace.operators import prep
from millrace.session import shared_folder
from millrace.sources import csvfiles, jsonlines, listing, stages


@query(
    "csv_roundtrip",
    """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer""",
)
def csv_roundtrip(t):
    """Types are inferred on the way back, and NA means missing."""
    folder = shared_folder(t.spark, "csv")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment"))
    csvfiles.write_csv(t.customer.withColumn("c_mktsegment", segment), folder)
    return csvfiles.read_csv(t.spark, folder)


@query(
    "csv_encodings",
    """SELECT doc_id, text FROM documents""",
)
def csv_encodings(t):
    """Half of the files are Latin-1 with their columns in another order, the other half UTF-8; texts keep
    their line breaks."""
    folder = shared_folder(t.spark, "encodings")
    rows = t.documents.select("doc_id", "text", "lang")
    rows = rows.withColumn("fits", ~F.col("text").rlike("[^\\x00-\\xff]") & (F.col("lang") == "fr"))
    rows.where("fits").select("text", "doc_id").write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(f"{folder}/narrow")
    rows.where("not fits").drop("fits", "lang").write.option("header", True).option("escape", '"').csv(f"{folder}/wide")
    return csvfiles.read_csv(t.spark, f"{folder}/*", schema="doc_id long, text string")


@query("csv_strings", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part")
def csv_strings(t):
    """Short rows are padded with NULL and surplus cells dropped; every file has the header."""
    folder = shared_folder(t.spark, "strings")
    short = F.concat_ws(";", F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit("  ")), "p_name")
    line = F.when(F.col("p_size") > 25, F.concat(short, F.lit("; "), "p_type", F.lit(";surplus;cells"))).otherwise(short)
    # One column, written as it is: the header of the file is the name of that column.
    t.part.select(line.alias("p_partkey ; p_name;p_type")).write.option("header", True).option("quote", "").option("sep", "\t").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return csvfiles.read_strings(t.spark, folder)


@query(
    "delimiter_sniff",
    """SELECT lang, CASE lang WHEN 'en' THEN ';' WHEN 'fr' THEN chr(9) WHEN 'de' THEN '|' ELSE ',' END AS sep FROM documents GROUP BY lang""",
)
def delimiter_sniff(t):
    """One folder per language, written with a delimiter of its own."""
    folder = shared_folder(t.spark, "sniff")
    sep = F.when(F.col("lang") == "en", ";").when(F.col("lang") == "fr", "\t").when(F.col("lang") == "de", "|").otherwise(",")
    line = F.concat_ws("~", F.col("doc_id").cast("string"), "source", F.col("n_chars").cast("string"))
    t.documents.select("lang", F.replace(line, F.lit("~"), sep).alias("value")).write.partitionBy("lang").text(folder)
    found = listing.list_files(t.spark, f"{folder}/*")
    heads = csvfiles.file_heads(found).withColumn("lang", F.regexp_extract("path", "lang=([a-z]+)", 1))
    return heads.select("lang", csvfiles.sniff_delimiter(F.col("head")).alias("sep")).distinct()


@query(
    "parquet_stage",
    f"""WITH {ORDERS_SPLIT} SELECT 'train' AS side, o_orderkey, o_totalprice, CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice_missing FROM train
    UNION ALL SELECT 'test', o_orderkey, o_totalprice, CAST(o_totalprice IS NULL AS INTEGER) FROM test""",
)
def parquet_stage(t):
    """The format step reads the constructed stage, the latest one that exists."""
    store = stages.StageStore(t.spark, shared_folder(t.spark, "stages"), f"{t.sf_dir}/orders.parquet", f"{t.sf_dir}/orders.parquet")
    train, test = orders_train(t), orders_test(t)
    store.write("clean", train, test)
    clean_train, clean_test = store.read("3.3")
    columns = ["o_totalprice"]
    store.write("constructed", prep.missing_indicators(clean_train, columns), prep.missing_indicators(clean_test, columns))
    train, test = store.read("3.5")
    keep = ["o_orderkey", "o_totalprice", "o_totalprice_missing"]
    return train.select(F.lit("train").alias("side"), *keep).unionByName(test.select(F.lit("test").alias("side"), *keep))


@query("first_rows", f"WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, o_totalprice FROM gaps ORDER BY o_orderdate, o_orderkey LIMIT 5000")
def first_rows(t):
    return stages.first_rows(orders_with_gaps(t), ["o_orderdate", "o_orderkey"], 5000).select("o_orderkey", "o_totalprice")


@query("jsonl_roundtrip", "SELECT event_id, user_id, event_type, value, ts FROM events UNION ALL SELECT event_id, user_id, 'again', value, ts FROM events WHERE event_type = 'error'")
def jsonl_roundtrip(t):
    folder = shared_folder(t.spark, "jsonl")
    rows = t.events.select("event_id", "user_id", "event_type", "value", "ts")
    jsonlines.append(rows, folder)
    jsonlines.append(rows.where("event_type = 'error'").withColumn("event_type", F.lit("again")), folder)
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"
    return jsonlines.read_tolerant(t.spark, folder, schema, keep_malformed=False).drop("malformed")


@query(
    "jsonl_tolerant",
    """SELECT count(*) AS lines, count(*) FILTER (event_type = 'error') AS malformed, (SELECT count(*) FROM events WHERE event_type <> 'error') AS readable, CAST(sum(CASE WHEN event_type <> 'error' THEN event_id END) AS BIGINT) AS id_sum FROM events""",
)
def jsonl_tolerant(t):
    """Broken and blank lines among good ones, under both policies."""
    folder = shared_folder(t.spark, "tolerant")
    good = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event')))
    t.events.select(F.explode(F.array(F.coalesce(line, good), F.lit(""))).alias("value")).write.text(folder)
    schema = "event_id long, event_type string"
    counted = jsonlines.read_tolerant(t.spark, folder, schema, keep_malformed=True)
    skipped = jsonlines.read_tolerant(t.spark, folder, schema, keep_malformed=False)
    return counted.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("malformed")).alias("malformed"),
        F.sum(F.when(~F.col("malformed"), F.col("event_id"))).alias("id_sum"),
    ).withColumn("readable", skipped.agg(F.count(F.lit(1))).scalar())


@query(
    "nested_trace_explode",
    "SELECT user_id AS run_id, event_id AS id, event_type AS type, 'k' AS attribute, json_extract_string(props, '$.k') AS value FROM events",
)
def nested_trace_explode(t):
    """Traces written with many events per document. A run is written as several documents, one per
    stretch of 100 events, so no document grows with the run."""
    folder = shared_folder(t.spark, "traces")
    event = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"),
        F.from_json("props", "map<string,string>").alias("attributes"),
    )
    documents = t.events.groupBy(F.col("user_id").cast("string").alias("run_id"), F.floor(F.col("event_id") / 100).alias("stretch")).agg(
        F.collect_list(event).alias("events")
    )
    documents.select("run_id", "events").write.json(folder)
    rows = jsonlines.read_traces(t.spark, folder, multi_line=False)
    return rows.select(
        F.col("run_id").cast("long").alias("run_id"), F.col("id").cast("long").alias("id"), "type", F.explode("attributes").alias("attribute", "value")
    )


@query(
    "text_corpus_scan",
    """SELECT lang, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT lang, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY lang""",
)
def text_corpus_scan(t):
    """Text files of the documents, a few for each language, read back whole."""
    folder = shared_folder(t.spark, "corpus")
    parts = t.documents.select("lang", (F.col("doc_id") % 20).alias("part"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]\n"), "text").alias("value"))
    parts.write.partitionBy("lang", "part").text(folder)
    files = listing.read_corpus(t.spark, folder, "*.txt", deep=True)
    lines = files.select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("value"))
    body = lines.where(~F.col("value").rlike(r"^\[[0-9]+\]$"))
    return body.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query(
    "run_manifests",
    """SELECT c_nationkey::VARCHAR AS case_id, c_custkey::VARCHAR AS run_id, c_mktsegment AS model, CASE WHEN c_acctbal < 0 THEN 'halted' WHEN c_acctbal < 5000 THEN 'complete' ELSE 'running' END AS state FROM customer""",
)
def run_manifests(t):
    """Manifest files found by their paths, joined with the status files; some runs have no status, some an open one."""
    root = shared_folder(t.spark, "manifests")
    runs = t.customer.select(F.col("c_nationkey").alias("case"), F.col("c_custkey").alias("run"), "c_mktsegment", "c_acctbal")
    # A folder for each case holds many runs in one file of this layout, so that runs are rows and not files.
    runs.select("case", F.struct(F.col("run").cast("string").alias("run_id"), F.col("c_mktsegment").alias("model")).alias("m")).select("case", "m.*").write.partitionBy("case").json(f"{root}/manifest")
    known = runs.where("c_acctbal < 7000")
    known.select("case", F.col("run").cast("string").alias("run_id"), (F.col("c_acctbal") < 0).alias("halted"), F.col("c_acctbal").between(0, 4999.995).alias("workflow_complete")).write.partitionBy("case").json(f"{root}/status")
    manifests = t.spark.read.schema("run_id string, model string, case string").json(f"{root}/manifest").withColumnRenamed("case", "case_id")
    status = t.spark.read.schema("run_id string, halted boolean, workflow_complete boolean, case string").json(f"{root}/status").withColumnRenamed("case", "case_id")
    return jsonlines.with_status(manifests, status).select("case_id", "run_id", "model", "state")


@query(
    "source_catalog",
    f"""WITH {FILES}, k AS (SELECT case_id, CASE WHEN path LIKE '%.png' THEN 'unsupported' WHEN path LIKE '%.md' THEN 'document' ELSE 'csv' END AS kind FROM files),
    c AS (SELECT case_id, count(*) AS n_files, count(*) FILTER (kind = 'csv') AS n_tables, count(*) FILTER (kind = 'unsupported') AS bad FROM k GROUP BY 1)
    SELECT case_id, n_files, n_tables, bad = 0 AND n_tables > 0 AS runnable, CASE WHEN bad > 0 AND n_tables = 0 THEN 'not_tabular' WHEN bad > 0 THEN 'some_not_tabular' WHEN n_tables = 0 THEN 'documents_only' END AS reason FROM c""",
)
def source_catalog(t):
    return listing.inspect_folder(files(t).withColumn("name", F.col("path")), ["case_id"])


@query(
    "keyed_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
def keyed_scan(t):
    """Tasks of the users of one segment, newest id first."""
    users = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    rows = stages.keyed_rows(t.orders, users, "o_custkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus").orderBy(F.desc("o_orderkey"))


@query(
    "manifest_fallback",
    "SELECT c_custkey AS run_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, CASE WHEN c_acctbal > 0 THEN 'primary' ELSE 'fallback' END AS origin FROM customer",
)
def manifest_fallback(t):
    everyone = t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("score"))
    primary = everyone.where("score > 0").withColumn("origin", F.lit("primary"))
    fallback = everyone.select("run_id", F.lit("fallback").alias("origin"))
    return jsonlines.read_first_available(primary, fallback, "run_id")
