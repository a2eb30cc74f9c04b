"""Queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, table
from millrace.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.substrings import dedup_substrings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce("text", F.lit("")).cast("binary")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import add_scores, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "evidence")


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLE["op5_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS s FROM i WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d JOIN lens ON len(w) >= n)
),
occ AS (SELECT rid, s, n, item FROM dw JOIN iw USING (n, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM occ WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


@query
def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ppm import add_languages, fit

    docs = table(spark, sf_dir, "documents")
    found = add_languages(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op8_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.hnsw import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.tokenfiles import token_file_rows

    docs = table(spark, sf_dir, "documents")
    return token_file_rows(spark, docs, shared_folder(spark, "token-files"), tokenizer_path("byte_bpe_50k.json"))


@query
def op10_html_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.extraction import extract, fit

    pages = table(spark, sf_dir, "pages")
    found = extract(pages.select("page_id", "url", "html"), fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op13_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lexical import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLE["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
lens AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lens),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY rid, term
),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
),
part AS (
  SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS s
  FROM tf JOIN weight USING (term) JOIN lens USING (rid), total
),
scored AS (
  SELECT item_id, doc_id, rid, CAST(sum(s) AS BIGINT) AS score
  FROM i JOIN part USING (term) JOIN lens USING (rid) GROUP BY item_id, doc_id, rid
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS pid, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, w[s + 1 : s + k] AS ph
  FROM (SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM p, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k)
),
f AS (SELECT lang, k, ph, count(*) AS a FROM g GROUP BY lang, k, ph HAVING count(*) >= 30),
inside AS (
  SELECT b.lang, b.ph[s + 1 : s + j] AS ph, max(b.a) AS m
  FROM (SELECT lang, ph, a, j, unnest(range(0, k - j + 1)) AS s FROM f, (VALUES (2), (3)) AS js(j) WHERE j < k) AS b
  GROUP BY 1, 2
),
kept AS (
  SELECT f.* FROM f LEFT JOIN inside USING (lang, ph) WHERE f.k > 1 AND (m IS NULL OR 100 * m::HUGEINT < 80 * a::HUGEINT)
),
cut AS (
  SELECT kept.lang, kept.k, kept.ph, kept.a, c, x.a AS l, y.a AS r, CAST((2000000 * kept.a::HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept) AS kept
  JOIN f AS x ON x.lang = kept.lang AND x.ph = kept.ph[1 : c] JOIN f AS y ON y.lang = kept.lang AND y.ph = kept.ph[c + 1 : kept.k]
),
best AS (
  SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score
  FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, c) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best) JOIN tot USING (lang)
WHERE rank <= 2000
"""
