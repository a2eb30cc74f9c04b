"""Cleaning pipeline over ``documents``: five stages, each by one operator of ``millrace.llm``.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last one returns the
packed pieces. A filtering stage drops only the documents it decides against. Near duplicates: two documents
link when their sets of ``SHINGLE`` consecutive words have a Jaccard similarity of ``SIMILARITY`` percent or
more, and of each connected group the document with the smallest doc_id stays.

Defined cases are those of the operators; a document without text passes all filters, and rows without
doc_id pass the filters that need one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, packing, substrings, toxicity
from millrace.llm.common import private_name, table, written

SHINGLE, SIMILARITY = 5, 80
TOKENIZER = "word_bpe_49k.json"

#: The stages use numpy inside tasks, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; labels of held-out rows are not learned from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = private_name(docs, "toxicity_score")
    scored = toxicity.add_scores(docs, model, score, private_name(docs, "toxicity_evidence"))
    return scored.filter(F.col(score) < 0.5).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_first_of_groups(docs, SHINGLE, SIMILARITY)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has; n_chars follows the text."""
    lost = private_name(docs, "words_removed")
    cut = substrings.dedup_substrings(docs, measures=(private_name(docs, "words_before"), lost), rejoin=False)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(lost) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in 20 lie in benchmark windows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 token ids."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
