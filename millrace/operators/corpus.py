"""Text corpus: section and paragraph chunks, merging, de-duplication and top-k retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import (
    NOT_SPACE,
    passage,
    passage_body,
    passage_key,
    strip,
    strip_headings,
    strip_leading_heading,
    unify_line_breaks,
)
from millrace.operators.retrieval import DEFAULT_K, embedding_top, keyword_top, label_centroids, query_table

__all__ = ["embedding_top", "keyword_top", "label_centroids"]

# Fixed values of the chunker.
CHUNK_CHARS = 1200
MERGE_CHARS = 400

_MARK = r"[ \t]*#{1,6}[ \t]+[^\n]*\S"
_HEADING = r"\A[ \t]*(#{1,6})[ \t]+([^\n]*[^\n \t])[ \t]*(?:\n|\z)"
_ONLY_HEADING = r"\A[ \t]*#{1,6}[ \t]+[^\n]*\S[ \t]*\n?\z"
_TITLE = r"\A[ \t]*#[ \t]+[^\n]*\S"
_POSITION = ["section_no", "paragraph_no", "piece_no"]


#: Tells rows with one source apart, from the first step of chunking to the last.
_ROW = "__row"


def _row_key(df: DataFrame) -> list[str]:
    return [_ROW] if _ROW in df.columns else []


def split_sections(documents: DataFrame, source: str, text: str) -> DataFrame:
    """``(source, section_no, section, body)`` of markdown texts, one whole file per row.

    The text is cut in front of every heading line. The first level-1 heading is the title and
    names no section. A text of headings only is one section holding the whole text.

    The steps are separate projections on purpose, so each array is built once; the outer
    explode keeps Spark from adding a filter that would build it again.
    """
    own = _row_key(documents)
    rows = documents.select(*own, F.col(source).alias("source"), unify_line_breaks(F.col(text)).alias("__clean"))
    cut = F.when(F.contains("__clean", F.lit("#")), F.split("__clean", rf"\n(?={_MARK})"))
    rows = rows.withColumn("__pieces", F.coalesce(cut, F.array("__clean")))
    rows = rows.select(
        *own,
        "source",
        "__pieces",
        F.array_position(F.transform("__pieces", lambda p: p.rlike(_TITLE)), F.lit(True)).alias("__title_at"),
        F.exists("__pieces", lambda p: (p != "") & ~p.rlike(_ONLY_HEADING)).alias("__has_lines"),
    )
    # Without any body line the whole text stays together under its title.
    whole = F.array(F.array_join("__pieces", "\n"))
    rows = rows.withColumn("__whole_title", F.when(~F.col("__has_lines"), F.get("__pieces", (F.col("__title_at") - 1).cast("int"))))
    rows = rows.withColumn("__pieces", F.when(F.col("__has_lines"), F.col("__pieces")).otherwise(whole))
    rows = rows.select(
        *own, "source", "__title_at", "__has_lines", "__whole_title", F.posexplode_outer("__pieces").alias("section_no", "__piece")
    )
    # Filters stay on plain columns: on a computed one Spark would compute it a second time below.
    rows = rows.where(~F.col("__has_lines") | ((F.col("__piece") != "") & ~F.col("__piece").rlike(_ONLY_HEADING)))
    heading = F.regexp_extract(F.when(F.col("__has_lines"), F.col("__piece")).otherwise(F.col("__whole_title")), _HEADING, 2)
    is_title = F.col("__has_lines") & (F.col("section_no") + 1 == F.col("__title_at"))
    body = F.when(F.col("__has_lines"), F.regexp_replace("__piece", _HEADING, "")).otherwise(F.col("__piece"))
    return rows.select(
        *own, "source", "section_no", F.when((heading != "") & ~is_title, heading).alias("section"), strip(body).alias("body")
    )


def _pieces(sections: DataFrame) -> DataFrame:
    """Paragraph pieces in order; a piece that held nothing but headings is blank."""
    keys = [*_row_key(sections), "source", "section_no", "section"]
    rows = sections.select(*keys, F.posexplode_outer(F.split("body", "\n\n")).alias("paragraph_no", "p"))
    rows = rows.where(F.col("p").rlike(NOT_SPACE)).withColumn("p", strip(F.col("p")))
    starts = F.sequence(F.lit(0), F.length("p") - 1, F.lit(CHUNK_CHARS))
    rows = rows.select(*keys, "paragraph_no", "p", F.posexplode_outer(starts).alias("piece_no", "__start"))
    piece = strip(F.substring(F.col("p"), F.col("__start") + 1, F.lit(CHUNK_CHARS)))
    bare = strip_leading_heading(F.when(F.col("piece_no") == 0, piece).otherwise(strip_headings(piece)))
    text = F.when(F.contains("p", F.lit("#")), bare).otherwise(piece)
    return rows.select(*keys, "paragraph_no", "piece_no", text.alias("text"))


def paragraph_chunks(sections: DataFrame) -> DataFrame:
    """Paragraphs of every section body, long ones cut every 1,200 characters."""
    return _pieces(sections).where("text <> ''")


def merge_small(chunks: DataFrame) -> DataFrame:
    """Join neighbours of one row (or one source) and section while the joined text stays short.

    Each decision depends on what was merged before, so this is a fold over the ordered rows of a partition. Chunks that
    ``chunk_documents`` made carry the key of their row, so rows with one source stay apart; without it the
    source is the key. All chunks of a row must be in one partition, which holds as long as they come from it by
    ``explode``; no shuffle takes place.
    """
    key = (_row_key(chunks) or ["source"])[0]
    ordered = chunks.sortWithinPartitions(key, *_POSITION)
    source_type = chunks.schema["source"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, number, row = None, 0, None
        for batch in batches:
            done = []
            for own, source, section, text in zip(batch["own"], batch["source"], batch["section"], batch["text"]):
                if not text:
                    continue
                if pending is not None and row == own:
                    if pending[2] == section and len(pending[3]) + 2 + len(text) <= MERGE_CHARS:
                        pending[3] += "\n\n" + text
                        continue
                    number += 1
                else:
                    number = 0
                if pending is not None:
                    done.append(pending)
                pending, row = [source, number, section, text], own
            if done:
                yield pd.DataFrame(done, columns=["source", "chunk_no", "section", "text"])
        if pending is not None:
            yield pd.DataFrame([pending], columns=["source", "chunk_no", "section", "text"])

    return ordered.select(F.col(key).alias("own"), "source", "section", "text").mapInPandas(
        fold, f"source {source_type}, chunk_no int, section string, text string"
    )


def chunk_documents(documents: DataFrame, source: str, text: str) -> DataFrame:
    """``(source, chunk_no, section, text)`` for a table with one whole file per row.

    A row's chunks stay in the row's partition from start to end, and rows with equal sources are chunked each on its own.
    """
    keyed = documents.select(F.monotonically_increasing_id().alias(_ROW), F.col(source).alias("source"), F.col(text).alias("__text"))
    return merge_small(_pieces(split_sections(keyed, "source", "__text")))


def dedupe_passages(passages: DataFrame, text: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """First passage of every normalised text, per ``by`` group; blank passages are dropped.

    Copies collapse in the map tasks: only digests and the first row of each are shuffled.
    """
    key = passage_key(passage_body(F.col(text)))
    keyed = passages.withColumns({"__key": F.sha2(key, 256), "__blank": key == ""})
    rest = [c for c in passages.columns if c not in by]
    first = keyed.groupBy(*by, "__key").agg(F.min_by(F.struct(*rest, "__blank"), F.struct(*order)).alias("r"))
    return first.where("not r.__blank").select(*by, *[f"r.{c}" for c in rest])


def retrieve(
    chunks: DataFrame, queries: DataFrame | list[tuple[str, str]], k: int = DEFAULT_K, vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None, order: list[str] = ("source", "chunk_no"),
) -> DataFrame:
    """Formatted passages per query, best first: ``query_id, rank, passage`` and the chunk's columns.

    Ranked by vectors where both the chunks (``chunk_id``, ``vector``) and a query (``query_id``, ``vector``) have
    one, otherwise by terms; copies among a query's top ``k`` are dropped afterwards, so it may get fewer.
    """
    asked = query_table(chunks.sparkSession, queries)
    wanted = [*chunks.columns, "query_id", "rank"]
    if vectors is None or query_vectors is None:
        top = keyword_top(chunks, asked, k, order).select(*wanted)
    else:
        embedded = query_vectors.where("vector IS NOT NULL").join(asked.where(F.trim("query") != ""), "query_id", "left_semi")
        near = embedding_top(vectors, embedded, "chunk_id", "vector", k)
        by_vector = near.join(chunks, "chunk_id").select(*wanted)
        rest = asked.join(embedded.select("query_id"), "query_id", "left_anti")
        top = by_vector if rest.isEmpty() else by_vector.unionByName(keyword_top(chunks, rest, k, order).select(*wanted))
    return dedupe_passages(format_passages(top), "passage", ["rank"], ["query_id"])


def retrieval_query(parts: list[Column], reports: list[Column]) -> Column:
    """One query text from the facts of a case and snippets of its reports (JSON texts)."""
    filled = [F.when(p.cast("string") != "", p.cast("string")) for p in parts]
    return F.concat_ws(" ", *filled, *[report_snippet(r) for r in reports])


# Report keys that go into a retrieval query.
SNIPPET_KEYS = ["row_count", "train_rows", "test_rows", "target_column", "summary"]
SNIPPET_BLOCKERS = 5
SNIPPET_CHARS = 500


def report_snippet(report: Column) -> Column:
    """Short text of a report: named facts, the first blockers, the target distribution."""
    facts = []
    for key in SNIPPET_KEYS:
        value = F.get_json_object(report, f"$.{key}")
        facts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value)))
    blockers = F.from_json(
        F.coalesce(F.get_json_object(report, "$.blockers"), F.get_json_object(report, "$.quality_blockers")), "array<string>"
    )
    listed = F.concat(F.lit("blockers="), F.array_join(F.slice(blockers, 1, SNIPPET_BLOCKERS), "; "))
    facts.append(F.when(F.size(blockers) > 0, listed))
    shares = F.coalesce(F.get_json_object(report, "$.target_distribution"), F.get_json_object(report, "$.class_balance"))
    facts.append(F.when(shares.isNotNull(), F.concat(F.lit("target_distribution="), F.left(shares, F.lit(SNIPPET_CHARS)))))
    text = F.concat_ws(" ", *facts)
    return F.when(text != "", text).otherwise(F.left(report, F.lit(SNIPPET_CHARS)))


def corpus_stats(files: DataFrame, chunks: DataFrame, case_id: str) -> DataFrame:
    """Size, role and number of chunks of every corpus file (``name, size_bytes``)."""
    role = (
        F.when(F.col("name").endswith("_experience.md"), "experience")
        .when(F.col("name") == f"{case_id}.md", "case")
        .otherwise("shared")
    )
    counts = chunks.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return files.withColumn("role", role).join(counts, "name", "left").withColumn(
        "n_chunks", F.coalesce("n_chunks", F.lit(0))
    )


def append_experience(corpus: DataFrame, experience: DataFrame) -> DataFrame:
    """Corpus with one experience file per case; an older one of the same name is replaced.

    Both tables have ``name, text``.
    """
    kept = corpus.join(experience.select("name"), "name", "left_anti")
    return kept.unionByName(experience.select("name", "text"))


def format_passages(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("passage", passage(F.col("source"), F.col("text")))
