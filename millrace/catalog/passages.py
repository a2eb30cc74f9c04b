"""Corpus chunking, de-duplication and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import numbers, text
from millrace.operators import corpus

# Documents have no headings or blank lines, so a file gets a title, its language as a section
# and every line as a paragraph.
_FILES = r"""files AS (SELECT doc_id, source || '_' || doc_id || '.md' AS name,
      '# ' || source || chr(10) || '## ' || lang || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS body, text, lang, source FROM documents)"""


def corpus_files(t):
    """The corpus: one markdown file per document."""
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    body = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return t.documents.select("doc_id", name.alias("name"), body.alias("body"), "text", "lang", "source")


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_LINES = f"""{_FILES}, lines AS (SELECT doc_id, name AS source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS lno FROM files),
    marked AS (SELECT *, regexp_matches(line, '^[ \\t]*#{{1,6}}[ \\t]+.*\\S') AS is_heading, regexp_matches(line, '^[ \\t]*#[ \\t]+.*\\S') AS is_top FROM lines),
    titled AS (SELECT *, min(CASE WHEN is_top THEN lno END) OVER (PARTITION BY doc_id) AS title_at, max(CASE WHEN is_heading THEN lno END) OVER (PARTITION BY doc_id ORDER BY lno) AS h FROM marked),
    sections AS (SELECT b.doc_id, b.source, coalesce(b.h, 0) AS h, any_value(CASE WHEN hd.lno <> hd.title_at THEN regexp_replace({_TRIM.format("hd.line")}, '^#+[ \\t]+', '') END) AS section,
        {_TRIM.format("string_agg(b.line, chr(10) ORDER BY b.lno)")} AS body
      FROM titled b LEFT JOIN titled hd ON hd.doc_id = b.doc_id AND hd.lno = b.h WHERE NOT b.is_heading GROUP BY 1, 2, 3)"""
_PIECES = f"""{_LINES}, paras AS (SELECT *, unnest(string_split(body, chr(10) || chr(10))) AS para, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS pno FROM sections),
    trimmed AS (SELECT doc_id, source, section, h, pno, {_TRIM.format("para")} AS para FROM paras WHERE {_TRIM.format("para")} <> ''),
    cut AS (SELECT *, unnest(range(0, length(para), 1200)) AS start FROM trimmed),
    raw AS (SELECT *, {_TRIM.format("substr(para, CAST(start + 1 AS INTEGER), 1200)")} AS piece FROM cut),
    pieces AS (SELECT doc_id, source, section, h, pno, start, text FROM (SELECT *, CASE WHEN start = 0 THEN piece
      ELSE {_TRIM.format("regexp_replace(piece, '(?m)^#{1,6}[ \\t]+.+$', '', 'g')")} END AS text FROM raw) WHERE text <> '')"""
_CHUNKS = f"""{_PIECES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, pno, start) AS n FROM pieces),
    fold AS (SELECT source, section, n, text, 0 AS group_no FROM numbered WHERE n = 1
      UNION ALL SELECT c.source, c.section, c.n, CASE WHEN joins THEN f.text || chr(10) || chr(10) || c.text ELSE c.text END, CASE WHEN joins THEN f.group_no ELSE f.group_no + 1 END
      FROM fold f JOIN numbered c ON c.source = f.source AND c.n = f.n + 1, LATERAL (SELECT length(f.text) + 2 + length(c.text) <= 400 AND c.section IS NOT DISTINCT FROM f.section AS joins)),
    chunks AS (SELECT source, CAST(group_no AS INTEGER) AS chunk_no, any_value(section) AS section, arg_max(text, n) AS text FROM fold GROUP BY source, group_no)"""


@query("section_split", f"WITH {_LINES} SELECT source, section, body FROM sections")
def section_split(t):
    return corpus.split_sections(corpus_files(t), "name", "body").select("source", "section", "body")


@query("paragraph_chunks", f"WITH {_PIECES} SELECT source, section, text, length(text)::INTEGER AS n FROM pieces")
def paragraph_chunks(t):
    pieces = corpus.paragraph_chunks(corpus.split_sections(corpus_files(t), "name", "body"))
    return pieces.select("source", "section", "text", F.length("text").alias("n"))


@query("chunk_documents", f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks")
def chunk_documents(t):
    return corpus.chunk_documents(corpus_files(t), "name", "body")


@query(
    "merge_small_chunks",
    f"""WITH RECURSIVE {_CHUNKS}, raw_counts AS (SELECT source, count(*) AS n_pieces FROM pieces GROUP BY 1)
    SELECT c.source, any_value(n_pieces) AS n_pieces, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (length(text) <= 400) AS n_small
    FROM chunks c JOIN raw_counts r ON r.source = c.source GROUP BY c.source""",
)
def merge_small_chunks(t):
    """How merging changes the number of chunks of every file."""
    pieces = corpus.paragraph_chunks(corpus.split_sections(corpus_files(t), "name", "body"))
    before = pieces.groupBy("source").agg(F.count(F.lit(1)).alias("n_pieces"))
    size = F.length("text")
    after = corpus.chunk_documents(corpus_files(t), "name", "body").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(size).alias("n_chars"), F.count_if(size <= corpus.MERGE_CHARS).alias("n_small")
    )
    return before.join(after, "source")


@query(
    "dedupe_passages",
    f"""WITH RECURSIVE {_CHUNKS}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY source, chunk_no) AS rk FROM chunks)
    SELECT source, chunk_no FROM k WHERE rk = 1""",
)
def dedupe_passages(t):
    chunks = corpus.format_passages(corpus.chunk_documents(corpus_files(t), "name", "body"))
    return corpus.dedupe_passages(chunks, "passage", ["source", "chunk_no"]).select("source", "chunk_no")


QUERIES = [("data", "the license of the data and the quality"), ("terms", "Que les TION und nicht"), ("none", "zzqqxx yyqqzz"), ("short", "a b c")]
_TERMS = """terms AS (SELECT DISTINCT query_id, lower(term) AS term FROM (SELECT query_id, unnest(regexp_extract_all(q, '[a-zA-Z0-9_]{3,}')) AS term
      FROM (VALUES ('data', 'the license of the data and the quality'), ('terms', 'Que les TION und nicht'), ('none', 'zzqqxx yyqqzz'), ('short', 'a b c')) v(query_id, q)))"""


@query(
    "keyword_topk",
    f"""WITH RECURSIVE {_CHUNKS}, {_TERMS}, scored AS (SELECT query_id, source, chunk_no, count(*) AS score FROM chunks JOIN terms ON contains(lower(text), term) GROUP BY 1, 2, 3),
    firsts AS (SELECT source, chunk_no FROM chunks ORDER BY source, chunk_no LIMIT 10),
    every AS (SELECT * FROM scored UNION ALL SELECT q, source, chunk_no, 0 FROM firsts, (SELECT unnest(['data', 'terms', 'none', 'short']) AS q) WHERE q NOT IN (SELECT query_id FROM scored)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_no) AS rk FROM every)
    SELECT query_id, source, chunk_no, CAST(score AS INTEGER) AS score, CAST(rk AS INTEGER) AS rank FROM ranked WHERE rk <= 10""",
)
def keyword_topk(t):
    chunks = corpus.chunk_documents(corpus_files(t), "name", "body")
    return corpus.keyword_top(chunks, QUERIES, 10).select("query_id", "source", "chunk_no", "score", "rank")


@query(
    "retrieve_batch",
    f"""WITH RECURSIVE {_CHUNKS}, q AS (SELECT doc_id AS query_id, substr(text, 1, 60) AS query FROM documents WHERE trim(substr(text, 1, 60)) <> ''),
    terms AS (SELECT DISTINCT query_id, lower(term) AS term FROM (SELECT query_id, unnest(regexp_extract_all(query, '[a-zA-Z0-9_]{{3,}}')) AS term FROM q)),
    words AS (SELECT DISTINCT term FROM terms), hits AS (SELECT source, chunk_no, term FROM chunks JOIN words ON contains(lower(text), term)),
    scored AS (SELECT query_id, source, chunk_no, count(*) AS score FROM hits JOIN terms USING (term) GROUP BY 1, 2, 3),
    firsts AS (SELECT source, chunk_no FROM chunks ORDER BY source, chunk_no LIMIT 5),
    every AS (SELECT * FROM scored UNION ALL SELECT query_id, source, chunk_no, 0 FROM firsts, q WHERE query_id NOT IN (SELECT query_id FROM scored)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_no) AS rank FROM every QUALIFY rank <= 5),
    copies AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY rank) AS nth FROM ranked JOIN chunks USING (source, chunk_no))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, '[' || source || '] ' || text AS passage FROM copies WHERE nth = 1""",
)
def retrieve_batch(t):
    """The beginning of every document as a query: top chunks, copies dropped, formatted."""
    head = F.substring("text", 1, 60)
    queries = t.documents.select(F.col("doc_id").alias("query_id"), head.alias("query"))
    chunks = corpus.chunk_documents(corpus_files(t), "name", "body")
    return corpus.retrieve(chunks, queries, 5).select("query_id", "rank", "passage")


@query(
    "query_cross_score",
    """WITH terms AS (SELECT term FROM (SELECT unnest(['the', 'tion', 'und', 'que', 'nicht']) AS term))
    SELECT item_id, count(*) AS score FROM benchmark JOIN terms ON contains(lower(text), term) GROUP BY 1""",
)
def query_cross_score(t):
    """Score of every benchmark item against one query."""
    terms = text.query_terms(F.lit("the TION und que nicht the"))
    score = F.size(F.filter(terms, lambda w: F.contains(F.lower("text"), w))).cast("long")
    return t.benchmark.select("item_id", score.alias("score")).where("score > 0")


_CENTROIDS = """parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    centroids AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM centroids GROUP BY 1),
    vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM parts GROUP BY 1),
    scored AS (SELECT c.label AS query_id, p.vec_id, sum(p.x * c.m) / any_value(cn.n) / any_value(vn.n) AS score FROM parts p JOIN centroids c ON c.i = p.i
      JOIN cn ON cn.label = c.label JOIN vn ON vn.vec_id = p.vec_id GROUP BY 1, 2)"""


@query(
    "embedding_topk",
    f"""WITH {_CENTROIDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rk FROM scored)
    SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM ranked WHERE rk <= 8""",
)
def embedding_topk(t):
    """Nearest vectors to the mean vector of every label."""
    vectors = t.embeddings
    centroids = corpus.label_centroids(vectors, "label", "embedding")
    return corpus.embedding_top(vectors, centroids, "vec_id", "embedding", 8).withColumn("score", F.round("score", 6))


@query(
    "cosine_to_first_axis",
    """SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS similarity FROM embeddings""",
)
def cosine_to_first_axis(t):
    axis = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), 63))
    similarity = numbers.cosine(F.col("embedding").cast("array<double>"), axis)
    return t.embeddings.select("vec_id", F.round(similarity, 6).alias("similarity"))


@query(
    "passage_format",
    """SELECT doc_id, '[' || source || '] ' || text AS passage, source AS back_source, text AS back_text, 'unknown' AS bare_source FROM (SELECT doc_id, source, trim(text, ' ' || chr(10)) AS text FROM documents)""",
)
def passage_format(t):
    rows = t.documents.select("doc_id", "source", text.strip(F.col("text")).alias("text"))
    made = rows.withColumn("passage", text.passage(F.col("source"), F.col("text")))
    return made.select(
        "doc_id", "passage", text.passage_source(F.col("passage")).alias("back_source"),
        text.passage_body(F.col("passage")).alias("back_text"), text.passage_source(F.col("source")).alias("bare_source"),
    )


@query(
    "query_build",
    """SELECT doc_id, source || ' classification ' || 'row_count=' || n_chars || ' summary=' || lang || CASE WHEN n_chars > 100 THEN ' blockers=a; b; c; d; e' ELSE '' END || ' ' || '{"n":' || doc_id || '}' AS query FROM documents""",
)
def query_build(t):
    blockers = F.when(F.col("n_chars") > 100, F.array(*[F.lit(x) for x in "abcdefg"]))
    report = F.to_json(F.struct(F.col("n_chars").alias("row_count"), F.col("lang").alias("summary"), blockers.alias("blockers")))
    bare = F.to_json(F.struct(F.col("doc_id").alias("n")))
    out = corpus.retrieval_query([F.col("source"), F.lit(""), F.lit("classification")], [report, bare])
    return t.documents.select("doc_id", out.alias("query"))


@query(
    "corpus_append",
    f"""WITH {_FILES}, e AS (SELECT source || '_0.md' AS name, 'experience of ' || count(*) AS text FROM documents GROUP BY source)
    SELECT name, length(text) AS size FROM files WHERE name NOT IN (SELECT name FROM e) UNION ALL SELECT name, length(text) FROM e""",
)
def corpus_append(t):
    current = corpus_files(t).select("name", "text")
    experience = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat("source", F.lit("_0.md")).alias("name"), F.concat(F.lit("experience of "), F.col("n").cast("string")).alias("text")
    )
    return corpus.append_experience(current, experience).select("name", F.length("text").cast("long").alias("size"))


@query(
    "corpus_stats",
    f"""WITH RECURSIVE {_CHUNKS}, n AS (SELECT source, count(*) AS n FROM chunks GROUP BY 1)
    SELECT name, strlen(body) AS size_bytes, CASE WHEN name = 'src1_5.md' THEN 'case' ELSE 'shared' END AS role, coalesce(n, 0) AS n_chunks FROM files LEFT JOIN n ON n.source = name""",
)
def corpus_stats(t):
    files = corpus_files(t)
    chunks = corpus.chunk_documents(files, "name", "body")
    sizes = files.select("name", F.octet_length("body").cast("long").alias("size_bytes"))
    return corpus.corpus_stats(sizes, chunks, "src1_5")


@query(
    "text_scalars",
    """SELECT doc_id, trim(text, ' ' || chr(10)) AS bare, lower(regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g')) AS key, regexp_replace(lower(lang || '-' || source), '[^a-z0-9]', '', 'g') AS plain,
      substr(regexp_replace(lang || ' / ' || source, '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 80) AS slug,
      len(list_distinct([lower(x) for x in regexp_extract_all(text, '[a-zA-Z0-9_]{3,}')]))::INTEGER AS n_terms FROM documents""",
)
def text_scalars(t):
    body = F.concat(F.lit("# "), "source", F.lit("\n"), "text")
    return t.documents.select(
        "doc_id",
        text.strip_leading_heading(body).alias("bare"),
        text.passage_key(F.concat(F.lit("## Heading here\n"), "text")).alias("key"),
        text.plain_name(F.concat_ws("-", "lang", "source")).alias("plain"),
        text.slug(F.concat_ws(" / ", "lang", "source")).alias("slug"),
        F.size(text.query_terms(F.col("text"))).alias("n_terms"),
    )
