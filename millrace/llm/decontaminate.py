"""Benchmark decontamination as a prefix-filtered set join, with DataFrame operations only.

An item's windows are all runs of 13 of its words (or all its words, if fewer). A window's shingles are its
runs of three words (or the window itself, if shorter). They are ordered by rarity over all documents. Full
containment is asked for, so one prefix token is necessary: a document that holds the window holds its
rarest shingle. The steps:

1. every document's shingles meet the distinct benchmark shingles; the matches (document, place, shingle)
   are all that the later steps read, and their counts are the rarities;
2. each window is joined by its rarest shingle only; the place gives the start of the window, which must
   not lie before the document's first word, nor its end behind the last (positional and length bound);
3. a candidate holds the window if all its shingles stand at their places, which is checked by joining them
   with the matches: runs of three words at every place are the 13 words themselves.

The benchmark shingles are broadcast while they are at most ``BROADCAST_ROWS``; beyond that Spark
joins them by shuffling. Texts are never shuffled.

Defined cases: a null text has no words and is not contaminated; items without words have no windows; an
item without item_id marks words, but is not listed or counted; several rows with one item_id are one item;
rows with equal doc_id and text give equal rows; other columns are not read; with an empty benchmark nothing
is contaminated; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

WINDOW, SHINGLE = 13, 3
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null for null."""
    # Where all characters are ASCII, Spark's quick lower() is the same.
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lowered, _BETWEEN), lambda w: w != "")


def _runs(words: Column, size: int) -> Column:
    """Array of (place, shingle) for all runs of ``size`` words."""
    def run(i):
        return F.struct(i.alias("place"), F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]).alias("shingle"))

    return F.transform(F.sequence(F.lit(0), F.size(words) - size), run)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, words, length) and the items that have each (window_id, item)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.slice("w", i + 1, length))
    owned = items.select("item", F.explode(cut).alias("words"))
    owned = owned.select("item", "words", F.concat_ws(" ", "words").alias("window_id"))
    windows = owned.groupBy("window_id").agg(F.first("words").alias("words")).withColumn("length", F.size("words"))
    return written(windows, "item-windows"), written(owned.select("window_id", "item").distinct(), "window-items")


def _maybe_broadcast(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.coalesce(words_of(F.col("text")), F.array().cast("array<string>"))
    return docs.select(F.col("doc_id").alias("doc"), F.md5(text.cast("binary")).alias("hash"), F.size(words).cast("long").alias("n_words"))


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per (document key, window that occurs, start): doc, hash, window_id, length, start."""
    size = F.least(F.col("length"), F.lit(SHINGLE))
    sizes = [r[0] for r in windows.select(size.alias("size")).distinct().collect()]  # at most SHINGLE values
    parts = []
    for k in sizes:
        fit = windows.filter(size == k)
        parts.append(fit.select("window_id", "length", F.lit(k).alias("size"), F.explode(_runs(F.col("words"), k)).alias("r")))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc long, hash string, window_id string, length int, start int")
    contents = parts[0]
    for p in parts[1:]:
        contents = contents.unionByName(p)
    contents = written(contents.select("window_id", "length", "size", "r.place", "r.shingle"), "window-shingles")
    known = contents.select("size", "shingle").distinct()
    n_known = known.count()

    matches = None
    for k in sizes:
        text = docs.select(F.col("doc_id").alias("doc"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"), words_of(F.col("text")).alias("w")).filter(F.size("w") >= k)
        runs = text.select("doc", "hash", F.size("w").alias("n"), F.explode(_runs(F.col("w"), k)).alias("r")).select("doc", "hash", "n", "r.place", "r.shingle")
        wanted = known.filter(F.col("size") == k).select("shingle")
        met = runs.join(_maybe_broadcast(wanted, n_known), "shingle").withColumn("size", F.lit(k))
        matches = met if matches is None else matches.unionByName(met)
    matches = written(matches, "shingle-matches")

    rarity = matches.groupBy("size", "shingle").agg(F.count(F.lit(1)).alias("df"))
    # A shingle that no document has makes its windows impossible: they drop out of this join.
    ranked = contents.join(rarity, ["size", "shingle"], "left")
    prefix = ranked.groupBy("window_id", "length", "size").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "place", "shingle")).alias("rarest")
    )
    prefix = written(prefix.filter("rarest.df > 0").select("window_id", "length", "size", F.col("rarest.place").alias("within"), F.col("rarest.shingle").alias("shingle")), "prefix-tokens")
    n_prefix = prefix.count()
    candidates = (
        matches.join(_maybe_broadcast(prefix, n_prefix), ["size", "shingle"])
        .withColumn("start", F.col("place") - F.col("within"))
        .filter("start >= 0 AND start + length <= n")
        .select("doc", "hash", "window_id", "length", "start")
        .distinct()
    )
    expected = contents.select("window_id", F.col("place").alias("within"), "shingle")
    pieces = candidates.join(_maybe_broadcast(expected, contents.count()), "window_id")
    pieces = pieces.select("doc", "hash", "window_id", "length", "start", (F.col("start") + F.col("within")).alias("place"), "shingle")
    there = matches.select(F.col("doc").alias("d"), F.col("hash").alias("h"), F.col("place").alias("p"), F.col("shingle").alias("s")).distinct()
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("place") == F.col("p")) & (F.col("shingle") == F.col("s"))
    verified = pieces.join(there, same).groupBy("doc", "hash", "window_id", "length", "start").agg(F.count(F.lit(1)).alias("held"))
    full = F.col("length") - F.least(F.col("length"), F.lit(SHINGLE)) + 1
    return verified.filter(F.col("held") == full).drop("held")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _measured(docs, benchmark, window, one_in).drop("hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones."""
    measured = _measured(docs.select("doc_id", "text"), benchmark, window, one_in)
    bad = written(measured.filter("contaminated").select(F.col("doc_id").alias("__doc"), F.col("hash").alias("__hash")).distinct(), "contaminated")
    hashed = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    return docs.join(_maybe_broadcast(bad, bad.count()), docs["doc_id"].eqNullSafe(F.col("__doc")) & (hashed == F.col("__hash")), "left_anti")


def _measured(docs: DataFrame, benchmark: DataFrame, window: int, one_in: int) -> DataFrame:
    windows, owners = item_windows(benchmark, window)
    hits = written(window_hits(docs, windows), "benchmark-hits")
    key = ["doc", "hash"]
    # Words covered by at least one window: each interval adds what lies behind all earlier ends.
    earlier = Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = hits.select(*key, "start", "length").distinct()
    spans = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0)))))
    covered = spans.groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    named = hits.select(*key, "window_id").distinct().join(owners.filter("item IS NOT NULL"), "window_id").select(*key, "item").distinct()
    listed = named.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = covered.join(listed, [covered.doc.eqNullSafe(listed.doc), covered.hash == listed.hash], "left").select(
        covered.doc.alias("d"), covered.hash.alias("h"), "n_hit", "items"
    )
    rows = _keyed(docs)
    joined = rows.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "hash",
        F.col("doc").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
