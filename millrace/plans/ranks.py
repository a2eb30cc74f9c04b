"""Cut classes into exact shares in shuffled order, without sorting or shuffling the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

PIECE_DIGITS = 4
#: Classes up to which the table of cuts is broadcast: a few numbers for each.
BROADCAST_CLASSES = 100_000


def shuffled_key(key_columns: list[str], seed: int) -> Column:
    """A reproducible pseudo-random order: the MD5 text of the key and the seed."""
    parts = [F.col(c).cast("string") for c in key_columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def class_cuts(
    df: DataFrame, by: list[str], key_columns: list[str], seed: int, shares: list[float], digits: int = PIECE_DIGITS
) -> DataFrame:
    """``(class_<by>..., cuts)``: per class, the hash of its row at rank ``round(n * share)``.

    Entries are NULL where that rank is 0. The leading hex digits of the hash cut every class,
    however large, into ``16**digits`` even pieces. Counting the pieces tells in which piece a
    rank falls, and only the rows of these few pieces are ordered. ``key_columns`` must identify
    a row.
    """
    hashed = df.select(*by, shuffled_key(key_columns, seed).alias("__hash"))
    keyed = hashed.withColumn("__piece", F.substring("__hash", 1, digits))
    classes = [F.col(c) for c in by] or [F.lit(0)]
    # One row per class and piece from here on, until the chosen pieces are looked into.
    counts = keyed.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*classes).orderBy("__piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns(
        {"__upto": F.sum("__n").over(upto), "__total": F.sum("__n").over(Window.partitionBy(*classes))}
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("cut"), F.floor(F.col("__total") * s + 0.5).alias("rank")) for i, s in enumerate(shares)])
    before = F.col("__upto") - F.col("__n")
    chosen = (
        placed.withColumn("__w", F.explode(wanted))
        .where((F.col("__w.rank") > before) & (F.col("__w.rank") <= F.col("__upto")))
        .select(
            *[F.col(c).alias(f"class_{c}") for c in by],
            F.col("__piece").alias("chosen_piece"),
            F.col("__w.cut").alias("cut"),
            (F.col("__w.rank") - before).alias("local_rank"),
        )
    )
    match = F.col("__piece") == F.col("chosen_piece")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"class_{c}"))
    inside = Window.partitionBy(*[f"class_{c}" for c in by], "cut").orderBy("__hash")
    hits = keyed.join(chosen, match).withColumn("__at", F.row_number().over(inside)).where(F.col("__at") == F.col("local_rank"))
    found = F.map_from_entries(F.collect_list(F.struct("cut", "__hash")))
    per_class = hits.groupBy(*[f"class_{c}" for c in by]).agg(found.alias("__found"))
    cuts = F.array(*[F.try_element_at("__found", F.lit(i)) for i in range(len(shares))])
    return per_class.select(*[f"class_{c}" for c in by], cuts.alias("cuts"))


def with_share(
    df: DataFrame, by: list[str], key_columns: list[str], seed: int, shares: list[float], out: str, digits: int = PIECE_DIGITS
) -> DataFrame:
    """Add ``out``: how many of the cuts at ``shares`` lie before the row in shuffled order.

    The cuts are one small row per class, so the rows themselves stay where they are.
    """
    cuts = class_cuts(df, by, key_columns, seed, shares, digits)
    if by:
        match = None
        for c in by:
            same = F.col(c).eqNullSafe(F.col(f"class_{c}"))
            match = same if match is None else match & same
        # Spark guesses the size of this table from its input, so its rows are counted: up to a bound they
        # go to where the rows of ``df`` are, beyond it the join may shuffle.
        cuts = cut_lineage(cuts)
        joined = df.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_CLASSES else cuts, match, "left")
    else:
        joined = df.withColumn("cuts", cuts.select("cuts").scalar())
    own = shuffled_key(key_columns, seed)
    passed = [F.when(F.coalesce(own > F.col("cuts")[i], F.lit(True)), 1).otherwise(0) for i in range(len(shares))]
    total = passed[0]
    for p in passed[1:]:
        total = total + p
    return joined.select(*df.columns, total.alias(out))
