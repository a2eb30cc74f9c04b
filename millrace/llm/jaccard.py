"""Exact Jaccard join of word shingles in metric space, and its connected components.

Jaccard distance 1 - |A n B| / |A u B| is a metric on shingle sets. Whole documents are poor first pivots:
nearly every document is at distance 1 from nearly every other, where the triangle inequality rules out
nothing. The join therefore works on two levels.

* First level. The pivots are the one-shingle sets {s}. A set is at distance 1 - 1/n from the pivots it
  holds and at 1 from all others, so its Voronoi region is that of the first pivot it holds, in one fixed
  order (estimated rarity from a count-min sketch over all documents, then hash). A set within 0.15 keeps at
  least ceil(0.85 n) of the n shingles, so its own first pivot is among the first n - ceil(0.85 n) + 1 here:
  the boundary window over which a set is replicated. Pivots whose estimate is 1 hold one set and are left
  out; the sketch never underestimates, so no pair is lost.
* Inside a region, documents are the pivots. The most central one (with the fewest rarer shingles) is compared
  with all others, which links its neighbours. Members that are then in one component need no further
  comparison, so only members outside a region's largest component look for partners: among those of a size
  that their own size and the pivot's place allow (sizes are joined in narrow bands), and where the exact
  distances d(x, p), d(y, p) do not rule the pair out by |d(x, p) - d(y, p)| > 0.15. Regions with many pairs
  left are joined again around their next pivot, until the pairs left are few enough to be compared directly.

Equal sets are one class from the start; a group of copies is one node and is never expanded into pairs.
Pairs are compared by full sets (64-bit hashes of the shingles) made from the whole texts again.

Defined cases: null and empty texts and texts without words have no shingles, are linked with nothing, and
their component is their own doc_id; fewer words than a shingle are one shingle; rows with one doc_id are
linked like others; a null doc_id is never the component's name unless all its members have none; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import packets as P
from millrace.llm.common import by_row, tidy, written
from millrace.llm.components import connected_components
from millrace.session import cut_lineage

SHINGLE = 4
PERCENT = 85
#: Pairs for each region member, up to which the pairs left are compared directly.
DIRECT_SHARE = 4
#: Sizes in one band differ by less than this share.
BAND = 0.02


def shingle_set(text: bytes | None, size: int, cache: P.WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; words are lower-cased in A-Z."""
    words = cache.of((text or b"").lower().split())
    if not len(words):
        return words
    k = min(size, len(words))
    return np.unique(P.window_hashes(words, k, 10 + (0 if k == size else k)))


def _sets(batch: pa.RecordBatch, size: int, cache: P.WordHashes) -> list[np.ndarray]:
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
    return [shingle_set(t, size, cache) for t in texts]


def _together(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*sets, np.zeros(0, np.uint64)])


def _close(na, nb, shared, percent: int):
    """Whether ``shared`` of sets with na and nb members can reach the threshold."""
    return (100 + percent) * shared >= percent * (na + nb)


def shingle_entries(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Packets of the documents, and one row per document: doc_id, packet, row, n, class, pivots, places."""
    packets = P.pack_rows(docs, "jaccard-packets")
    bits = P.cell_bits(packets)

    def hashes(batch, cache=P.WordHashes()):
        return _together(_sets(batch, size, cache))

    counts = P.estimate_counts(packets, hashes, bits)

    def entries(row, cache=P.WordHashes()):
        body = P.unpack(row["body"])
        sets = _sets(body, size, cache)
        estimate = P.Cells(_together(sets), bits).estimates(P.replies_of(row["replies"]))
        pivots, places, names, at = [], [], [], 0
        for s in sets:
            n, e = len(s), estimate[at : at + len(s)]
            at += n
            reach = n - -(-percent * n // 100) + 1 if n else 0
            order = np.lexsort((s, e))[:reach]
            first = int(np.searchsorted(e[order], 2))
            pivots.append(s[order[first:]].astype(np.int64))
            places.append(np.arange(first, len(order), dtype=np.int32))
            names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
        k = len(sets)
        return pa.RecordBatch.from_pydict({
            "doc_id": body.column(body.schema.get_field_index("doc_id")), "packet": pa.array([row["packet"]] * k, pa.int64()), "row": pa.array(range(k), pa.int32()), "n": pa.array([len(s) for s in sets], pa.int32()),
            "class": pa.array(names, pa.binary()), "pivots": pa.array(pivots, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32())),
        })

    schema = "doc_id long, packet long, row int, n int, class binary, pivots array<long>, places array<int>"
    joined = packets.select("packet", "body").join(counts, "packet", "left")
    return packets, written(joined.mapInArrow(tidy(by_row(entries)), schema), "jaccard-entries")


def class_texts(packets: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """One text for each class that has an entry in ``members``: class, text (zstd frame)."""
    wanted = rows.join(members.select("class").distinct(), "class", "left_semi")
    chosen = wanted.groupBy("class").agg(F.min(F.struct("packet", "row")).alias("at"))
    by_packet = chosen.groupBy("at.packet").agg(F.collect_list(F.struct(F.col("at.row").alias("row"), "class")).alias("wanted"))

    def pick(row):
        pack = zstandard.ZstdCompressor(level=3)
        body = P.unpack(row["body"])
        texts = body.column(body.schema.get_field_index("text")).cast(pa.binary())
        packed = [pack.compress(texts[w["row"]].as_py()) for w in row["wanted"]]
        return pa.RecordBatch.from_pydict({"class": pa.array([w["class"] for w in row["wanted"]], pa.binary()), "text": pa.array(packed, pa.binary())})

    return written(packets.select("packet", "body").join(by_packet, "packet").mapInArrow(tidy(by_row(pick)), "class binary, text binary"), "jaccard-texts")


def compare_pairs(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Add ``na``, ``nb``, ``shared`` to pairs (a, b) of classes, from their texts."""

    def compare(batches, cache=P.WordHashes()):
        last, held, pack = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            sizes = []
            for i in range(len(batch)):
                if b[i].as_py() != last:
                    last, held = b[i].as_py(), shingle_set(pack.decompress(tb[i].as_py()), size, cache)
                s = shingle_set(pack.decompress(ta[i].as_py()), size, cache)
                sizes.append((len(s), len(held), len(np.intersect1d(s, held, assume_unique=True))))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, **{k: pa.array([z[i] for z in sizes], pa.int32()) for i, k in enumerate(("na", "nb", "shared"))}})

    of = lambda key, text: texts.select(F.col("class").alias(key), F.col("text").alias(text))
    rows = pairs.select("a", "b").join(of("a", "ta"), "a").join(of("b", "tb"), "b").select("a", "b", "ta", "tb")
    return written(rows.mapInArrow(tidy(compare), "a binary, b binary, na int, nb int, shared int"), "jaccard-pairs")


def jaccard_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, direct_share: float = DIRECT_SHARE) -> tuple[DataFrame, DataFrame]:
    """Packets of ``docs``, and one row per document: doc_id, packet, row, n, group (null without shingles)."""
    packets, rows = shingle_entries(docs, size, percent)
    labels = _class_components(packets, rows, size, percent, direct_share)
    rows = rows.select("doc_id", "packet", "row", "n", "class")
    if labels is None:
        return packets, rows.withColumnRenamed("class", "group")
    joined = rows.join(labels, F.col("class") == F.col("node"), "left")
    return packets, joined.select("doc_id", "packet", "row", "n", F.coalesce("component", "class").alias("group"))


def _class_components(packets: DataFrame, rows: DataFrame, size: int, percent: int, direct_share: float) -> DataFrame | None:
    """Rows node (class), component for the classes that are linked."""
    flat = rows.filter(F.size("pivots") > 0).select("class", "n", F.explode(F.arrays_zip("pivots", "places")).alias("e"))
    members = flat.groupBy(F.col("e.pivots").alias("pivot"), "class").agg(F.min("n").alias("n"), F.min("e.places").alias("place"))
    many = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("pivot")
    regions = written(members.join(many, "pivot", "left_semi").withColumns({"component": F.col("class"), "d": F.lit(None).cast("double")}), "jaccard-regions")
    limit = direct_share * regions.count()
    if regions.isEmpty():
        return None
    texts = class_texts(packets, rows, regions)
    reach = 1 - percent / 100 + 1e-9
    labels = None

    def possible(left: str, right: str):
        """Lengths, places and the triangle inequality allow the pair; a region's own pivot is the first they share."""
        n1, n2, p1, p2, d1, d2 = (F.col(f"{s}.{c}") for c in ("n", "place", "d") for s in (left, right))
        lengths = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
        shared = 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
        near = F.coalesce(F.abs(d1 - d2) <= reach, F.lit(True))
        return lengths & _close(n1, n2, shared, percent) & near & (F.col(f"{left}.component") != F.col(f"{right}.component"))

    band = lambda n: F.floor(F.log(n) / math.log1p(BAND)).cast("int")
    while True:
        centre = regions.groupBy("pivot").agg(F.min(F.struct("place", "class", "n", "component", "d")).alias("c")).select(F.col("pivot").alias("of"), "c.*").alias("y")
        direct = False
        if labels is not None:
            shares = regions.groupBy("pivot", "component").count().groupBy("pivot").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
            marked = regions.join(shares, "pivot").withColumn("out", F.col("component") != F.col("largest"))
            # Partner sizes that the lengths and the shingles from the pivot on allow.
            least = F.ceil(F.col("n") * percent / 100)
            most = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n"))
            seeking = marked.filter(F.col("out") & (least <= most)).withColumn("band", F.explode(F.sequence(band(least), band(most))))
            partners = marked.withColumn("band", band(F.col("n")))
            once = ~F.col("y.out") | (F.col("x.class") < F.col("y.class"))
            pairs = seeking.alias("x").join(partners.alias("y"), (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.band") == F.col("y.band")) & once & possible("x", "y"))
            pairs = pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
            left = pairs.count()
            if not left:
                break
            direct = left <= limit
        if not direct:
            pairs = regions.alias("x").join(centre, (F.col("x.pivot") == F.col("y.of")) & (F.col("x.class") != F.col("y.class")) & possible("x", "y"))
            pairs = pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        pairs = pairs.distinct()
        compared = compare_pairs(pairs, texts, size)
        links = compared.filter(_close(F.col("na"), F.col("nb"), F.col("shared"), percent)).select("a", "b")
        if labels is not None:  # stars stand for all links found before
            links = links.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = cut_lineage(connected_components(links))
        if direct:
            return labels
        # The pivot has met all others of its region; what is left is joined around the next one.
        distance = compared.select("a", "b", (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("measured"))
        after = (
            regions.drop("d")
            .join(centre.select("of", F.col("class").alias("centre")), F.col("pivot") == F.col("of"))
            .filter(F.col("class") != F.col("centre"))
            .join(distance, (F.col("class") == F.col("a")) & (F.col("centre") == F.col("b")), "left")
            .drop("component")
            .join(labels, F.col("class") == F.col("node"), "left")
            .select("pivot", "class", "n", "place", F.coalesce("component", "class").alias("component"), F.col("measured").alias("d"))
        )
        after = cut_lineage(after)
        open_regions = after.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("pivot")
        regions = cut_lineage(after.join(open_regions, "pivot", "left_semi"))
    return labels


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, direct_share: float = DIRECT_SHARE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    _, rows = jaccard_groups(docs.select("doc_id", "text"), size, percent, direct_share)
    least = rows.filter("group IS NOT NULL").groupBy(F.col("group").alias("of")).agg(F.min("doc_id").alias("least"))
    named = rows.join(least, F.col("group") == F.col("of"), "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_first_of_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each linked group: that of the smallest doc_id (a null one counts as largest;
    of equal ones the row read first). Rows without shingles stay."""
    packets, rows = jaccard_groups(docs, size, percent)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "packet", "row")
    first = rows.filter("group IS NOT NULL").groupBy(F.col("group").alias("of")).agg(F.min(place).alias("first"))
    gone = rows.join(first, F.col("group") == F.col("of")).filter((F.col("first.packet") != F.col("packet")) | (F.col("first.row") != F.col("row")))
    by_packet = gone.groupBy("packet").agg(F.collect_list("row").alias("gone"))
    names = docs.columns

    def keep(row):
        body = P.unpack(row["body"])
        stay = np.ones(len(body), dtype=bool)
        stay[np.array(row["gone"] or [], dtype=np.int64)] = False
        kept = body.filter(pa.array(stay))
        return pa.RecordBatch.from_arrays(kept.columns, names=names)

    return packets.select("packet", "body").join(by_packet, "packet", "left").select("body", "gone").mapInArrow(tidy(by_row(keep)), docs.schema)
