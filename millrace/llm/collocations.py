"""Phrase collocations: phrases of 2 to 4 words counted by direct-address tiles of frequency-ranked ids.

Words get ids by falling frequency, so the pairs that fill a corpus lie in a few square tiles of ``TILE``
by ``TILE`` ids near the origin. A crowded tile is counted by ``numpy.bincount`` into one cell for each pair
(a direct address); in the other tiles the occurring pairs are sorted (coordinate form). Pairs that occur
often enough are ranked and get ids in turn: a phrase of k + 1 words is a pair of overlapping phrases of k
words, so the same counter gives 3 and 4 words. No candidate is lost, because a phrase is never more
frequent than its parts.

How it is spread: documents go into packets of about ``PACKET_BYTES`` of one language each, which hold ids
only. A task counts its packets and sends the sums of its tiles to buckets of tiles; their number grows with the
corpus, and only occupied ones get a message. A bucket adds its messages one after another, so it holds its
distinct pairs and no more; where a bucket would get messages from more than ``FAN_IN`` tasks they are merged in
levels. Ids reach the packets by a broadcast while the table of frequent words or phrases has at most
``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes, and beyond that by a join of each packet's distinct entries.

Defined cases: a null text is empty; a null language is ``und``; rows with equal doc_id are documents like
any other; texts of any length are read whole (a packet is cut only where a piece ends, as no phrase crosses
that); an empty table, or one without frequent words, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import with_position, written
from millrace.llm.packets import join_parts, split_parts, squeeze, unsqueeze

LEAST, TOP, COVERED = 30, 2000, 80
PACKET_BYTES = 4 << 20
TILE_BITS = 10
#: Along each side, so many tiles may be counted by direct address; later ones are sparse by rank.
DENSE_SIDE = 64
#: Occurrences that a task or bucket holds before it adds them up, and distinct pairs before a task sends them.
HELD, SENT = 1 << 20, 1 << 21
BUCKET_WORDS = 1 << 20
FAN_IN = 256
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20

_UPPER = bytes(range(65, 91))
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TRANSLATE = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"\n" * len(_ENDS) + b" ")


# Words in packets


def tokenise(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a translated text and the places of its words among them, -1 between pieces."""
    raw = np.frombuffer(text, np.uint8)
    gap = (raw == 32) | (raw == 10)
    inside = ~gap
    starts = np.flatnonzero(inside & np.append(True, gap[:-1])) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    ends = np.flatnonzero(inside & np.append(gap[1:], True)) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    lines = np.cumsum(raw == 10)[starts]
    new = np.append(True, lines[1:] != lines[:-1])
    ids = np.full(len(starts) + int(new.sum()), -1, np.int32)
    ids[np.arange(len(starts)) + np.cumsum(new)] = coded.indices.to_numpy()
    return coded.dictionary.cast(pa.string()), ids


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """A translated text in parts that end where a piece ends, of about ``size`` bytes if pieces are shorter."""
    at = 0
    while len(text) - at > size:
        to = text.find(b"\n", at + size)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def word_packets(docs: DataFrame, packet_bytes: int = PACKET_BYTES) -> DataFrame:
    """Rows packet, lang, words, counts (of the packet's distinct words), body (their order)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            words, ids = tokenise(b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            row = {"packet": [number], "lang": [lang], "words": [words.to_pylist()], "counts": [counts], "body": [squeeze(ids.tobytes())]}
            number += 1
            return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(row.items(), kinds)})

        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in _cut(text.as_buffer().to_pybytes().translate(TRANSLATE), packet_bytes):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= packet_bytes:
                        yield flush(lang)
            while sum(sizes.values()) > 2 * packet_bytes:  # many languages in one task
                yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text <> ''")
    return written(rows.mapInArrow(pack, "packet long, lang string, words array<string>, counts array<long>, body binary"), "word-packets")


# Ids in packets


def _ranked(counted: DataFrame, key: list[str]) -> DataFrame:
    """Add ``id``: 0 for the most frequent row of each language."""
    rows = with_position(counted.withColumn("__less", -F.col("n")), ["lang"], ["__less", *key], "id")
    return written(rows.drop("__less"), "ranked")


def _small(table: DataFrame, size: Column, limit: tuple[int, int]) -> bool:
    rows, bytes_ = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= limit[0] and bytes_ <= limit[1]


def _by_language(table: DataFrame, key: str) -> dict[str, tuple[list, np.ndarray]]:
    found: dict[str, tuple[list, list]] = {}
    for lang, k, i in table.select("lang", key, "id").orderBy("lang", key).collect():
        keys, ids = found.setdefault(lang, ([], []))
        keys.append(k)
        ids.append(i)
    return {lang: (keys, np.array(ids, np.int32)) for lang, (keys, ids) in found.items()}


SEQUENCE = "packet long, lang string, body binary"


def _sequence(packet, lang, ids: np.ndarray) -> pa.RecordBatch:
    body = squeeze(ids.astype(np.int32).tobytes())
    return pa.RecordBatch.from_pydict({"packet": pa.array([packet], pa.int64()), "lang": pa.array([lang], pa.string()), "body": pa.array([body], pa.binary())})


def _ids(body: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(body), np.int32)


def word_sequences(packets: DataFrame, words: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """The packets with the ids of ``words`` (lang, word, id), -1 for other words."""
    if _small(words, F.octet_length("word"), limit):
        known = packets.sparkSession.sparkContext.broadcast(_by_language(words, "word"))

        def look_up(batches):
            for batch in batches:
                for i in range(len(batch)):
                    packet, lang, own, body = (batch.column(c)[i] for c in range(4))
                    ids = _ids(body.as_py())
                    vocabulary, numbers = known.value.get(lang.as_py(), ([], np.zeros(0, np.int32)))
                    at = pc.fill_null(pc.index_in(own.values, pa.array(vocabulary, pa.string())), -1).to_numpy()
                    of_word = np.append(np.append(numbers, -1)[at], -1)
                    yield _sequence(packet.as_py(), lang.as_py(), of_word[ids])

        return written(packets.select("packet", "lang", "words", "body").mapInArrow(look_up, SEQUENCE), "word-sequences")
    own = packets.select("packet", "lang", F.posexplode("words").alias("at", "word"))
    found = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("packet").agg(
        F.collect_list("at").alias("at"), F.collect_list("id").alias("ids")
    )
    joined = packets.select("packet", "lang", F.size("words").alias("n"), "body").join(found, "packet", "left")

    def place(batches):
        for batch in batches:
            for packet, lang, n, body, at, ids in zip(*(c.to_pylist() for c in batch.columns)):
                of_word = np.full(n + 1, -1, np.int32)
                of_word[np.array(at or [], np.int64)] = ids or []
                yield _sequence(packet, lang, of_word[_ids(body)])

    return written(joined.mapInArrow(place, SEQUENCE), "word-sequences")


def _codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair of known neighbours begins, and the pairs as left * 2**32 + right."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, (ids[at].astype(np.int64) << 32) | ids[at + 1].astype(np.int64)


def pair_sequences(sequences: DataFrame, pairs: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """The packets with the ids of ``pairs`` (lang, left, right, id) where those begin, -1 elsewhere."""
    coded = pairs.select("lang", (F.shiftleft(F.col("left").cast("long"), 32) + F.col("right")).alias("code"), "id")
    if _small(coded, F.lit(8), limit):
        known = sequences.sparkSession.sparkContext.broadcast({k: (np.array(c, np.int64), i) for k, (c, i) in _by_language(coded, "code").items()})

        def look_up(batches):
            for batch in batches:
                for packet, lang, body in zip(*(c.to_pylist() for c in batch.columns)):
                    ids = _ids(body)
                    out = np.full(len(ids), -1, np.int32)
                    codes, numbers = known.value.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
                    if len(codes):
                        at, own = _codes(ids)
                        place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                        out[at] = np.where(codes[place] == own, numbers[place], -1)
                    yield _sequence(packet, lang, out)

        return written(sequences.mapInArrow(look_up, SEQUENCE), "pair-sequences")

    def own_codes(batches):
        for batch in batches:
            for packet, lang, body in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.unique(_codes(_ids(body))[1])
                yield pa.RecordBatch.from_pydict({"packet": pa.array(np.full(len(codes), packet), pa.int64()), "lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes, pa.int64())})

    own = sequences.mapInArrow(own_codes, "packet long, lang string, code long")
    found = own.join(coded, ["lang", "code"]).groupBy("packet").agg(F.collect_list("code").alias("codes"), F.collect_list("id").alias("ids"))

    def place(batches):
        for batch in batches:
            for packet, lang, body, codes, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _ids(body)
                out = np.full(len(ids), -1, np.int32)
                if codes:
                    order = np.argsort(codes)
                    codes, numbers = np.array(codes, np.int64)[order], np.array(numbers, np.int32)[order]
                    at, mine = _codes(ids)
                    spot = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
                    out[at] = np.where(codes[spot] == mine, numbers[spot], -1)
                yield _sequence(packet, lang, out)

    return written(sequences.join(found, "packet", "left").select("packet", "lang", "body", "codes", "ids").mapInArrow(place, SEQUENCE), "pair-sequences")


# Tiles


def tile_counts(codes: np.ndarray, counts: np.ndarray | None = None, bits: int = TILE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and their sums: crowded tiles by direct address, the others by sorting."""
    left, right = codes >> 32, codes & 0xFFFFFFFF
    near = np.flatnonzero((left >> bits < DENSE_SIDE) & (right >> bits < DENSE_SIDE))
    tile = (left[near] >> bits) * DENSE_SIDE + (right[near] >> bits)
    crowded = np.flatnonzero(np.bincount(tile, minlength=1) >= 1 << max(0, 2 * bits - 4))
    found, sums, sparse = [], [], np.ones(len(codes), bool)
    low = (1 << bits) - 1
    for t in crowded:
        here = near[tile == t]
        sparse[here] = False
        cells = ((left[here] & low) << bits) | (right[here] & low)
        # Sums below 2**53 are whole numbers in double precision, too.
        total = np.bincount(cells, None if counts is None else counts[here])
        full = np.flatnonzero(total)
        top, side = divmod(int(t), DENSE_SIDE)
        found.append((((top << bits) + (full >> bits)) << 32) | ((side << bits) + (full & low)))
        sums.append(total[full].astype(np.int64))
    rest = np.flatnonzero(sparse)
    if counts is None:
        ordered, n = np.unique(codes[rest], return_counts=True)
    else:
        order = rest[np.argsort(codes[rest], kind="stable")]
        ordered = codes[order]
        edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        n = np.add.reduceat(counts[order], edges) if len(edges) else np.zeros(0, np.int64)
        ordered = ordered[edges]
    return np.concatenate([*found, ordered]), np.concatenate([*sums, n])


class Adder:
    """Adds up codes of one language or bucket; holds the distinct codes and at most ``HELD`` more entries."""

    def __init__(self, bits: int):
        self.bits, self.codes, self.counts, self.waiting, self.n_waiting = bits, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.waiting.append((codes, counts))
        self.n_waiting += len(codes)
        if self.n_waiting >= HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            plain = [c for c, n in self.waiting if n is None]
            parts = [(self.codes, self.counts), *[(c, n) for c, n in self.waiting if n is not None]]
            if plain:
                parts.append(tile_counts(np.concatenate(plain), None, self.bits))
            self.codes, self.counts = tile_counts(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]), self.bits)
            self.waiting, self.n_waiting = [], 0
        return self.codes, self.counts


MESSAGE = "lang string, bucket int, source int, body binary"


def _message(lang: str, bucket: int, source: int, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(codes)
    body = join_parts(squeeze(np.diff(codes[order], prepend=0).tobytes()), squeeze(counts[order].astype(np.int64).tobytes()))
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "bucket": pa.array([bucket], pa.int32()), "source": pa.array([source], pa.int32()), "body": pa.array([body], pa.binary())})


def _opened(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = (np.frombuffer(unsqueeze(p), np.int64) for p in split_parts(body))
    return np.cumsum(gaps), counts


def _bucket(codes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    tile = ((codes >> 32 >> bits).astype(np.uint64) << np.uint64(32)) | ((codes & 0xFFFFFFFF) >> bits).astype(np.uint64)
    return ((tile * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def count_pairs(sequences: DataFrame, least: int, buckets: int, bits: int = TILE_BITS, fan_in: int = FAN_IN) -> DataFrame:
    """Rows lang, left, right, n of the neighbouring ids that occur ``least`` times or more."""

    def send(batches):
        source = TaskContext.get().partitionId()
        adders: dict[str, Adder] = {}

        def flush():
            for lang, adder in adders.items():
                codes, counts = adder.settle()
                to = _bucket(codes, buckets, bits)
                order = np.argsort(to, kind="stable")
                edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=buckets))
                for a, b in zip(edges[:-1], edges[1:]):
                    yield _message(lang, int(to[order[a]]), source, codes[order[a:b]], counts[order[a:b]])
            adders.clear()

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = _codes(_ids(body.as_py()))[1]
                if len(codes):
                    adders.setdefault(lang, Adder(bits)).add(codes)
                if sum(len(a.codes) + a.n_waiting for a in adders.values()) >= SENT:
                    yield from flush()
        yield from flush()

    def merge(batches, out):
        key, adder = None, None
        for batch in batches:
            for *now, body in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if now != key:
                    if adder:
                        yield out(*key, *adder.settle())
                    key, adder = now, Adder(bits)
                adder.add(*_opened(body))
        if adder:
            yield out(*key, *adder.settle())

    def frequent(lang, bucket, source, codes, counts):
        often = counts >= least
        codes, counts = codes[often], counts[often]
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "left": pa.array(codes >> 32, pa.int64()), "right": pa.array(codes & 0xFFFFFFFF, pa.int64()), "n": pa.array(counts, pa.int64())})

    def together(messages: DataFrame) -> DataFrame:
        return messages.repartition("lang", "bucket", "source").sortWithinPartitions("lang", "bucket", "source")

    messages = written(sequences.select("lang", "body").mapInArrow(send, MESSAGE), "tile-messages")
    sources = (messages.agg(F.max("source")).first()[0] or 0) + 1
    while sources > fan_in:
        grouped = messages.withColumn("source", F.floor(F.col("source") / fan_in).cast("int"))
        messages = written(together(grouped).mapInArrow(lambda b: merge(b, _message), MESSAGE), "tile-messages")
        sources = -(-sources // fan_in)
    final = together(messages.withColumn("source", F.lit(0)))
    return final.mapInArrow(lambda b: merge(b, frequent), "lang string, left long, right long, n long")


# Phrases and scores


def _scored(rows: DataFrame, cuts: list[tuple[Column, Column]]) -> DataFrame:
    """Add l, r, score of the lowest-scoring cut (the first of equal ones)."""
    whole = "decimal(38,0)"
    scores = [
        F.struct(
            F.expr("CAST(n AS decimal(20,0)) * CAST(2000000 AS decimal(7,0))").cast(whole).alias("a"),
            (left + right).alias("b"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"),
        )
        for k, (left, right) in enumerate(cuts)
    ]
    exact = F.transform(F.array(*scores), lambda c: F.struct(_quotient(c["a"], c["b"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    return rows.withColumn("best", F.array_min(exact)).select("*", "best.score", "best.l", "best.r").drop("best")


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b.cast("decimal(38,0)"))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, packet_bytes: int = PACKET_BYTES,
    tile_bits: int = TILE_BITS, fan_in: int = FAN_IN, limit: tuple[int, int] = (BROADCAST_ROWS, BROADCAST_BYTES),
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    packets = word_packets(docs, packet_bytes)
    rows = packets.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = written(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n_all")), "language-sizes")
    buckets = max(1, (totals.agg(F.sum("n_all")).first()[0] or 0) // BUCKET_WORDS)
    words = _ranked(words.filter(F.col("n") >= least), ["word"])

    def counted(sequences: DataFrame) -> DataFrame:
        return _ranked(count_pairs(sequences, least, buckets, tile_bits, fan_in), ["left", "right"])

    def parts(pairs: DataFrame, table: DataFrame) -> DataFrame:
        """The pairs with their parts as structs L and R."""
        row = F.struct(*[c for c in table.columns if c not in ("lang", "id")])
        left = table.select("lang", F.col("id").alias("left"), row.alias("L"))
        right = table.select("lang", F.col("id").alias("right"), row.alias("R"))
        return pairs.join(left, ["lang", "left"]).join(right, ["lang", "right"])

    # Of a phrase: the frequencies of its parts, as p<first word><last word>.
    sequences = word_sequences(packets, words, limit)
    pairs = counted(sequences)
    two = parts(pairs, words).select(
        "lang", "id", "n", F.concat_ws(" ", "L.word", "R.word").alias("phrase"), F.col("R.word").alias("last"), F.col("L.n").alias("p11"), F.col("R.n").alias("p22")
    )
    two = written(two, "phrases-2")
    sequences = pair_sequences(sequences, pairs, limit)
    pairs3 = counted(sequences)
    three = parts(pairs3, two).select(
        "lang", "id", "left", "right", "n", F.concat_ws(" ", "L.phrase", "R.last").alias("phrase"), F.col("R.last").alias("last"),
        F.col("L.p11").alias("p11"), F.col("L.n").alias("p12"), F.col("R.n").alias("p23"), F.col("R.p22").alias("p33"),
    )
    three = written(three, "phrases-3")
    pairs4 = counted(pair_sequences(sequences, pairs3, limit))
    four = parts(pairs4, three).select(
        "lang", "id", "left", "right", "n", F.concat_ws(" ", "L.phrase", "R.last").alias("phrase"),
        F.col("L.p11").alias("p11"), F.col("L.p12").alias("p12"), F.col("L.n").alias("p13"),
        F.col("R.n").alias("p24"), F.col("R.p23").alias("p34"), F.col("R.p33").alias("p44"),
    )
    four = written(four, "phrases-4")

    def uncovered(phrases: DataFrame, longer: DataFrame) -> DataFrame:
        # A longer phrase that holds this one holds one of one word more that does, and is no more frequent.
        inside = longer.select("lang", F.col("left").alias("id"), F.col("n").alias("m")).union(longer.select("lang", "right", "n"))
        most = inside.groupBy("lang", "id").agg(F.max("m").alias("m"))
        held = F.col("m").cast("decimal(38,0)") * 100 >= F.col("n").cast("decimal(38,0)") * covered
        return phrases.join(most, ["lang", "id"], "left").filter(F.col("m").isNull() | ~held)

    c = F.col
    found = [
        _scored(uncovered(two, three), [(c("p11"), c("p22"))]),
        _scored(uncovered(three, four), [(c("p11"), c("p23")), (c("p12"), c("p33"))]),
        _scored(four, [(c("p11"), c("p24")), (c("p12"), c("p34")), (c("p13"), c("p44"))]),
    ]
    all_of = [f.select("lang", "phrase", F.col("n").alias("a"), "l", "r", "score") for f in found]
    # row_number() <= top lets every map task keep its own best rows only.
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = all_of[0].union(all_of[1]).union(all_of[2]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_all").alias("n"), "score")
