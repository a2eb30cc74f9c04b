"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of variable order up to ``ORDER``: how often each byte followed each
context. A byte's probability under a context is its share there, or the escape probability (method C:
distinct / (total + distinct)) times that under the next shorter context, down to 1/256. The code length of a
text is the sum over all its bytes, under statistics that no longer change; the language with the shortest
code is predicted.

Trees are kept sparsely, as sorted tables of the contexts and of the (context, byte) pairs seen in each language,
so every context of the sample counts. In numpy, over many documents at once, the distinct grams (a byte with the
bytes before it) get their code length in each language once, and texts add them up. Texts are lower-cased and
preceded by line breaks.

Trees are fitted on a bounded sample: of each language the ``TRAIN_DOCS`` documents with the smallest hash
of their doc_id among those of at most ``TRAIN_CHARS`` characters. Whole texts are scored, long ones in segments that carry their context.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if no
language was learned; a null doc_id is not held out; documents without lang are not learned from; equal code
lengths go to the alphabetically first language; other columns are returned as they are, but for one that is
named as a result, which is left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import held_out

ORDER = 3
TRAIN_DOCS = 1000
TRAIN_CHARS = 1 << 16
SEGMENT = 1 << 20
LEAD = b"\n" * ORDER
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte after the lead with the ORDER bytes before it, as one number (oldest byte highest)."""
    out = np.zeros(max(0, len(data) - ORDER), dtype=np.int64)
    for k in range(ORDER + 1):
        out = (out << 8) | data[k : k + len(out)]
    return out


class Trees:
    """Context trees of several languages from counts of grams: ``counts[lang] = (grams, numbers)``.

    With ``cells`` only the contexts most frequent over all languages are kept, down to that many table cells.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], cells: int | None = None):
        self.languages = sorted(counts)
        symbols = np.unique(np.concatenate([g & 255 for g, _ in counts.values()] + [np.array(list(LEAD))]))
        self.width = len(symbols) + 1  # the last symbol stands for bytes never seen

        # A node is a context: its bytes, newest lowest, and how many.
        total: dict[int, list] = {}
        for order in range(1, ORDER + 1):
            parts = [((g >> 8) & ((1 << 8 * order) - 1), n) for g, n in counts.values()]
            contexts, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            total[order] = [contexts, np.bincount(where, np.concatenate([n for _, n in parts]))]
        order_of = np.repeat(np.arange(1, ORDER + 1), [len(total[k][0]) for k in total])
        context = np.concatenate([total[k][0] for k in total])
        often = np.concatenate([total[k][1] for k in total])
        room = len(context) if cells is None else max(1, cells // self.width) - 1
        # A longer context is never more frequent than its shorter one, so the choice is closed downwards.
        best = np.lexsort((context, order_of, -often))[:room]
        self.n = 1 + len(best)
        chosen = [np.zeros(1, np.int64), *(np.sort(context[best[order_of[best] == k]]) for k in range(1, ORDER + 1))]

        # Of each language and order: contexts, bits of an escape from each, pairs, bits of each pair.
        self.tables = []
        for lang in self.languages:
            g, n = counts[lang]
            own = []
            for order in range(ORDER + 1):
                pairs, where = np.unique(g & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
                seen = np.bincount(where, n, minlength=len(pairs))
                kept = np.isin(pairs >> 8, chosen[order])
                pairs, seen = pairs[kept], seen[kept]
                contexts, where, distinct = np.unique(pairs >> 8, return_inverse=True, return_counts=True)
                all_ = np.bincount(where, seen, minlength=len(contexts)) + distinct
                own.append((contexts, -np.log2(distinct / all_), pairs, -np.log2(seen / all_[where])))
            self.tables.append(own)

    def _bits(self, own: list, g: np.ndarray) -> np.ndarray:
        """Code lengths of grams in one language."""
        bits = np.zeros(len(g))
        left = np.arange(len(g))
        for order in range(ORDER, -1, -1):
            contexts, escape, pairs, length = own[order]
            if not len(pairs):
                continue
            key = g[left] & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            hit = pairs[at] == key
            bits[left[hit]] += length[at[hit]]
            left, key = left[~hit], key[~hit] >> 8
            at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
            known = contexts[at] == key
            bits[left[known]] += escape[at[known]]
        bits[left] += 8
        return bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        held, size = [], 0
        for i, text in enumerate(texts):
            for a in range(0, len(text), SEGMENT):
                before = (LEAD + text[:a])[-ORDER:] if a < ORDER else text[a - ORDER : a]
                held.append((i, before + text[a : a + SEGMENT]))
                size += len(held[-1][1])
                if size >= SEGMENT:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, segments: list[tuple[int, bytes]]) -> None:
        if not segments:
            return
        s = np.frombuffer(b"".join(d for _, d in segments), np.uint8)
        g = grams(s).astype(np.uint32)  # ORDER + 1 bytes
        # Positions of leads belong to no text.
        lengths = np.array([len(d) for _, d in segments])
        starts = np.cumsum(lengths) - lengths
        real = np.ones(len(s), dtype=bool)
        for k in range(ORDER):
            real[starts + k] = False
        real = real[ORDER:]
        first = np.concatenate([[0], np.cumsum(lengths - ORDER)[:-1]])
        distinct, where = np.unique(g[real], return_inverse=True)
        distinct = distinct.astype(np.int64)
        for k, own in enumerate(self.tables):
            np.add.at(out[:, k], [i for i, _ in segments], np.add.reduceat(self._bits(own, distinct)[where], first))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gram counts of each language over the sample; bounded by languages * train_docs * train_chars."""
    rows = docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    rows = rows.filter(~held_out(F.col("doc_id")) & (F.char_length("text") <= train_chars))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= train_docs)
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.lang) for r in ids.collect()], "id long, l string")

    def count(batches):
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(np.frombuffer(LEAD + prepared(text), np.uint8)))
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(g), "gram": g, "n": n})

    sample = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))).select("text", "lang")
    found = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, gram, n = np.array(found.column("lang").to_pylist(), dtype=object), found.column("gram").to_numpy(), found.column("n").to_numpy()
    return {lang: (gram[langs == lang], n[langs == lang].astype(np.float64)) for lang in sorted(set(langs.tolist()))}


def identify(texts: list[str | None], trees: Trees | None) -> tuple[list[str], list[float]]:
    chosen = [i for i, t in enumerate(texts) if trees and t is not None and _LETTER.search(t)]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if chosen:
        bits = trees.code_lengths([prepared(texts[i]) for i in chosen])
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        for i, b, s in zip(chosen, best, share):
            langs[i], scores[i] = trees.languages[b], float(s)
    return langs, scores


def add_languages(docs: DataFrame, counts: dict, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share among all languages' code probabilities."""
    docs = docs.select([c for c in docs.columns if c not in (lang, score)])
    where = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{lang}` string, `{score}` double").fields])
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # bounded by the sample
    name = uuid.uuid4().hex

    def run(batches):
        kept = sys.__dict__.setdefault("_context_trees", {})
        if name not in kept:  # worked out once for each worker process
            kept.clear()
            kept[name] = Trees(shared.value) if shared.value else None
        for batch in batches:
            langs, scores = identify(batch.column(where).to_pylist(), kept[name])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
