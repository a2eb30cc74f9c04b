"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows: of each class the ``EXAMPLES`` rows with the smallest
hash of their doc_id. Terms are words and their beginnings of ``STEMS`` characters (so that all forms of an
insult count together): over the examples, the at most ``TERMS`` with the largest chi-squared with the
label, of those with ``LEAST_CHI2`` or more that are ``LEAST_RATIO`` times as frequent among toxic examples
as among others. Document frequencies are counted over all documents.

The examples lie in blocks of similar ones in an inverted index that keeps, for each term and block, the
largest weight. A query scores the blocks with the largest bounds first; blocks whose bound lies below the
k-th score found there can't hold a neighbour, so its neighbours are those of a full scan. The neighbours vote with
a weight that falls with distance and that undoes the class balance of the sample; Platt scaling over the
examples' own left-out votes turns votes into probabilities. The nearest neighbours are kept as evidence.

A label is learned from only if crc32 of the doc_id's text leaves a remainder by 5; scores see texts only.

Defined cases: a null text is empty; a text without any of the terms has no neighbour and gets the rate of
such examples; a doc_id labelled more than once has its largest label; null labels and null doc_ids are not
learned from; without examples every score is 0; an empty table gives no rows; a column of the documents
that is named as a result is left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import held_out, tidy

EXAMPLES = 4096
TERMS = 2048
LEAST_CHI2 = 25.0
LEAST_RATIO = 10.0
#: Weight of the base rate among the votes: neighbours that are hardly similar decide little.
BASE_VOTES = 0.3
NEIGHBOURS = 25
BLOCK, FIRST_BLOCKS = 64, 4
STEMS = range(3, 9)
CACHE_WORDS = 100_000
#: Scores of equal term vectors that a task keeps at once.
KNOWN_VECTORS = 10_000
COUNTED_TERMS = 400_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    if not (word[:1].isalnum() and word[-1:].isalnum()):
        word = _EDGES.sub("", word)
    return word.lower()


def features(word: str) -> set[str]:
    """A raw word without the punctuation around it, in lower case, and its beginnings (with a dash)."""
    word = bare(word)
    return {word, *(word[:n] + "-" for n in STEMS if len(word) >= n)} if word else set()


class _Numbers(dict):
    """Numbers of a raw word's terms, as bytes."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.terms = {t: i for i, t in enumerate(terms)}
        self.starts = {t[: STEMS[0]] for t in terms}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = b""
        if bare(word)[: STEMS[0]] in self.starts or len(word) < STEMS[0]:
            found = np.array(sorted(self.terms[f] for f in features(word) if f in self.terms), np.int32).tobytes()
        if len(word) <= 64:
            self[word] = found
        return found

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, text.split())), np.int32), return_counts=True)


def _weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w * w).sum())


class BlockMaxIndex:
    """Postings of examples in blocks, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        # Examples whose heaviest terms are equal lie together, which makes the bounds tight.
        heaviest = [(int(t[np.argmax(w)]), -float(w.max()), i) for i, (t, w) in enumerate(vectors)]
        self.order = np.array([i for _, _, i in sorted(heaviest)], dtype=np.int64)
        self.n, self.block, self.n_blocks = len(vectors), block, -(-len(vectors) // block)
        place = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in self.order])
        terms = np.concatenate([vectors[i][0] for i in self.order])
        weights = np.concatenate([vectors[i][1] for i in self.order])
        self.most = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.most, (terms, place // block), weights)
        by_term = np.argsort(terms, kind="stable")  # a term's postings stay in block order
        ends = np.searchsorted(terms[by_term], np.arange(n_terms + 1))
        self.postings = [(place[by_term[x:y]], weights[by_term[x:y]]) for x, y in zip(ends[:-1], ends[1:])]

    def _scores(self, terms: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the chosen blocks that share a term with the query, and their cosines."""
        where = np.concatenate([self.postings[t][0] for t in terms])
        value = np.concatenate([self.postings[t][1] * w for t, w in zip(terms, weights)])
        inside = chosen[where // self.block]
        total = np.bincount(where[inside], value[inside], minlength=self.n)
        hit = np.flatnonzero(total > 0)
        return self.order[hit], total[hit]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine above 0 (ties: the earlier example), best first.

        The blocks with the largest bounds are scored first; the k-th score found there rules out all blocks
        whose bound is below it, and the others are scored in a second step.
        """
        bound = weights @ self.most[terms]
        chosen = np.zeros(self.n_blocks, dtype=bool)
        chosen[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        ids, scores = self._scores(terms, weights, chosen)
        least = np.partition(scores, -k)[-k] if len(scores) >= k else 0.0
        more = (bound >= least - 1e-12) & (bound > 0) & ~chosen
        if more.any():
            other, also = self._scores(terms, weights, more)
            ids, scores = np.concatenate([ids, other]), np.concatenate([scores, also])
        best = np.lexsort((ids, -np.round(scores, 12)))[:k]
        return ids[best], scores[best]


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    doc_ids: np.ndarray
    toxic: np.ndarray
    class_weight: np.ndarray
    index: BlockMaxIndex | None
    bare_rate: float
    base_rate: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, terms: np.ndarray, counts: np.ndarray, leave: int | None = None) -> tuple[float, list[tuple[int, float, int]]]:
        if not len(terms) or self.index is None:
            return float("nan"), []
        ids, cosine = self.index.top(terms, _weights(terms, counts, self.idf), NEIGHBOURS + (leave is not None))
        if leave is not None:
            ids, cosine = ids[ids != leave][:NEIGHBOURS], cosine[ids != leave][:NEIGHBOURS]
        if not len(ids):
            return float("nan"), []
        y = self.toxic[ids]
        w = self.class_weight[y] * cosine**2 / (1.05 - cosine)
        evidence = [(int(self.doc_ids[i]), float(c), int(t)) for i, c, t in zip(ids[:3], cosine[:3], y[:3])]
        return float(((w * y).sum() + BASE_VOTES * self.base_rate) / (w.sum() + BASE_VOTES)), evidence

    def score(self, vote: float) -> float:
        if math.isnan(vote):
            return self.bare_rate
        return 1 / (1 + math.exp(-(self.slope * _logit(vote) + self.shift)))


def _logit(vote: float) -> float:
    v = min(max(vote, 0.01), 0.99)
    return math.log(v / (1 - v))


def _platt(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the votes, by Newton's method with smoothed targets."""
    x = np.array([_logit(v) for v in votes])
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, h = weight * (p - target), weight * p * (1 - p)
        # A weak prior towards slope 1 keeps the step defined where all votes agree.
        grad = np.array([(g * x).sum() + 0.1 * (a - 1), g.sum() + 0.01 * b])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.1), b


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Model:
    """Learn from the labelled documents that are not held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = dict(known.groupBy("toxic").count().collect())
    picked = []
    for value in (0, 1):
        picked += known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect()
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in picked], "id long, toxic int"))
    chosen = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("id")).select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))

    def distinct_terms(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            rows = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows], pa.string()), "a": pa.array([c[1] for _, c in rows], pa.int64()), "df": pa.array([c[0] + c[1] for _, c in rows], pa.int64())})

        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for term in set().union(*map(features, set(text.split()))):
                    counts.setdefault(term, [0, 0])[label] += 1
                if len(counts) > COUNTED_TERMS:
                    yield flush()
        yield flush()

    n = chosen.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in n}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    seen = chosen.mapInArrow(tidy(distinct_terms), "word string, a long, df long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("df").alias("df"))
    # Chi-squared of term against label: a toxic and b clean examples have it, c and d have not.
    a, b = F.col("a").cast("double"), (F.col("df") - F.col("a")).cast("double")
    c, d = n1 - a, n0 - b
    chi2 = (n1 + n0) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * F.lit(float(max(1, n1)) * max(1, n0)))
    telling = (a + 0.5) * (n0 + 1) >= LEAST_RATIO * (b + 0.5) * (n1 + 1)
    chosen_terms = seen.withColumn("chi2", chi2).filter((F.col("chi2") >= LEAST_CHI2) & telling).orderBy(F.desc("chi2"), "word").limit(terms)
    names = sorted(r.word for r in chosen_terms.select("word").collect()) if n1 and n0 else []

    def frequencies(batches):
        numbers, total, rows = _Numbers(names), np.zeros(len(names), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.column(0).to_pylist():
                total[numbers.count(text or "")[0]] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(range(-1, len(names)), pa.int32()), "df": pa.array([rows, *total.tolist()], pa.int64())})

    df = dict(docs.select("text").mapInArrow(tidy(frequencies), "term int, df long").groupBy("term").agg(F.sum("df")).collect())
    idf = np.array([math.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) + 1 for i in range(len(names))])

    def vectors(batches):
        numbers = _Numbers(names)
        for batch in batches:
            counted = [numbers.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(1), "terms": pa.array([t for t, _ in counted], pa.list_(pa.int32())), "counts": pa.array([c for _, c in counted], pa.list_(pa.int64()))})

    rows = chosen.mapInArrow(tidy(vectors), "doc_id long, toxic int, terms array<int>, counts array<long>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.terms, r.counts))
    full = [r for r in rows if r.terms]
    toxic = np.array([r.toxic for r in full], dtype=np.int64)
    weight = np.array([sizes.get(v, 0) / max(1, n.get(v, 0)) for v in (0, 1)])
    weight = weight / max(weight.max(), 1e-9)
    bare = [sum(weight[v] for r in rows if not r.terms and r.toxic == v) for v in (0, 1)]
    bare_rate = (bare[1] + weight[1]) / (sum(bare) + weight.sum()) if rows and len(sizes) == 2 else float(max(sizes, default=0))
    counted = [(np.array(r.terms, np.int32), np.array(r.counts, np.int64)) for r in full]
    index = BlockMaxIndex([(t, _weights(t, c, idf)) for t, c in counted], len(names)) if full else None
    model = Model(names, idf, np.array([r.doc_id for r in full], dtype=np.int64), toxic, weight, index, float(bare_rate), sizes.get(1, 0) / max(1, sum(sizes.values())))
    votes = np.array([model.vote(t, c, leave=i)[0] for i, (t, c) in enumerate(counted)])
    fair = ~np.isnan(votes)
    if fair.any() and len(set(toxic[fair].tolist())) == 2:
        model.slope, model.shift = _platt(votes[fair], toxic[fair].astype(float), weight[toxic[fair]])
    return model


def add_scores(docs: DataFrame, model: Model, score: str = "score", evidence: str = "evidence") -> DataFrame:
    """``docs`` with a toxicity score and its nearest labelled examples (doc_id, cosine, toxic)."""
    docs = docs.select([c for c in docs.columns if c not in (score, evidence)])
    where = docs.columns.index("text")
    kind = StructType.fromDDL(f"`{score}` double, `{evidence}` array<struct<doc_id: long, cosine: double, toxic: int>>")
    schema = StructType([*docs.schema.fields, *kind.fields])
    example = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        numbers, known = _Numbers(model.terms), {}
        for batch in batches:
            scores, found = [], []
            for text in batch.column(where).to_pylist():
                terms, counts = numbers.count(text or "")
                key = (terms.tobytes(), counts.tobytes())
                if key not in known:
                    if len(known) > KNOWN_VECTORS:
                        known.clear()
                    vote, near = model.vote(terms, counts)
                    known[key] = model.score(vote), [dict(zip(("doc_id", "cosine", "toxic"), e)) for e in near]
                s, e = known[key]
                scores.append(s)
                found.append(e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, example)], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)
