"""Largest inner products with a hierarchical navigable small-world graph per shard.

Distinct vectors of one length are dealt by hash into shards of about ``SHARD_VECTORS``. Each shard has its own
graph: nodes are inserted in a random order, each looks for its neighbours by a beam search of the graph so far,
layer by layer, links to diverse ones among those found, and they link back. Nodes go in in batches of at most a
quarter of the graph so far (``BATCH`` at most), so that one numpy call moves all their beams; those of a batch are
compared with each other. Layers thin out geometrically. The graph is kept as flat arrays of links and offsets.

Inner products are made a metric by one more coordinate that brings all vectors of a shard to one length; in the last
step each node is also linked to those of largest inner product with it, as queries lead to long vectors. A node without
a neighbour in layer 1 is raised into it, so that small clusters aren't missed there; nodes that no path reaches get a link from the nearest reached one. Queries come in blocks; each block walks the graphs of its length,
and the shards' results are merged.

Equal vectors are one node with its smallest vec_ids (as many as a result can hold), so a very common vector
neither fills a shard nor crowds a beam. Scores are inner products of the original vectors in doubles.

Recall at 20 against brute force: see README and tests.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without vec_id; vectors meet only those of their own length; repeated rows (same vec_id and vector)
are one; a query never meets rows of its own vec_id; with fewer candidates than asked for, all found are returned;
equal scores are ordered by vec_id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.packets import join_parts, split_parts

SHARD_VECTORS = 8192
QUERY_BLOCK = 1024
LINKS = 16
BUILD_BEAM = 64
BATCH = 512
BEAM = 256
UPPER = 4
THINNING = 8


# One shard


def _select(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of each row of candidates (nearest first, sims -inf: none) ``keep``: those nearer to the node than to one chosen
    before, then the nearest of the others. The number of vectors stands for none."""
    rows, none = np.arange(len(near))[:, None], len(vectors) - 1
    cand = vectors[near]
    between = cand @ cand.transpose(0, 2, 1)
    chosen, real = np.zeros(near.shape, dtype=bool), sims > -np.inf
    for j in range(near.shape[1]):
        blocked = (chosen & (between[:, j, :] > sims[:, j, None])).any(axis=1)
        chosen[:, j] = ~blocked & real[:, j] & (chosen.sum(axis=1) < keep)
    order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :keep]
    return np.where(real[rows, order], near[rows, order], none)


def _ranked(near: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _walk(vectors, table, queries, at, sim, width):
    """Beam search of one layer from the nodes ``at`` with similarities ``sim``; the ``width`` best found, best first.

    ``vectors`` ends with a row for "no node", and ``table`` names that row where a node has no more links.
    """
    q, n = len(queries), len(vectors) - 1
    at, sim = _ranked(at, sim, width)
    if at.shape[1] < width:
        more = width - at.shape[1]
        at = np.pad(at, ((0, 0), (0, more)), constant_values=n)
        sim = np.pad(sim, ((0, 0), (0, more)), constant_values=-np.inf)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True
    np.put_along_axis(seen, at, True, axis=1)
    done, active = at == n, np.arange(q)
    while len(active):
        todo = np.where(done[active], -np.inf, sim[active])
        pick = np.argsort(-todo, axis=1, kind="stable")[:, : max(8, width // 24)]
        chosen = np.take_along_axis(todo, pick, axis=1) > -np.inf
        live = chosen.any(axis=1)
        active, pick, chosen = active[live], pick[live], chosen[live]
        if not len(active):
            break
        spots = np.where(chosen, np.take_along_axis(at[active], pick, axis=1), n)
        flags = done[active]
        np.put_along_axis(flags, pick, True, axis=1)
        done[active] = flags
        near = np.sort(table[spots].reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[active[:, None], near], n, near)
        near = np.sort(near, axis=1)[:, : max(1, int((near < n).sum(axis=1).max()))]
        seen[active[:, None], near] = True
        found = (vectors[near] @ queries[active][:, :, None])[:, :, 0]
        found[near == n] = -np.inf
        all_at = np.concatenate([at[active], near], axis=1)
        all_sim = np.concatenate([sim[active], found], axis=1)
        all_done = np.concatenate([done[active], near == n], axis=1)
        order = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
        at[active], sim[active], done[active] = (np.take_along_axis(x, order, axis=1) for x in (all_at, all_sim, all_done))
    return at, sim


class Graph:
    """The layers of one shard as tables of links by node; layer 0 has all nodes, ``entry`` is a node of the last."""

    def __init__(self, vectors: np.ndarray, tables: list[np.ndarray], entry: int):
        self.vectors, self.tables, self.entry = vectors, tables, entry
        self._ended = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> "Graph":
        """Insert all nodes in the order of a hash. Those of one batch, at most a quarter of the graph so far, look for
        their neighbours in that graph at the same time and among each other."""
        n = len(vectors)
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        whole = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)
        whole = np.vstack([whole, np.zeros((1, whole.shape[1]), np.float32)])
        draw = np.array([(xxhash.xxh64_intdigest(v.tobytes()) + 1) / (2**64 + 1) for v in vectors])
        level = np.minimum(np.floor(-np.log(draw) / math.log(THINNING)).astype(int), 8)
        order = np.argsort([xxhash.xxh64_intdigest(v.tobytes(), seed=1) for v in vectors], kind="stable")
        tables = [np.full((n + 1, links * 2 if k == 0 else links), n, dtype=np.int64) for k in range(level.max() + 1)]
        entry, at = int(order[0]), 0
        while at < n:
            batch = order[at : at + min(BATCH, max(16, at // 4))]
            at += len(batch)
            top = level[entry] if at > len(batch) else -1
            queries = whole[batch]
            found = np.full((len(batch), 1), entry, dtype=np.int64)
            sims = queries @ whole[entry][:, None]
            for k in range(len(tables) - 1, -1, -1):
                if k <= top:
                    found, sims = _walk(whole, tables[k], queries, found, sims, beam)
                joins = level[batch] >= k
                if joins.any():
                    seen = (found[joins], sims[joins]) if k <= top else (found[joins][:, :0], sims[joins][:, :0])
                    _join(whole, tables[k], batch[joins], *seen, links)
            best = batch[np.argmax(level[batch])]
            if level[best] > level[entry] or top < 0:
                entry = int(best)
        graph = cls(vectors, tables, entry)
        graph._cover(whole, level, links, beam)
        graph._reach(level)
        graph._outward()
        return graph

    def _cover(self, whole: np.ndarray, level: np.ndarray, links: int, beam: int) -> None:
        """Raise nodes into layer 1 until every node is in it or links to one that is, so that no cluster is missed there."""
        if len(self.tables) == 1:
            return
        n, table = len(self.vectors), self.tables[0]
        upper = np.append(level >= 1, False)
        covered = upper[:n] | upper[table[:n]].any(axis=1)
        raised = []
        for node in np.flatnonzero(~covered):
            if not covered[node]:
                raised.append(node)
                near = table[node][table[node] < n]
                covered[near[(table[near] == node).any(axis=1)]] = True
        for a in range(0, len(raised), BATCH):
            batch = np.array(raised[a : a + BATCH])
            at = np.full((len(batch), 1), self.entry, dtype=np.int64)
            sim = whole[batch] @ whole[self.entry][:, None]
            for k in range(level[self.entry], 0, -1):
                at, sim = _walk(whole, self.tables[k], whole[batch], at, sim, beam)
            _join(whole, self.tables[1], batch, at, sim, links)
            level[batch] = 1

    def _reach(self, level: np.ndarray) -> None:
        """Give every node that no path from the entry finds in its layer a link from the nearest node found."""
        n = len(self.vectors)
        for k, table in enumerate(self.tables):
            members = level >= k
            reached = np.zeros(n + 1, dtype=bool)
            # Layers are entered at nodes of the layer above, all of which have been reached.
            front = np.flatnonzero(level > k) if k < level.max() else np.array([self.entry])
            while True:
                reached[front] = True
                while len(front):
                    front = np.unique(table[front])
                    front = front[~reached[front] & (front < n)]
                    reached[front] = True
                lost = np.flatnonzero(members & ~reached[:n])
                if not len(lost):
                    break
                known, one = np.flatnonzero(reached[:n] & members), lost[:1]
                nearest_known = known[np.argmin(((self.vectors[known] - self.vectors[one]) ** 2).sum(axis=1))]
                free = np.flatnonzero(table[nearest_known] == n)
                if not len(free):
                    table = self.tables[k] = np.column_stack([table, np.full(n + 1, n)])
                    free = [table.shape[1] - 1]
                table[nearest_known, free[0]] = one[0]
                front = one

    def _outward(self) -> None:
        """Link every node to those of largest inner product with it, where long vectors gather."""
        n, found = len(self.vectors), []
        for a in range(0, n, BATCH):
            ids, _ = self.search(self.vectors[a : a + BATCH], BUILD_BEAM // 2)
            found.append(np.where(ids < 0, n, ids)[:, :LINKS])
        found = np.vstack([*found, np.full((1, found[0].shape[1]), n)])
        found[found == np.arange(n + 1)[:, None]] = n
        table = np.sort(np.column_stack([self.tables[0], found]), axis=1)
        table[:, 1:][table[:, 1:] == table[:, :-1]] = n
        table = np.sort(table, axis=1)
        self.tables[0] = table[:, : max(1, int((table < n).sum(axis=1).max()))]

    def dump(self) -> bytes:
        """Flat arrays: vectors, and for each layer its links and where those of each node begin."""
        n, d = self.vectors.shape
        parts = [np.array([n, d, len(self.tables), self.entry], np.int64).tobytes(), self.vectors.astype("<f4").tobytes()]
        for table in self.tables:
            real = table[:n] < n
            parts += [table[:n][real].astype("<i4").tobytes(), np.append(0, np.cumsum(real.sum(axis=1))).astype("<i8").tobytes()]
        return join_parts(*parts)

    @classmethod
    def load(cls, body: bytes) -> "Graph":
        head, vectors, *rest = split_parts(body)
        n, d, k, entry = (int(x) for x in np.frombuffer(head, np.int64))
        tables = []
        for i in range(k):
            tails, offsets = np.frombuffer(rest[2 * i], "<i4"), np.frombuffer(rest[2 * i + 1], "<i8")
            sizes = np.diff(offsets)
            table = np.full((n + 1, max(1, int(sizes.max()))), n, dtype=np.int64)
            rows = np.repeat(np.arange(n), sizes)
            table[rows, np.arange(len(tails)) - offsets[rows]] = tails
            tables.append(table)
        return cls(np.frombuffer(vectors, "<f4").reshape(n, d), tables, entry)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each query, node numbers (-1: none) and single-precision scores, best first."""
        queries = queries.astype(np.float32)
        at = np.full((len(queries), 1), self.entry, dtype=np.int64)
        sim = queries @ self.vectors[self.entry][:, None]
        # Wider above layer 0: clusters far from each other are found or lost there.
        for table in self.tables[:0:-1]:
            at, sim = _walk(self._ended, table, queries, at, sim, UPPER * beam)
        at, sim = _walk(self._ended, self.tables[0], queries, at, sim, beam)
        return np.where(at < len(self.vectors), at, -1), sim


def _join(whole, table, nodes, near, sims, links) -> None:
    """Link new nodes of a layer to the diverse nearest of ``near`` and of each other, and those back to them."""
    none = len(whole) - 1
    own = whole[nodes] @ whole[nodes].T
    np.fill_diagonal(own, -np.inf)
    most = max(near.shape[1], 1) if near.shape[1] else 2 * links
    near = np.concatenate([near, np.broadcast_to(nodes, own.shape)], axis=1)
    near, sims = _ranked(near, np.concatenate([sims, own], axis=1), most)
    picked = _select(np.where(sims > -np.inf, near, none), sims, whole, links)
    table[nodes, : picked.shape[1]] = picked
    # Back links: old and new ones of a node together, thinned where they are too many.
    tail, head = np.repeat(nodes, picked.shape[1]), picked.ravel()
    tail, head = tail[head < none], head[head < none]
    strength = np.einsum("ij,ij->i", whole[head], whole[tail])
    order = np.lexsort((-strength, head))
    head, tail = head[order], tail[order]
    targets, first = np.unique(head, return_index=True)
    width = table.shape[1]
    place = np.arange(len(head)) - np.repeat(first, np.diff(np.append(first, len(head))))
    kept = place < width
    incoming = np.full((len(targets), min(width, int(place.max(initial=0)) + 1)), none, dtype=np.int64)
    incoming[np.searchsorted(targets, head[kept]), place[kept]] = tail[kept]
    every = np.sort(np.column_stack([table[targets], incoming]), axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = none
    close = (whole[every] @ whole[targets][:, :, None])[:, :, 0]
    every, close = _ranked(every, np.where(every < none, close, -np.inf), every.shape[1])
    crowded = close[:, width:width + 1].max(axis=1, initial=-np.inf) > -np.inf
    table[targets] = every[:, :width]
    if crowded.any():
        table[targets[crowded]] = _select(every[crowded], close[crowded], whole, width)


# Spark jobs


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (array of double), rows that take part only."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)


def _matrix(column) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def build_index(rows: DataFrame, keep: int, shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, DataFrame]:
    """Rows d, shard, body (graph, the vectors in doubles where singles don't hold them, the ``keep`` smallest vec_ids of
    each node), and rows d, shards: a row for each length that occurs, so W components give at most sqrt(2 W) of them."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = rows.distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= keep)
    nodes = written(nodes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-nodes")
    lengths = written(nodes.groupBy(F.size("embedding").alias("d")).agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_vectors)).cast("int").alias("shards")), "vector-lengths")
    tasks = _tasks(lengths)

    def build(group: pa.Table) -> pa.Table:
        vectors = _matrix(group.column("embedding"))
        singles = vectors.astype("<f4")
        exact = b"" if np.array_equal(singles, vectors) else vectors.astype("<f8").tobytes()
        ids = group.column("ids").combine_chunks()
        body = join_parts(Graph.build(singles).dump(), exact, ids.flatten().to_numpy().astype("<i8").tobytes(), np.append(0, np.cumsum(ids.value_lengths().to_numpy())).astype("<i8").tobytes())
        return pa.table({"d": group.column("d").slice(0, 1), "shard": group.column("shard").slice(0, 1), "body": pa.array([body], pa.binary())})

    dealt = nodes.withColumn("d", F.size("embedding")).join(F.broadcast(lengths), "d")
    dealt = dealt.select("d", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int").alias("shard"), "embedding", "ids")
    return written(dealt.repartition(tasks, "d", "shard").groupBy("d", "shard").applyInArrow(build, "d int, shard int, body binary"), "vector-index"), lengths


def _tasks(lengths: DataFrame) -> int:
    """Partitions for work by shard: four a shard, so that few share one."""
    return max(1, min(4 * (lengths.agg(F.sum("shards")).first()[0] or 0), 100_000))


def nearest(vectors: DataFrame, one_in: int = 20, k: int = 20, shard_vectors: int = SHARD_VECTORS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by ``one_in``."""
    rows = usable(vectors)
    index, lengths = build_index(rows, k + 1, shard_vectors)
    tasks = _tasks(lengths)
    queries = written(rows.filter(F.col("vec_id") % one_in == 0).distinct().withColumn("d", F.size("embedding")), "vector-queries")
    blocks = queries.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).alias("blocks")).join(lengths, "d")

    def block(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy().astype("<i8").tobytes()
        return pa.table({"d": group.column("d").slice(0, 1), "shards": group.column("shards").slice(0, 1), "query_ids": pa.array([ids], pa.binary()), "query_vectors": pa.array([_matrix(group.column("embedding")).astype("<f8").tobytes()], pa.binary())})

    packed = queries.join(F.broadcast(blocks), "d").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    packed = packed.groupBy("d", "block").applyInArrow(block, "d int, shards int, query_ids binary, query_vectors binary")
    # Every block goes to every shard of its length once, by the shard's number.
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).repartition(tasks, "d", "shard")

    def search(batches):
        last, graph = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["d"], row["shard"]) != last:
                    last = row["d"], row["shard"]
                    flat, exact, ids, offsets = split_parts(row["body"])
                    graph = Graph.load(flat)
                    exact = np.frombuffer(exact, "<f8").reshape(graph.vectors.shape) if exact else graph.vectors.astype(np.float64)
                    ids, offsets = np.frombuffer(ids, "<i8"), np.frombuffer(offsets, "<i8")
                query_ids = np.frombuffer(row["query_ids"], "<i8")
                query_vectors = np.frombuffer(row["query_vectors"], "<f8").reshape(len(query_ids), -1)
                for a in range(0, len(query_ids), 256):
                    yield _answers(graph, exact, ids, offsets, query_ids[a : a + 256], query_vectors[a : a + 256], k, beam)

    schema = "query_id long, query_hash long, vec_id long, score double"
    found = sent.join(index.repartition(tasks, "d", "shard"), ["d", "shard"]).select("d", "shard", "body", "query_ids", "query_vectors").mapInArrow(search, schema)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(graph, exact, ids, offsets, query_ids, query_vectors, k, beam) -> pa.RecordBatch:
    nodes, _ = graph.search(query_vectors, max(beam, k + 1))
    out: list[tuple[np.ndarray, ...]] = []
    for query_id, q, found in zip(query_ids, query_vectors, nodes):
        found = found[found >= 0]
        scores = (exact[found] * q).sum(axis=1)
        order = np.lexsort((found, -scores))[: 2 * k + 2]
        found, scores = found[order], scores[order]
        spans = [ids[offsets[f] : offsets[f + 1]] for f in found]
        members = np.concatenate([*spans, np.zeros(0, np.int64)])
        each = np.repeat(scores, [len(s) for s in spans])
        other = members != query_id
        members, each = members[other], each[other]
        best = np.lexsort((members, -each))[:k]
        name = xxhash.xxh64_intdigest(q.tobytes()) >> 1
        out.append((np.full(len(best), query_id), np.full(len(best), name, np.int64), members[best], each[best]))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_hash", "vec_id", "score"])
