"""Exact top-k inner-product search by ball-tree branch and bound.

Candidates are searched shard by shard (at most `shard_rows` vectors each); a shard's vectors are arranged in a
ball tree. For a block of queries, nodes are visited in the order of the largest upper bound q.c + |q| r, and a node
is left out for the queries whose kth score so far is above it. The kth score is shared twice: the shards of a task hand it
on, and candidates come in levels (a 64th of them, then an 8th, then the rest, by a hash of the id), each of which starts from
the kth scores that the levels before it merged to. A task gives only scores that reach what it started from,
so what meets in the merge is a few times k for each query, however many tasks there are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1

#: Scores are summed in doubles while they are surely exact (below 2**53), else in whole numbers.
SAFE = float(2**53)


class Ball:
    """A node: centre, radius, and either children or a range of rows."""

    __slots__ = ("centre", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        own = points[rows]
        self.centre = own.mean(axis=0)
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max()))
        self.rows, self.children = rows, None
        if len(rows) > leaf and self.radius > 0:
            far = own[int(((own - self.centre) ** 2).sum(axis=1).argmax())]
            other = own[int(((own - far) ** 2).sum(axis=1).argmax())]
            along = own @ (other - far)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2  # halves, so equal points cannot leave a side empty
            self.children = (Ball(points, rows[order[:half]], leaf), Ball(points, rows[order[half:]], leaf))
            self.rows = None

    def bound(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        dots = queries @ self.centre
        slack = 1e-9 * (1.0 + np.abs(dots) + norms * (self.radius + np.linalg.norm(self.centre)))
        return dots + norms * self.radius + slack


class Best:
    """The k best (score, id) of each query so far: larger scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int, start: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((n, k), LONG_MIN, dtype=np.int64)
        self.ids = np.full((n, k), LONG_MAX, dtype=np.int64)
        self.seen = np.zeros((n, k), dtype=bool)
        self.floor = np.full(n, -np.inf) if start is None else start.astype(float).copy()

    def kth(self) -> np.ndarray:
        """A score that the kth best reaches at least."""
        full = self.seen[:, -1]
        return np.maximum(self.floor, np.where(full, self.scores[:, -1].astype(float), -np.inf))

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, usable: np.ndarray) -> None:
        """Take (queries x candidates) scores; usable marks those that may count."""
        k = self.k
        if scores.shape[1] > 4 * k:  # no more than k of them can count, but all ties with the kth must stay
            low = np.where(usable, scores, LONG_MIN)
            cut = np.partition(low, -k, axis=1)[:, -k]
            limit = np.maximum(cut, np.where(self.seen[which, -1], self.scores[which, -1], LONG_MIN))
            usable = usable & (scores >= limit[:, None])
        for row, q in enumerate(which):
            take = np.flatnonzero(usable[row])
            if not len(take):
                continue
            s = np.concatenate([self.scores[q][self.seen[q]], scores[row, take]])
            i = np.concatenate([self.ids[q][self.seen[q]], ids[take]])
            order = np.lexsort((i, -s.astype(object) if s.min() == LONG_MIN else -s))[:k]
            n = len(order)
            self.scores[q, :n], self.ids[q, :n], self.seen[q, :n] = s[order], i[order], True


def dots(queries: np.ndarray, points: np.ndarray, safe: bool) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits stay at the end of the range."""
    if safe:
        return (queries @ points.T).astype(np.int64)
    exact = queries.astype(object) @ points.T.astype(object)
    return np.vectorize(lambda v: min(max(int(v), LONG_MIN), LONG_MAX), otypes=[np.int64])(exact)


def search(shard: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best, leaf: int = 256, block: int = 128) -> int:
    """Offer a shard's candidates to all queries, block by block; returns how many scores were worked out."""
    root, worked = Ball(shard, np.arange(len(shard)), leaf), 0
    reach = float(np.abs(shard).max(initial=0))
    for at in range(0, len(queries), block):
        which = np.arange(at, min(at + block, len(queries)))
        own = queries[which]
        norms = np.linalg.norm(own, axis=1)
        safe = float(np.abs(own).max(initial=0)) * reach * max(1, own.shape[1]) < SAFE
        first = root.bound(own, norms)
        heap, tick = [(-first.max(), 0, root, first)], 0
        while heap:
            _, _, node, bound = heapq.heappop(heap)
            live = np.flatnonzero(bound >= best.kth()[which])
            if not len(live):
                continue
            if node.children is None:
                scores = dots(own[live], shard[node.rows], safe)
                worked += scores.size
                best.offer(which[live], scores, ids[node.rows], query_ids[which[live]][:, None] != ids[node.rows][None, :])
            else:
                for child in node.children:
                    tick += 1
                    b = child.bound(own, norms)
                    heapq.heappush(heap, (-b[live].max(), tick, child, b))
    return worked


def as_integers(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) with v the floors of scale times the components as doubles. Vectors that are null, empty or
    hold null or non-finite components are left out, as are rows without an id."""
    e = F.col(embedding)
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.filter(usable & F.col(vec_id).isNotNull())
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")))


#: Levels of candidates: up to which share of them, in parts of PARTS, each one goes.
LEVELS, PARTS = (1, 8, 64), 64


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding",
          shard_rows: int = 16384, query_rows: int = 20_000, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`.

    Rows that share an id are candidates each on their own but never of each other; a query id that comes on
    several rows is asked once, with the row whose vector is smallest. Equal scores go by the smaller id. Only vectors of one width meet; null
    ids and vectors that are null, empty or not finite take no part; an empty table gives no rows; other columns are not read. Queries go
    in chunks of at most about `query_rows`, the bound of what is broadcast with their kth scores; each
    chunk is one pass over all candidates, dealt to its levels, so the work is that of the query set against all rows.
    """
    usable = as_integers(vectors, scale, vec_id, embedding)
    asked = stage(usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    chunks = max(1, -(-asked.count() // query_rows))
    answers = None
    for chunk in range(chunks):
        part = asked if chunks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk)
        queries, floors, found = _by_width(part.toArrow()), {}, None
        for low, high in zip((0, *levels[:-1]), levels):
            place = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(PARTS))
            candidates = usable.filter(place.between(low, high - 1))
            if low == 0 and high < PARTS:  # a small share, gathered in as small a share of tasks
                candidates = candidates.repartition(max(1, candidates.rdd.getNumPartitions() * high // PARTS))
            best = _pass(candidates, queries, floors, k, shard_rows)
            if high == levels[-1]:
                found = best if found is None else found.union(best)
            else:
                held = stage(best if found is None else found.union(best), "best")
                found = _ranked(held, k).select("query_id", "vec_id", "score")
                floors = {r.query_id: r.score for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect()}  # query_rows at most
        found = stage(_ranked(found, k), "answers")
        answers = found if answers is None else answers.union(found)
    return answers.select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _by_width(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width -> (ids, matrix) of the rows of a (vec_id, v) table."""
    ids, vectors = table.column(0).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(0).to_numpy(), table.column(1)
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], type=vectors.type)
    lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    found = {}
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        take = (ends[rows] - width)[:, None] + np.arange(width)[None, :]
        found[int(width)] = (ids[rows], flat[take])
    return found


def _pass(candidates: DataFrame, queries: dict, floors: dict, k: int, shard_rows: int) -> DataFrame:
    """(query_id, vec_id, score): the best that each task has, as far as they reach the floors (a kth score, where one is known)."""
    starts = {width: np.array([floors.get(q, -np.inf) for q in ids.tolist()], dtype=float) for width, (ids, _) in queries.items()}
    shared = candidates.sparkSession.sparkContext.broadcast((queries, starts))

    def run(batches):
        queries, starts = shared.value
        bests = {w: Best(len(ids), k, starts[w]) for w, (ids, _) in queries.items()}
        held: dict[int, list] = {}

        def flush(width: int) -> None:
            parts = held.pop(width)
            search(np.concatenate([m for _, m in parts]), np.concatenate([i for i, _ in parts]), queries[width][1], queries[width][0], bests[width])

        for batch in batches:
            for width, (ids, matrix) in _by_width(batch).items():
                if width not in queries:
                    continue
                held.setdefault(width, []).append((ids, matrix))
                if sum(len(i) for i, _ in held[width]) >= shard_rows:
                    flush(width)
        for width in list(held):
            flush(width)
        for width, best in bests.items():
            q, at = np.nonzero(best.seen & (best.scores >= starts[width][:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries[width][0][q], pa.int64()), pa.array(best.ids[q, at], pa.int64()), pa.array(best.scores[q, at], pa.int64())],
                names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")
