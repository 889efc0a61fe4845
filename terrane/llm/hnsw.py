"""Approximate nearest neighbours: a navigable small-world graph for every shard, in flat arrays.

Each shard of the vectors gets a hierarchy of neighbour arrays, one row of
row numbers a node, -1 where free.  Points enter in rounds that double the
graph; a beam search over the graph so far finds their neighbours, a rule
that prefers spread-out neighbours chooses among them, and links run both
ways.  Queries go to every shard in blocks, and the shards' answers are
merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import as_doubles, classes, valid

#: Vectors of a shard on average, neighbours of a node (twice as many on the lowest level), beams.
SHARD_ROWS = 4096
NEIGHBOURS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 96
#: Queries that one task takes to one shard.
QUERY_BLOCK = 2048


class Graph:
    """Points of one shard (float64), and neighbour arrays from the lowest level up."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray], entry: int):
        self.points, self.levels, self.entry = points, levels, entry
        self.squares = (points * points).sum(1)

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 1) -> Graph:
        n = len(points)
        rng = np.random.default_rng(seed)
        heights = np.minimum((-np.log(rng.random(n)) / math.log(NEIGHBOURS)).astype(int), 6)
        # High points first: every level is connected from its first point on.
        order = np.argsort(-heights, kind="stable")
        points, heights = points[order], heights[order]
        levels = [np.full((n, (2 if k == 0 else 1) * NEIGHBOURS), -1, np.int32) for k in range(heights.max(initial=0) + 1)]
        out = cls(points, levels, 0)
        out.order = order
        at = min(n, BUILD_BEAM)
        for k in range(len(levels)):
            inside = np.flatnonzero(heights[:at] >= k)
            out._link(k, inside, np.tile(inside, (len(inside), 1)))
        while at < n:
            end = min(n, 2 * at)
            new = np.arange(at, end)
            for block in np.array_split(new, max(1, len(new) // 512)):
                near = out.search(points[block], BUILD_BEAM, known=at, levels_of=heights[block])
                for k in range(len(levels)):
                    rows = heights[block] >= k
                    if rows.any():
                        out._link(k, block[rows], near[k][rows])
            at = end
        return out

    def _distances(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own list of rows; infinite for -1."""
        far = self.squares[rows] - 2 * np.einsum("qd,qkd->qk", queries, self.points[rows])
        return np.where(rows < 0, np.inf, far)

    def _choose(self, rows: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """For each row up to ``most`` of its candidates: near ones that are not nearer to one chosen before."""
        cand = np.where(candidates == rows[:, None], -1, candidates)
        far = self._distances(self.points[rows], cand) + self.squares[rows][:, None]
        order = np.argsort(far, axis=1, kind="stable")
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        width = cand.shape[1]
        vectors, squares = self.points[cand], self.squares[cand]
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        chosen = np.zeros(cand.shape, bool)
        covered = cand < 0
        for j in range(width):
            take = ~covered[:, j] & (chosen.sum(1) < most)
            chosen[:, j] = take
            # Later candidates nearer to this one than to the row itself are left to it.
            covered |= take[:, None] & (between[:, j, :] < far) & (np.arange(width) > j)
        # Free places go to the nearest of those passed over.
        rest = ~chosen & (cand >= 0)
        spare = most - chosen.sum(1)
        chosen |= rest & (rest.cumsum(1) <= spare[:, None])
        key = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(chosen, key, 1), np.take_along_axis(cand, key, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def _link(self, level: int, rows: np.ndarray, candidates: np.ndarray) -> None:
        """Set the neighbours of ``rows``, and add the rows to their neighbours' arrays."""
        if len(rows) == 0:
            return
        table, most = self.levels[level], self.levels[level].shape[1]
        for part in np.array_split(np.arange(len(rows)), max(1, len(rows) // 256)):
            table[rows[part], :NEIGHBOURS] = self._choose(rows[part], candidates[part], NEIGHBOURS)
        ends = table[rows]
        source = np.repeat(rows, ends.shape[1])[ends.ravel() >= 0]
        target = ends.ravel()[ends.ravel() >= 0]
        if len(target) == 0:
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, starts = np.unique(target, return_index=True)
        gains = np.split(source, starts[1:])
        most_new = max(map(len, gains), default=0)
        added = np.full((len(touched), most_new), -1, np.int32)
        for i, g in enumerate(gains):
            added[i, : len(g)] = g
        for part in np.array_split(np.arange(len(touched)), max(1, len(touched) // 256)):
            mine = touched[part]
            both = np.concatenate([table[mine], added[part]], axis=1)
            # A neighbour listed twice would take two places.
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            table[mine] = self._choose(mine, both, most)

    def search(self, queries: np.ndarray, beam: int, known: int | None = None, levels_of: np.ndarray | None = None):
        """The ``beam`` nearest points found for each query; with ``levels_of``, candidates on every level."""
        n = len(self.points) if known is None else known
        start = np.full((len(queries), 1), self.entry, np.int64)
        found: dict[int, np.ndarray] = {}
        for k in range(len(self.levels) - 1, -1, -1):
            wide = beam if k == 0 or levels_of is not None else 1
            start = self._beam(queries, start, self.levels[k], wide, n)
            found[k] = start
        return found if levels_of is not None else start

    def _beam(self, queries: np.ndarray, start: np.ndarray, table: np.ndarray, beam: int, known: int) -> np.ndarray:
        """Best-first search of all queries in step, each with its own list of ``beam`` points."""
        q = len(queries)
        seen = np.zeros((q, known + 1), bool)
        ids = np.full((q, beam), -1, np.int64)
        take = min(beam, start.shape[1])
        far = np.full((q, beam), np.inf)
        first = self._distances(queries, start)
        order = np.argsort(first, axis=1, kind="stable")[:, :take]
        ids[:, :take], far[:, :take] = np.take_along_axis(start, order, 1), np.take_along_axis(first, order, 1)
        far[ids < 0] = np.inf
        rows = np.arange(q)[:, None]
        seen[rows, ids] = True
        done = ids < 0
        live = np.arange(q)
        while len(live):
            open_far = np.where(done[live], np.inf, far[live])
            at = open_far.argmin(1)
            going = np.isfinite(open_far[np.arange(len(live)), at])
            live, at = live[going], at[going]
            if len(live) == 0:
                break
            done[live, at] = True
            next_ = table[ids[live, at]].astype(np.int64)
            next_[next_ >= known] = -1
            fresh = ~seen[live[:, None], next_] & (next_ >= 0)
            next_ = np.where(fresh, next_, -1)
            seen[live[:, None], next_] = True
            gap = self._distances(queries[live], next_)
            all_ids, all_far = np.concatenate([ids[live], next_], 1), np.concatenate([far[live], gap], 1)
            all_done = np.concatenate([done[live], next_ < 0], 1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            ids[live], far[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_far, all_done))
            done[live] |= ~np.isfinite(far[live])
        order = np.argsort(far, axis=1, kind="stable")
        return np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(ids, order, 1), -1)


def build_index(rows: DataFrame, dims: int, keep: int) -> DataFrame:
    """(shard, n, points, members, levels, widths): one row a shard, its graph as flat arrays.

    ``members`` has the ``keep`` smallest ids of each class of equal vectors,
    so that copies cost one node.
    """
    made = staged(classes(rows, keep).filter(F.size("v") == dims), "ann_classes")
    shards = max(1, math.ceil(made.count() / SHARD_ROWS))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep").reset_index(drop=True)
        points = np.stack(part["v"].to_numpy()).astype(float)
        # Distances do not change when the shard is centred and scaled; sums stay finite.
        graph = Graph.build(points / max(np.abs(points).max(), 1e-300), key[0] + 1)
        points = points[graph.order]
        members = np.full((len(part), keep), -1, np.int64)
        filled = np.zeros((len(part), keep), bool)
        for i, ids in enumerate(part["least"].to_numpy()[graph.order]):
            members[i, : len(ids)], filled[i, : len(ids)] = ids, True
        return pd.DataFrame({
            "shard": [key[0]], "n": [len(part)], "points": [points.tobytes()], "members": [members.tobytes()], "filled": [filled.tobytes()],
            "levels": [[x.tobytes() for x in graph.levels]],
        })

    dealt = made.select("rep", "v", "least", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
    return staged(dealt.groupBy("shard").applyInPandas(build, "shard int, n int, points binary, members binary, filled binary, levels array<binary>"), "ann_index")


def search_index(index: DataFrame, queries: DataFrame, dims: int, keep: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest ids found for each query (query_id, v), its own id left out."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    asked = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    # Every block of queries visits every shard; the graph of a shard goes along once a block.
    visits = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    graphs = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def look(key: tuple, graph: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if len(graph) == 0 or len(part) == 0:
            return none
        row = graph.iloc[0]
        points = np.frombuffer(row["points"], float).reshape(-1, dims)
        scale = max(np.abs(points).max(), 1e-300)
        levels = [np.frombuffer(x, np.int32).reshape(len(points), -1) for x in row["levels"]]
        members, filled = np.frombuffer(row["members"], np.int64).reshape(-1, keep), np.frombuffer(row["filled"], bool).reshape(-1, keep)
        g = Graph(points / scale, levels, 0)
        out = []
        for at in range(0, len(part), 256):
            some = part.iloc[at : at + 256]
            vectors = np.stack(some["v"].to_numpy()).astype(float)
            found = g.search(vectors / scale, max(SEARCH_BEAM, 2 * k))
            for query, v, rows in zip(some["query_id"].tolist(), vectors, found):
                rows = rows[rows >= 0]
                # Twice as many nodes as asked for, then exactly on the original vectors.
                gap = points[rows] - v
                exact = np.sqrt((gap * gap).sum(1))
                ids, far = members[rows].ravel(), np.repeat(exact, keep)
                ok = filled[rows].ravel() & (ids != query)
                ids, far = ids[ok], far[ok]
                best = np.lexsort((ids, far))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": far[best]}))
        return pd.concat(out) if out else none

    near = graphs.groupBy("shard", "block").cogroup(visits.groupBy("shard", "block")).applyInPandas(look, "query_id long, vec_id long, score double")
    # k answers from each shard; equal ids of a repeated row count once.
    merged = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def nearest(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``, among all other rows.

    Null, zero or non-finite vectors and null ids take no part; vectors of
    different lengths never meet; rows that repeat an id and a vector count
    once.  Ties go to the smaller id, and an empty table gives no rows.
    """
    good = as_doubles(rows).filter(valid() & F.col("vec_id").isNotNull())
    out = None
    for dims in sorted(r[0] for r in good.select(F.size("v")).distinct().collect()):
        queries = good.filter(F.size("v") == dims).filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
        found = search_index(build_index(rows, dims, k + 1), queries, dims, k + 1, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return out
