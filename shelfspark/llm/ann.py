"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt at random to shards, every vector is indexed. A shard has ``SHARD`` vectors at least and grows with
the table (``shard_size``): a search costs little more in a larger graph, so up to the largest
shards the queries meet ``SHARDS`` graphs at any size, and the work grows with the vectors, not with their square.
In a shard the graph is built in batches of doubling size: each new vector is searched
for greedily from the entry point, the vectors visited are proposed as its neighbours, and relaxed pruning
keeps a proposal unless a kept neighbour is nearer to it by the factor ``ALPHA``;
reverse edges are added and pruned in the same way. A query is answered by a
beam search in each shard; the shards' best are merged. Searches of a batch go in
step, so each step is a few numpy operations.

Equal vectors are one node. A node carries its smallest ids, one more than a query
can return, taken by a group-limited window, so a vector that many rows share costs
one node and a few rows per task. Queries meet the shards in blocks of ``QUERY_BLOCK``.
Distances are Euclidean in double precision on the original components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do null ids; ties go to the smaller id; rows repeated with the same id and
vector count once; vectors of different lengths are never compared; with fewer candidates than
asked for all found are returned; an empty table gives no rows; only ``vec_id``
and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.common import written

NEAREST = 10
DEGREE = 48
SLACK = 16  # edges beyond that a list may gather between two prunings
BEAM_BUILD = 64
BEAM_QUERY = 256
ALPHA = 1.2
SHARD = 4096
SHARDS = 32
SHARD_NUMBERS = 1 << 22  # components of a shard's vectors at most: bounds a task's memory
QUERY_BLOCK = 8192
BATCH = 256  # searches in step
OPENED = 4  # nodes that a search opens in a step


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x [.., n, d] to q [.., d]."""
    diff = x - q[..., None, :]
    return np.einsum("...d,...d->...", diff, diff)


class Graph:
    """A shard's vectors and their out-neighbours (-1 where a list is shorter)."""

    def __init__(self, x: np.ndarray, neighbours: np.ndarray | None = None):
        self.x = x
        self.entry = int(np.argmin(_distances(x, x.mean(axis=0)))) if len(x) else 0
        if neighbours is None:
            self.neighbours = np.full((len(x), DEGREE + SLACK), -1, dtype=np.int32)
            self._build()
        else:
            self.neighbours = neighbours

    def _build(self) -> None:
        order = np.random.default_rng(7).permutation(len(self.x))
        order = np.concatenate(([self.entry], order[order != self.entry]))
        at = 1
        while at < len(order):
            new = order[at:min(2 * at, at + BATCH, len(order))]
            _, _, visited = self.search(self.x[new], BEAM_BUILD, keep_visited=True)
            pool = np.where(visited == new[:, None], -1, visited)
            self.neighbours[new, :DEGREE] = self._prune(new, pool)
            self._reverse(new)
            at += len(new)
        long = np.flatnonzero(self.neighbours[:, DEGREE] >= 0)
        for low in range(0, len(long), BATCH):
            some = long[low:low + BATCH]
            self.neighbours[some, :DEGREE] = self._prune(some, self.neighbours[some])
        self.neighbours = np.ascontiguousarray(self.neighbours[:, :DEGREE])

    def _reverse(self, new: np.ndarray) -> None:
        """Edges back from the new nodes' neighbours; a list is pruned to ``DEGREE`` once it has no room for more than that and
        ``SLACK`` others, so a full list costs a pruning for many newcomers, not for each."""
        to = self.neighbours[new]
        target, source = to[to >= 0], np.repeat(new, (to >= 0).sum(axis=1))
        order = np.lexsort((_pair(self.x, source, target), target))
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (self.neighbours[nodes] >= 0).sum(axis=1)
        fits = held + count <= self.neighbours.shape[1]
        one = np.repeat(fits, count)
        place = np.arange(len(target)) - np.repeat(first - held, count)
        self.neighbours[target[one], place[one]] = source[one]
        nodes, first, count = nodes[~fits], first[~fits], count[~fits]
        for low in range(0, len(nodes), BATCH):
            some, start, size = nodes[low:low + BATCH], first[low:low + BATCH], count[low:low + BATCH]
            width = min(int(size.max()), 2 * DEGREE)  # the nearest newcomers
            slot = np.arange(width)
            fresh = np.where(slot < size[:, None], source[np.minimum(start[:, None] + slot, len(source) - 1)], -1)
            self.neighbours[some, :DEGREE] = self._prune(some, np.concatenate((self.neighbours[some], fresh), axis=1))
            self.neighbours[some, DEGREE:] = -1

    def _prune(self, nodes: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Robust pruning of each node's pool (rows of ids, -1 for none)."""
        far = np.where(pool < 0, np.inf, _distances(self.x[pool], self.x[nodes]))
        order = np.argsort(far, axis=1, kind="stable")
        pool, far = np.take_along_axis(pool, order, 1), np.take_along_axis(far, order, 1)
        v = self.x[pool]
        norm = np.einsum("bcd,bcd->bc", v, v)
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(far)
        out = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
        rows = np.arange(len(nodes))
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)  # the nearest one left
            out[some, k] = pool[rows, pick][some]
            near = ALPHA * ALPHA * between[rows, pick] <= far
            near[rows, pick] = True
            near |= pool == pool[rows, pick][:, None]
            alive &= ~(near & some[:, None])
        return out

    def search(self, q: np.ndarray, beam: int, keep_visited: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids, squared distances, visited) of a beam search for each row of q; -1 pads ids.

        A step opens the ``OPENED`` nearest nodes of each beam that are still closed. A node is measured once a query: the
        nodes met are marked, and only those that are new and nearer than the beam's farthest go into it. The beam has no order until the end."""
        n = len(q)
        ids = np.full((n, beam), -1, dtype=np.int64)
        far = np.full((n, beam), np.inf)
        closed = np.full((n, beam), np.inf)  # the distance of a node still to be opened
        met = np.zeros((n, len(self.x)), dtype=bool)
        ids[:, 0], met[:, self.entry] = self.entry, True
        far[:, 0] = closed[:, 0] = _distances(self.x[np.full((n, 1), self.entry)], q)[:, 0]
        steps: list[np.ndarray] = []
        active, opened = np.arange(n), min(OPENED, beam)
        while len(active):
            waiting = closed[active]
            pick = np.argpartition(waiting, opened - 1, axis=1)[:, :opened]
            open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
            node = np.where(open_, ids[active[:, None], pick], -1)
            closed[active[:, None], pick] = np.inf
            if keep_visited:
                seen = np.full((n, opened), -1, dtype=np.int64)
                seen[active] = node
                steps.append(seen)
            row, k = np.nonzero(open_)
            near = self.neighbours[node[row, k]].astype(np.int64)
            row = np.repeat(row, near.shape[1])
            near = near.ravel()
            new = (near >= 0) & ~met[active[row], near]
            pair = np.sort(row[new] * len(self.x) + near[new])
            pair = pair[np.flatnonzero(np.diff(pair, prepend=-1))]  # by query; opened nodes may share a neighbour
            row, near = pair // len(self.x), pair % len(self.x)
            met[active[row], near] = True
            diff = self.x[near] - q[active[row]]
            d = np.einsum("nd,nd->n", diff, diff)
            nearer = d < far[active].max(axis=1)[row]
            row, near, d = row[nearer], near[nearer], d[nearer]
            if len(row):
                some, first, count = np.unique(row, return_index=True, return_counts=True)
                slot = np.arange(len(row)) - np.repeat(first, count)
                place, width = np.repeat(np.arange(len(some)), count), int(count.max())
                more_ids, more = np.full((len(some), width), -1, dtype=np.int64), np.full((len(some), width), np.inf)
                more_ids[place, slot], more[place, slot] = near, d
                at = active[some]
                all_far = np.concatenate((far[at], more), axis=1)
                best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
                far[at] = np.take_along_axis(all_far, best, 1)
                ids[at] = np.take_along_axis(np.concatenate((ids[at], more_ids), axis=1), best, 1)
                closed[at] = np.take_along_axis(np.concatenate((closed[at], more), axis=1), best, 1)
            active = active[np.isfinite(closed[active]).any(axis=1)]
        order = np.argsort(far, axis=1, kind="stable")
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        return ids, far, np.concatenate(steps, axis=1) if keep_visited else None


def _pair(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = x[a] - x[b]
    return np.einsum("nd,nd->n", diff, diff)


# ------------------------------------------------------------ the Spark job

def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def nodes_of(rows: DataFrame, nearest: int) -> DataFrame:
    """(vec, ids): distinct vectors of ``rows`` (vec_id, vec) with their smallest ids."""
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= nearest + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def shard_size(vectors: int, dim: int) -> int:
    """Vectors of a shard: the table's part in ``SHARDS``, but not fewer than ``SHARD``, nor more than fit a task."""
    return max(SHARD, min(-(-vectors // SHARDS), SHARD_NUMBERS // max(dim, 1)))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("uid", kind="stable")
    graph = Graph(np.stack(rows["vec"].to_numpy()).astype(np.float64))
    return rows.assign(node=np.arange(len(rows), dtype=np.int32), neighbours=list(graph.neighbours))[
        ["dim", "shard", "node", "vec", "ids", "neighbours"]]


def _answer(nearest: int):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            rows = rows.sort_values("node")
            graph = Graph(np.stack(rows["vec"].to_numpy()), np.stack(rows["neighbours"].to_numpy()))
            members, ids = rows["ids"].tolist(), queries["query_id"].tolist()
            q = np.stack(queries["vec"].to_numpy())
            for low in range(0, len(q), BATCH):
                found, far, _ = graph.search(q[low:low + BATCH], max(BEAM_QUERY, 2 * nearest))
                for query, near, d in zip(ids[low:low + BATCH], found.tolist(), np.sqrt(far).tolist()):
                    pairs = sorted((dist, int(m)) for n, dist in zip(near, d) if n >= 0 for m in members[n] if m != query)
                    out += [(query, m, dist) for dist, m in pairs[:nearest]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found among ``vectors`` (vec_id, embedding) for
    each row of ``queries`` (vec_id, embedding), without the row of the query's own id."""

    def clean(rows: DataFrame) -> DataFrame:
        kept = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        return kept.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))

    nodes = written(nodes_of(clean(vectors), nearest).withColumns(
        {"dim": F.size("vec"), "uid": F.col("ids")[0]}), "ann-nodes")
    total, dim = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    shards = -(-total // shard_size(total, dim or 0)) or 1
    shard = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    # By ranges of the shard's number, as hashes of few numbers meet in some partitions and leave others empty.
    dealt = nodes.withColumn("shard", shard).repartitionByRange(shards, "shard")
    graphs = written(dealt.groupBy("dim", "shard").applyInPandas(
        _build, "dim int, shard int, node int, vec array<double>, ids array<long>, neighbours array<int>"), "ann-graphs")
    asked = written(clean(queries).distinct().withColumnRenamed("vec_id", "query_id").withColumn("dim", F.size("vec")), "ann-queries")
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    # The stated queries against all shards, block by block: a task holds one shard and one block.
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _answer(nearest), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
