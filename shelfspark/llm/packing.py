"""Packing token sequences into fixed windows by non-negative least squares.

1. Each document's ids are cut into full windows and one remainder shorter than
   a window; a table of them is written with each remainder's rank among the
   remainders of its length in its partition.
2. The histogram of remainder lengths has at most ``window`` bins, whatever the
   input. Shallow combinations (one to three lengths) that fill a window
   exactly are enumerated; projected gradients solve for the non-negative
   repeat counts whose mixture comes closest to the histogram; the counts are rounded
   down and limited to what the histogram still has.
3. The residuals are packed greedily: first into combinations that still fit,
   then end to end, cut at window borders. Only the last window may be short; it is cut
   into sequences whose lengths are powers of two, which need no padding.
4. A remainder's place follows from its length and global rank alone: the
   partition's offset in its bin (a join with one row per partition and length)
   plus its rank, looked up in the plan's intervals. The plan, whose size depends on the
   window only, travels with the tasks.

Defined results: null or empty texts have just the end id; repeated rows are
packed one by one; an empty table gives no rows; very long texts become many full
windows; only ``doc_id`` and ``text`` are read of the input's columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import tokenizing
from shelfspark.llm.common import id_text, text_of, with_long_id, written

WINDOW = 2048
END_ID = 1
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


# ---------------------------------------------------------------- the plan

def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, a + b + c = window; 0 pads pairs.

    All pairs, and the triples whose least part is a multiple of window / 32.
    """
    half = np.arange(1, window // 2 + 1)
    found = [np.stack([np.zeros_like(half), half, window - half], axis=1)]
    step = max(1, window // 32)
    for a in range(step, window // 3 + 1, step):
        b = np.arange(a, (window - a) // 2 + 1)
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def solve_counts(combos: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 minimising |A x - hist|^2, A[l, k] = how often combination k uses length l."""
    real = hist.astype(float).copy()
    real[0] = 0
    weight = (combos > 0).astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(real))
        for j in range(3):
            out += np.bincount(combos[:, j], weights=x * weight[:, j], minlength=len(real))
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        return (r[combos] * weight).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue of A'A bounds the step
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1.0 / (1.02 * np.linalg.norm(backward(forward(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * backward(forward(y) - real))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Where the k-th remainder of each length goes (bounded by the window)."""

    def __init__(self, hist: np.ndarray, n_full: int, window: int):
        self.window = window
        combos = combinations(window)
        x = solve_counts(combos, hist)
        left = hist.astype(np.int64).copy()
        left[0] = 0
        counts = np.zeros(len(combos), dtype=np.int64)
        order = np.argsort(-x, kind="stable")
        for rounded in (True, False):  # the solved counts, then whatever still fits
            for k in order.tolist():
                parts = [int(p) for p in combos[k] if p]
                room = min(int(left[p]) // parts.count(p) for p in parts)
                n = min(int(x[k]), room) if rounded else room
                if n > 0:
                    counts[k] += n
                    for p in parts:
                        left[p] -= n
        intervals: dict[int, list[tuple[int, int, int]]] = {}
        used = np.zeros(len(hist), dtype=np.int64)
        sequence = n_full
        for k in np.flatnonzero(counts).tolist():
            at = 0
            for p in (int(p) for p in combos[k][::-1] if p):
                intervals.setdefault(p, []).append((int(used[p]), sequence, at))
                used[p] += counts[k]
                at += p
            sequence += int(counts[k])
        self.used = used
        # length -> (first ranks, sequence of the first, offset in it)
        self.intervals = {p: tuple(np.array(v) for v in zip(*rows)) for p, rows in intervals.items()}
        lengths = np.arange(len(hist))
        residual = np.where(lengths > 0, hist - used, 0) * lengths
        self.base = np.concatenate(([0], np.cumsum(residual)[:-1]))
        total = int(residual.sum())
        self.tail = total // window * window
        powers = [1 << b for b in range(window.bit_length(), -1, -1) if (total - self.tail) >> b & 1]
        self.tail_cuts = self.tail + np.concatenate(([0], np.cumsum(powers))).astype(np.int64)
        self.first_residual = sequence

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece."""
        if rank < self.used[length]:
            firsts, sequences, offsets = self.intervals[length]
            k = int(np.searchsorted(firsts, rank, side="right")) - 1
            return [(0, length, int(sequences[k]) + rank - int(firsts[k]), int(offsets[k]))]
        pos = int(self.base[length]) + (rank - int(self.used[length])) * length
        end, out, first = pos + length, [], pos
        while pos < end:
            if pos < self.tail:
                number, low = divmod(pos, self.window)
                low, high = pos - low, pos - low + self.window
            else:
                k = int(np.searchsorted(self.tail_cuts, pos, side="right")) - 1
                number, low, high = self.tail // self.window + k, int(self.tail_cuts[k]), int(self.tail_cuts[k + 1])
            stop = min(end, high)
            out.append((pos - first, stop - pos, self.first_residual + number, pos - low))
            pos = stop
        return out


# ------------------------------------------------------------ the Spark job

def token_table(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Ids of each document with its remainder's rank in (partition, length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for rows in batches:
            ids = [x + end for x in tokenizing.encode_all(path, rows["text"].tolist())]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            full, rest = n // window, n % window
            before = seen[window] + np.cumsum(full) - full
            seen[window] += full.sum()
            rank = pd.Series(rest).groupby(rest).cumcount().to_numpy() + seen[rest]
            seen[:window] += np.bincount(rest, minlength=window)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "pid": pid, "n": n, "full": full, "rest": rest,
                                "full_before": before, "rest_rank": rank, "ids": ids})

    schema = "doc_id string, pid int, n long, full long, rest int, full_before long, rest_rank long, ids binary"
    return with_long_id(docs.select(id_text(), text_of().alias("text")).mapInPandas(run, schema))


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents of a written ``token_table``, see ``PIECES``."""
    rests = tokens.groupBy("pid", F.col("rest").alias("bin")).agg(F.count("*").alias("n"))
    fulls = tokens.groupBy("pid").agg(F.sum("full").alias("n")).select("pid", F.lit(window).alias("bin"), "n")
    sizes = written(rests.unionByName(fulls), "packing-sizes")  # one row per partition and length at most
    hist = np.zeros(window + 1, dtype=np.int64)
    for row in sizes.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most window + 1 rows
        hist[row["bin"]] = row["n"]
    plan = Plan(hist[:window], int(hist[window]), window)
    earlier = Window.partitionBy("bin").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rest_skip = offsets.where(F.col("bin") < window).select("pid", F.col("bin").alias("rest"), "skip")
    full_skip = offsets.where(F.col("bin") == window).select("pid", F.col("skip").alias("full_skip"))
    # One row per (partition, length) on the right: the ids meet it once, split by AQE where skewed.
    placed = tokens.join(rest_skip.join(full_skip, "pid"), ["pid", "rest"])
    pieces = placed.select(id_text(), "n", "full", "rest", (F.col("full_before") + F.col("full_skip")).alias("first"),
                         (F.col("rest_rank") + F.col("skip")).alias("rank"), "ids").mapInPandas(_cutter(plan), PIECES.replace("doc_id long", "doc_id string"))
    return with_long_id(pieces)


def _cutter(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = plan.window
        for rows in batches:
            out: list[tuple] = []
            for doc, n, full, rest, first, rank, ids in rows.itertuples(index=False, name=None):
                cuts = [(k * w, w, first + k, 0) for k in range(full)]
                if rest:
                    cuts += [(full * w + s, size, seq, at) for s, size, seq, at in plan.place(rest, rank)]
                for start, size, seq, at in cuts:
                    piece = ids[4 * start:4 * (start + size)]
                    out.append((doc, start, size, zlib.crc32(piece), n, seq, at, piece))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                             "sequence_id", "offset", "ids"])

    return run


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text), with their ids."""
    return pack(written(token_table(docs, path, window, end_id), "packing-tokens"), window)
