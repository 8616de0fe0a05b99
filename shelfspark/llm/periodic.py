"""Periodic runs of words: maximal stretches that repeat with a period, and their removal.

A run is a stretch of consecutive words with smallest period q and at least
max(24, 3 q) words that can't be extended keeping the period. For a period p the words at i
and i + p agree on an interval of places; a run is such an interval with the p words after it.

Method, scale by scale. Octave B holds the periods B .. 2B - 1 (the first one 1 .. 7). A long enough
interval has a multiple of the octave's step (2B, at least 16) among or right behind its places. So a document
is cut into overlapping tiles, one around each such boundary, reaching one step to
both sides (and 2B further, for the partners). Each tile is solved alone: two Z-functions from its
boundary, forwards and backwards, give for every period of the octave how far the words agree to the
right and to the left. Fragments shorter than the step are no part of a run. The others are
shuffled by (document, period), where those that touch are joined into whole intervals; of equal stretches
the smallest period is kept.

Plan: the first pass reads each text once and hands on, of most documents, their finished
row; documents with a tile that may hold a run (some period of the octave repeats the
eight words before or after the boundary, as any run there must; compared by rolling hashes for all tiles at once) hand on their
words and these tiles. The tiles, rows of at most some multiples of the octave, are dealt over the cluster
by (document, octave, boundary), whatever document they come from. Only documents with such tiles are
joined with their runs.

Defined results: a null or empty text has no words and no runs; a null id edits nothing;
very long texts are whole (their tiles are spread); ties go to the smallest start, then period;
repeated rows each get their row; an empty table gives no rows; only id and text are read
of the input's columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import text_of, written

SHORTEST = 24  # words of the shortest run
PERIODS = 3  # periods that a run spans at least
FIRST = 8  # periods below this make up the first octave
STEP = 16  # of the first octave; the later ones have 2B
GRAM = 8  # half of the least step: a run repeats so many words on one side of its boundary
BATCH_WORDS = 1 << 18

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def octaves(longest: int) -> Iterator[tuple[int, int, int]]:
    """(smallest period, first period beyond, step) of the octaves that texts of so many words can use."""
    low, high = 1, FIRST
    while low * PERIODS <= longest and longest >= SHORTEST:
        yield low, high, max(STEP, high)
        low, high = high, 2 * high


def z_function(codes: list[int]) -> list[int]:
    """Length of the common prefix of the whole sequence and each of its suffixes."""
    n = len(codes)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and codes[k] == codes[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(codes: list[int], at: int, low: int, high: int, step: int) -> list[tuple[int, int, int]]:
    """(period, first, end): intervals of agreement around place ``at`` of a tile, within one step of it."""
    ahead, before = codes[at:], codes[:at][::-1]
    right = z_function(ahead)
    # Words before the boundary against words before boundary + period, both read backwards.
    top = min(high - 1, len(ahead))
    back = z_function([*before, -1, *codes[:at + top][::-1]])
    out = []
    for p in range(low, top + 1):
        r = min(right[p], step) if p < len(ahead) else 0
        left = min(back[len(before) + 1 + top - p], len(before))
        if r + left >= step:
            out.append((p, at - left, at + r))
    return out


def _grams(codes: np.ndarray) -> np.ndarray:
    """Rolling hash of the GRAM words from each place on (equal words, equal hash)."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9) + h[width:] if len(h) > width else h[:0]
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def may_hold(codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """Per octave (low, high, step, document numbers, boundaries): tiles of the documents at ``offsets``
    where some period repeats the GRAM words right before or after the boundary."""
    grams = _grams(codes)
    starts, sizes = offsets[:-1], np.diff(offsets)
    for low, high, step in octaves(int(sizes.max(initial=0))):
        docs = np.flatnonzero((sizes >= SHORTEST) & (sizes >= PERIODS * low))
        counts = sizes[docs] // step + 1
        doc = np.repeat(docs, counts)
        bound = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        hit = np.zeros(len(doc), dtype=bool)
        block = max(1, (1 << 20) // (high - low))
        for a in range(0, len(doc), block):
            d, b = doc[a:a + block], bound[a:a + block]
            here = (starts[d] + b)[:, None]
            other = here + np.arange(low, high)
            end = (starts[d] + sizes[d])[:, None]
            for shift in (0, GRAM):  # after the boundary, before it
                ok = (other - shift + GRAM <= end) & (here - shift >= starts[d][:, None])
                same = grams[np.minimum(here - shift, len(grams) - 1)] == grams[np.minimum(other - shift, len(grams) - 1)]
                hit[a:a + block] |= (same & ok).any(axis=1)
        yield low, high, step, doc[hit], bound[hit]


def replant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Make every tenth document, by its id's checksum, periodic from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _explode(edit: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, id, text) -> finished rows of documents without a tile to solve; words and tiles of the others."""

    def flush(keys: list, ids: list, texts: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
        codes = pd.factorize(np.array([*chain.from_iterable(texts), b""], dtype=object))[0][:-1].astype(np.int32)
        offsets = np.cumsum([0, *map(len, texts)])
        rows = []
        tiled = set()
        for low, high, step, docs, bounds in may_hold(codes, offsets):
            for d, b in zip(docs.tolist(), bounds.tolist()):
                tiled.add(d)
                first, end = max(b - step, 0), min(b + step + high, len(texts[d]))
                rows.append({"key": keys[d], "low": low, "high": high, "step": step, "first": first, "bound": b,
                             "codes": codes[offsets[d] + first:offsets[d] + end]})
        for d, words in enumerate(texts):
            joined = b" ".join(words)
            if d in tiled:
                rows.append({"key": keys[d], "id": ids[d], "words": joined})
            else:
                rows.append({"key": keys[d], "id": ids[d], "collapsed_sha256": _hex(joined)})
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", pa.int64()), ("id", batch.schema.field(1).type), ("words", pa.binary()),
                                ("low", pa.int64()), ("high", pa.int64()), ("step", pa.int64()), ("first", pa.int64()),
                                ("bound", pa.int64()), ("codes", pa.list_(pa.int32())), ("collapsed_sha256", pa.string())])
            keys, ids, texts, size = [], [], [], 0
            for key, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = text.split()  # bytes: cut at exactly space, tab .. carriage return
                if edit is not None:
                    words = edit(words, doc_id)
                if keys and size + len(words) > BATCH_WORDS:
                    yield flush(keys, ids, texts, schema)
                    keys, ids, texts, size = [], [], [], 0
                keys.append(key)
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if keys:
                yield flush(keys, ids, texts, schema)

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the tiles of a partition."""
    for batch in batches:
        out = []
        for tile in batch.to_pylist():
            found = solve_tile(tile["codes"], tile["bound"] - tile["first"], tile["low"], tile["high"], tile["step"])
            out += [(tile["key"], p, tile["first"] + a, tile["first"] + b) for p, a, b in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                             names=["key", "period", "first", "end"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(key, start, length, period): fragments of one document and period that touch, joined; runs kept."""
    by_place = Window.partitionBy("key", "period").orderBy("first", "end")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opens = fragments.withColumn("_new", F.when(F.col("first") <= reached, 0).otherwise(1))
    whole = opens.withColumn("_at", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("key", "period", "_at").agg(F.min("first").alias("start"), F.max("end").alias("_end"))
    length = F.col("_end") - F.col("start") + F.col("period")
    runs = whole.withColumn("length", length).where(
        F.col("length") >= F.greatest(F.lit(SHORTEST), F.col("period") * PERIODS))
    # The same stretch has its multiples as periods too.
    return runs.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run (start, length, period) holds after its first period."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for words, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            # By start, then period; of the best ones the first is taken.
            ordered = sorted((r["start"], r["length"], r["period"]) for r in runs or [])
            ordered.sort(key=lambda r: (r[0], r[2]))
            best = None
            for r in ordered:
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            digest = _hex("".join(f"{s},{n},{p}\n" for s, n, p in ordered).encode())
            first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            text = b" ".join(collapse(words.split(), ordered))
            out.append((len(ordered), first[0], first[1], first[2], first[3], digest, _hex(text), text))
        if out:
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()]
            names = [f.split()[0] for f in RESULT.split(", ")] + ["collapsed"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                                             names=["id", *names])


def _solved(docs: DataFrame, id_column: str, edit: Callable | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finished rows, the other documents' (key, id, words), and the runs (key, start, length, period)."""
    id_type = docs.schema[id_column].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField("key", long), T.StructField("id", id_type), T.StructField("words", T.BinaryType()),
                           *[T.StructField(c, long) for c in ("low", "high", "step", "first", "bound")],
                           T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("collapsed_sha256", T.StringType())])
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_column).alias("id"),
                        text_of().cast("binary").alias("text"))
    # Written once: the rows' numbers are the same for all that reads them.
    table = written(keyed.mapInArrow(_explode(edit), schema), "periodic")
    tiles = table.where("codes IS NOT NULL").select("key", "low", "high", "step", "first", "bound", "codes")
    fragments = tiles.repartition("key", "low", "bound").mapInArrow(_solve, "key long, period long, first long, end long")
    return (table.where("collapsed_sha256 IS NOT NULL").select("id", "collapsed_sha256"),
            table.where("words IS NOT NULL").select("key", "id", "words"), stitch(fragments))


def periodic_runs(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, start, length, period) of every run, in words."""
    _, rest, runs = _solved(docs, id_column, None)
    return rest.drop("words").join(runs, "key").select(F.col("id").alias(id_column), "start", "length", "period")


def periodic_report(docs: DataFrame, id_column: str = "doc_id", edit: Callable | None = None) -> DataFrame:
    """Runs and the collapsed words of each document; ``edit`` (words, id) may change the words first."""
    finished, rest, runs = _solved(docs, id_column, edit)
    listed = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # one document's
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType),
                           *T._parse_datatype_string(RESULT).fields, T.StructField("collapsed", T.BinaryType())])
    described = rest.join(listed, "key", "left").select("id", "words", "runs").mapInArrow(_describe, schema).drop("collapsed")
    nothing = F.lit(None).cast("long")
    plain = finished.select("id", F.lit(0).cast("long").alias("n_runs"),
                            *[nothing.alias(c) for c in ("start", "length", "period", "exponent_milli")],
                            F.lit(_hex(b"")).alias("runs_sha256"), "collapsed_sha256")
    return described.unionByName(plain).withColumnRenamed("id", id_column)
