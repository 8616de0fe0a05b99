"""Removal of repeated byte strings by sharded suffix arrays.

A byte goes if a string of ``window`` bytes (``WINDOW``, if not said otherwise) that covers it also starts elsewhere.

1. Identical texts are collapsed by digest: all of such a text is repeated, and
   one copy, under a number, stands for it in the rest.
2. Sharding by content. ``anchors.owned_windows`` gives each window an anchor that
   depends on its bytes alone, so equal windows have equal anchors, at equal distances. Anchors
   whose gram occurs once (an aggregate of one row per anchor) own no repeated
   window. The others' runs of windows are cut out as segments and go to the shard of their
   gram; identical segments are counted before the shuffle.
3. In a shard, the windows of a segment are dealt to cells of ``CELL`` starts by their
   distance from the anchor. The bytes that all windows of a cell share (its core) must
   agree for windows to agree. Cells alone with their core are done; identical cells are repeated as
   they stand; the differing ones are concatenated, suffix-sorted
   by induced sorting, and permuted common prefixes tell the repeated starts
   (``induced.repeated_starts``).
4. A gram with more than ``FINE_BYTES`` of distinct segments is not one task's
   work: its cells are dealt by (gram, cell, core) instead, and counted before
   that shuffle too. Where even such a deal has more than ``FINE_BYTES``, its cells are
   narrowed to one start: the core is then the whole window, whose copies are counted
   by digest in Spark, so no task needs the group.
5. Repeated runs go back to the texts by number and are merged there.

``repeats_report`` also counts what strings of ``PASSAGE`` bytes repeat, as a passage of over 50
words can be shorter than ``WINDOW``. It looks for those first: all short strings of a long
repeated one are repeated, at neighbouring starts, so the long ones are looked for
in the stretches of such starts alone (``_wider``).

Every step is exact: nothing is sampled or capped, at any size.

Defined results: a null text is empty; texts shorter than the window stay
whole; repeated rows are identical texts, so all their bytes go once they have a
window; an empty table gives no rows; null ids are carried through. Removal
may cut a character in two: ``remove_repeats`` drops the broken bytes at
such a cut from the text it returns (the report's digest is of the exact bytes).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import anchors, induced
from shelfspark.llm.common import drop_written, partitions_for, text_of, written

WINDOW = anchors.WINDOW
PASSAGE = 200  # bytes: no longer than 50 words that are short
CELL = 32
SHARD_BYTES = 2 << 20  # text sorted at once
FINE_BYTES = 16 << 20
RUNS = "array<struct<lo:int,hi:int>>"


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _bytes(text: str | bytes) -> bytes:
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def _anchor_rows(window: int) -> Callable:
    """(gram, doc, lo, n, lead): runs of windows [lo, lo + n) whose anchor starts at lo + lead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            grams, los, ns, leads, sizes = [], [], [], [], []
            for text in rows["text"]:
                gram, lo, n, lead = anchors.owned_windows(_bytes(text), window)
                grams.append(gram), los.append(lo), ns.append(n), leads.append(lead), sizes.append(len(gram))
            if sizes:
                yield pd.DataFrame({"gram": np.concatenate(grams), "doc": np.repeat(rows["doc"].to_numpy(), sizes),
                                    "lo": np.concatenate(los).astype(np.int32), "n": np.concatenate(ns).astype(np.int16),
                                    "lead": np.concatenate(leads).astype(np.int16)})

    return run


def _cut(window: int) -> Callable:
    """Segments of the texts for the runs listed with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for rows in batches:
            out = []
            for doc, text, runs in rows.itertuples(index=False, name=None):
                data = _bytes(text)
                for r in runs:
                    piece = data[r["lo"]:r["lo"] + r["n"] + window - 1]
                    out.append((r["gram"], xxhash.xxh3_128_digest(piece), doc, r["lo"], r["lead"], piece))
            yield pd.DataFrame(out, columns=["gram", "key", "doc", "lo", "lead", "piece"])

    return run


def _cells(piece: bytes, lead: int, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(cell, first start, last start, core) of the starts of a segment."""
    n = len(piece) - window + 1
    for cell in range(max(lead - n + 1, 0) // CELL, lead // CELL + 1):
        last = lead - cell * CELL
        yield cell, max(last - CELL + 1, 0), min(last, n - 1), piece[last:last - CELL + 1 + window]


class _Shard:
    """Collects differing cells, sorts them once there is enough text, and keeps runs by segment."""

    def __init__(self, window: int):
        self.window = window
        self.pieces: list[bytes] = []
        self.users: list[list[tuple[int, int]]] = []  # (segment number, first start) of each piece
        self.size = 0
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, piece: bytes, users: list[tuple[int, int]]) -> None:
        self.pieces.append(piece)
        self.users.append(users)
        self.size += len(piece)

    def repeated(self, segment: int, lo: int, hi: int) -> None:
        """Starts lo .. hi of a segment are repeated."""
        self.runs[segment].append((lo, hi))

    def sort(self) -> None:
        for starts, users in zip(induced.repeated_starts(self.pieces, self.window), self.users):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                firsts = starts[np.concatenate(([0], cut + 1))]
                lasts = starts[np.concatenate((cut, [len(starts) - 1]))]
                for segment, at in users:
                    self.runs[segment] += [(at + a, at + b) for a, b in zip(firsts.tolist(), lasts.tolist())]
        self.pieces, self.users, self.size = [], [], 0


def _settle(shard: _Shard, cells: dict) -> None:
    """cells: core -> cell text -> [(segment, first start, copies)]; decides what needs no sorting."""
    for texts in cells.values():
        alone = len(texts) == 1
        for text, users in texts.items():
            starts = len(text) - shard.window
            if sum(copies for _, _, copies in users) > 1:
                for segment, at, _ in users:
                    shard.repeated(segment, at, at + starts)
                if not alone:
                    shard.add(text, [])  # still a partner of the others
            elif not alone:
                shard.add(text, [(segment, at) for segment, at, _ in users])


def _merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1]["hi"] + 1:
            out[-1]["hi"] = max(out[-1]["hi"], hi)
        else:
            out.append({"lo": lo, "hi": hi})
    return out


def _sort_shards(window: int) -> Callable:
    """(key, runs): repeated starts of distinct segments; rows come sorted by ``deal``.

    ``lead`` < 0 marks a row that is one cell already (its deal says which core)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, keys = _Shard(window), []
        deal, group = None, []

        def close() -> None:
            cells: dict = defaultdict(lambda: defaultdict(list))
            for key, lead, piece, copies in group:
                number = len(keys)
                keys.append(key)
                if lead < 0:
                    cells[0][piece].append((number, 0, copies))
                elif len(group) == 1 and copies > 1:
                    shard.repeated(number, 0, len(piece) - window)
                else:
                    for cell, lo, hi, core in _cells(piece, lead, window):
                        cells[cell, core][piece[lo:hi + window]].append((number, lo, copies))
            _settle(shard, cells)
            group.clear()

        def flush() -> pd.DataFrame:
            shard.sort()
            out = [(keys[s], _merged(r)) for s, r in shard.runs.items()]
            keys.clear()
            shard.runs.clear()
            return pd.DataFrame(out, columns=["key", "runs"])

        for rows in batches:
            for row in rows[["deal", "key", "lead", "piece", "copies"]].itertuples(index=False, name=None):
                if row[0] != deal:
                    close()
                    deal = row[0]
                    if shard.size >= SHARD_BYTES or len(keys) >= 50_000:
                        yield flush()
                group.append(row[1:])
        close()
        yield flush()

    return run


def _fine_cells(window: int) -> Callable:
    """The cells of segments of crowded grams, dealt by (gram, cell, core)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for rows in batches:
            out = []
            for gram, key, lead, piece, copies in rows[["gram", "key", "lead", "piece", "copies"]].itertuples(index=False, name=None):
                for cell, lo, hi, core in _cells(piece, lead, window):
                    text = piece[lo:hi + window]
                    deal = xxhash.xxh3_64_intdigest(core, (gram ^ cell) & (2**64 - 1)) - 2**63
                    out.append((deal, xxhash.xxh3_128_digest(text), text, key, lo, copies))
            yield pd.DataFrame(out, columns=["deal", "cell_key", "piece", "key", "at", "copies"])

    return run


def _windows(window: int) -> Callable:
    """The digest of each window of a cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for rows in batches:
            out = [(xxhash.xxh3_128_digest(piece[at:at + window]), cell_key, at, copies)
                   for cell_key, piece, copies in rows[["cell_key", "piece", "copies"]].itertuples(index=False, name=None)
                   for at in range(len(piece) - window + 1)]
            yield pd.DataFrame(out, columns=["window", "cell_key", "at", "copies"])

    return run


def _counted(cells: DataFrame, window: int) -> DataFrame:
    """(cell_key, runs): repeated starts of cells (cell_key, piece, copies) by counts of their windows."""
    windows = cells.groupBy("cell_key").agg(F.first("piece").alias("piece"), F.sum("copies").alias("copies")).mapInPandas(
        _windows(window), "window binary, cell_key binary, at int, copies long")
    repeated = windows.groupBy("window").agg(F.sum("copies").alias("c")).where("c > 1").select("window")
    repeated = written(repeated, "suffix-windows")  # so that the join can split a window that very many cells have
    return windows.join(repeated, "window", "left_semi").groupBy("cell_key").agg(
        F.collect_list(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))).alias("runs"))  # at most CELL


def _by_deal(pieces: DataFrame, window: int) -> DataFrame:
    width = partitions_for(pieces.sparkSession)
    return pieces.select("deal", "key", "lead", "piece", "copies").repartition(width, "deal") \
        .sortWithinPartitions("deal").mapInPandas(_sort_shards(window), f"key binary, runs {RUNS}")


def repeated_runs(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, runs): repeated starts of texts or bytes (doc, text), where there are any."""
    schema = "gram long, doc long, lo int, n short, lead short"
    rows = written(texts.select("doc", "text").mapInPandas(_anchor_rows(window), schema), "suffix-anchors")
    # A gram found at two places has two different place hashes (equal ones would mean one text and place).
    place = F.xxhash64("doc", "lo")
    shared = rows.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("gram")
    shared = written(shared, "suffix-shared")  # so that the join below can split a gram that very many rows have
    wanted = rows.join(shared, "gram", "left_semi").groupBy("doc").agg(
        F.collect_list(F.struct("gram", "lo", "n", "lead")).alias("runs"))  # one text's own anchors
    segments = written(texts.select("doc", "text").join(wanted, "doc").select("doc", "text", "runs").mapInPandas(
        _cut(window), "gram long, key binary, doc long, lo int, lead short, piece binary"), "suffix-segments")
    drop_written(rows, shared)
    distinct = written(segments.groupBy("gram", "key", "lead", "piece").agg(F.count("*").alias("copies")), "suffix-distinct")
    crowded = distinct.groupBy("gram").agg(F.sum(F.octet_length("piece")).alias("b")).where(
        F.col("b") > FINE_BYTES).select("gram")
    found = _by_deal(distinct.join(crowded, "gram", "left_anti").withColumn("deal", F.col("gram")), window)

    fine = distinct.join(crowded, "gram", "left_semi").mapInPandas(
        _fine_cells(window), "deal long, cell_key binary, piece binary, key binary, at int, copies long")
    sizes = fine.groupBy("deal", "cell_key").agg(F.first(F.octet_length("piece")).alias("b"))
    over = written(sizes.groupBy("deal").agg(F.sum("b").alias("b")).where(F.col("b") > FINE_BYTES).select("deal"), "suffix-over")
    fine_distinct = fine.join(over, "deal", "left_anti").groupBy("deal", F.col("cell_key").alias("key"), "piece").agg(
        F.sum("copies").alias("copies"))
    fine_found = _by_deal(fine_distinct.withColumn("lead", F.lit(-1).cast("short")), window).withColumnRenamed("key", "cell_key")
    fine_found = fine_found.unionByName(_counted(fine.join(over, "deal", "left_semi").select("cell_key", "piece", "copies"), window))
    fine_found = fine.select("cell_key", "key", "at").join(fine_found, "cell_key").select(
        "key", _moved("at").alias("runs"))
    hits = segments.select("key", "doc", "lo").join(found.unionByName(fine_found), "key")
    found = written(hits.groupBy("doc").agg(F.flatten(F.collect_list(_moved("lo"))).alias("runs")), "suffix-runs")  # a text's own
    drop_written(segments, distinct)
    return found


def _spans(runs, size: int, window: int) -> list[tuple[int, int]]:
    """Maximal removed byte spans [a, b) from repeated starts."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [(a, min(b, size)) for a, b in out]


def _stretches(window: int, passage: int) -> Callable:
    """(doc, at, text): bytes with repeated strings of ``passage`` bytes at every start, ``window`` bytes of them or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text, runs in rows.itertuples(index=False, name=None):
                data = _bytes(text)
                out += [(doc, r["lo"], data[r["lo"]:r["hi"] + passage]) for r in _merged([(r["lo"], r["hi"]) for r in runs])
                        if r["hi"] + passage - r["lo"] >= window]
            yield pd.DataFrame(out, columns=["doc", "at", "text"])

    return run


def _moved(at: str) -> Column:
    return F.transform("runs", lambda r: F.struct((r["lo"] + F.col(at)).alias("lo"), (r["hi"] + F.col(at)).alias("hi")))


def _wider(texts: DataFrame, runs: DataFrame, window: int, passage: int) -> DataFrame:
    """(doc, runs) of ``window`` bytes, from those of ``passage`` bytes."""
    parts = written(texts.select("doc", "text").join(runs, "doc").select("doc", "text", "runs").mapInPandas(
        _stretches(window, passage), "doc long, at int, text binary").withColumn(
        "part", F.monotonically_increasing_id()), "suffix-stretches")
    found = repeated_runs(parts.select(F.col("part").alias("doc"), "text"), window).withColumnRenamed("doc", "part")
    wide = written(parts.select("part", "doc", "at").join(found, "part").groupBy("doc").agg(
        F.flatten(F.collect_list(_moved("at"))).alias("runs")), "suffix-wide")  # a text's own
    drop_written(parts, found)
    return wide


def _cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _kept(window: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for digest, text, runs in rows.itertuples(index=False, name=None):
                data = _bytes(text)
                out.append((digest, _cut_out(data, _spans(runs, len(data), window)).decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=["digest", "kept"])

    return run


def _reported(window: int, passage: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for digest, text, runs, short in rows.itertuples(index=False, name=None):
                data = _bytes(text)
                spans, passages = _spans(runs, len(data), window), _spans(short, len(data), passage)
                kept = _cut_out(data, spans)
                out.append((digest, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            sum(b - a for a, b in passages), len(passages)))
            yield pd.DataFrame(out, columns=["digest", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"])

    return run


def _distinct_texts(docs: DataFrame, window: int) -> DataFrame:
    """(digest, text, copies, doc) of the texts that have a window."""
    long = docs.select(text_of().alias("text")).where(F.octet_length("text") >= window)
    return written(long.groupBy(digest_of(F.col("text")).alias("digest")).agg(
        F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("doc", F.monotonically_increasing_id()), "suffix-texts")


def cleaned_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(digest, kept) of each distinct text that loses bytes."""
    texts = _distinct_texts(docs, window)
    cut = texts.where("copies = 1").select("doc", "digest", "text").join(repeated_runs(texts, window), "doc") \
        .select("digest", "text", "runs").mapInPandas(_kept(window), "digest string, kept string")
    return cut.unionByName(texts.where("copies > 1").select("digest", F.lit("").alias("kept")))


def repeats_report(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """Bytes removed from each document (doc_id, text), the digest of what is kept, and the bytes and
    maximal runs covered by strings of ``passage`` bytes (``window``, if that is less) that also start elsewhere."""
    passage = min(passage, window)
    texts = _distinct_texts(docs, passage)
    short = repeated_runs(texts, passage)
    runs = short if passage == window else _wider(texts, short, window, passage)
    both = short.withColumnRenamed("runs", "short").join(runs, "doc", "left").withColumn(
        "runs", F.coalesce("runs", F.array().cast(RUNS)))
    cut = texts.where("copies = 1").select("doc", "digest", "text").join(both, "doc").select(
        "digest", "text", "runs", "short").mapInPandas(
        _reported(window, passage),
        "digest string, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long")
    size = F.octet_length("text").cast("long")
    gone = size >= window  # a repeated text goes whole, once it has a window
    whole = texts.where("copies > 1").select(
        "digest", F.when(gone, size).alias("n_removed"), F.when(gone, F.lit(1).cast("long")).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).alias("kept_sha256"), size.alias("n_passage_bytes"), F.lit(1).cast("long").alias("n_passages"))
    mine = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), digest_of(text_of()).alias("digest"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans", "n_passage_bytes", "n_passages")]
    return mine.join(cut.unionByName(whole), "digest", "left").select(
        "doc_id", "n_bytes", *counts[:2], F.coalesce("kept_sha256", "digest").alias("kept_sha256"), *counts[2:])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the repeated bytes cut out of their texts; ``n_chars`` follows where present."""
    columns = docs.columns
    packed = docs.select(F.struct("*").alias("_row"), digest_of(text_of()).alias("_digest"))
    changed = cleaned_texts(docs, window).select(F.col("digest").alias("_cut"), "kept")
    joined = packed.join(changed, F.col("_digest") == F.col("_cut"), "left")
    row = F.col("_row").withField("text", F.coalesce("kept", F.col("_row")["text"]))
    if "n_chars" in columns:
        row = F.when(F.col("_cut").isNull(), F.col("_row")).otherwise(
            row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType)))
    return joined.select(row.alias("_row")).select("_row.*")
