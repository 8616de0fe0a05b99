"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's
word shingles. Two fingerprints link at ``MAX_BITS`` = 3 or fewer differing
bits; documents joined by links, directly or through others, form a component.

Candidate search. The fingerprint is two halves; if two fingerprints differ in
at most 3 bits, one half differs in at most 1. Of each half 31 bits are covered
by the perfect Hamming code (31, 26): its covering radius is 1, so each half
has exactly one anchor (codeword) within distance 1, its home. A fingerprint is
replicated to every anchor within radius + threshold = 1 + 1 = 2 of its half: its home
and, if it isn't a codeword itself, the 15 codewords of weight-3 offset that
clear the home syndrome (16 anchors a half, from a fixed table of 31 x 16).
Whatever lies within 1 of a fingerprint's half is then replicated to that
fingerprint's home, so no link is lost. There are 2^26 anchors a half, so
unrelated fingerprints rarely meet.

Per anchor, fingerprints at home there are compared with all replicas there.
Only distinct fingerprints take part (copies cost one row), each anchor hands
on a spanning forest of its links, at most one edge per member, and anchors
with more than ``FINE`` members are dealt anew by (anchor, which 8-bit block of the other
half agrees, its value): of 4 blocks at least one agrees when the other half
differs in 3 bits or fewer, so the finer groups keep every link too.

Defined results: a null or empty text, or one of white space only, has the
zero fingerprint and links like any other; fewer words than a shingle give one
shingle of all words; repeated rows each get their row; an empty table gives
no rows; a null doc_id takes part in its component but never names it (the
component of null ids only has a null id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import partitions_for, text_of, written
from shelfspark.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
FINE = 4096  # members of one anchor beyond which it is dealt anew by finer anchors
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes of one text (0 without words)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    # A-Z to a-z only; bytes.split() cuts at exactly space, tab .. carriage return.
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())),
            dtype=np.uint64, count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for block in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[block:block + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints of a text column as signed longs."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(fps.view(np.int64))

    return run(text_of(text))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Hamming (31, 26) syndrome: XOR of the positions 1..31 of the set bits."""
    out = np.zeros(x.shape, dtype=np.uint32)
    for bit in range(31):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), np.uint32(bit + 1), np.uint32(0))
    return out


def _offsets() -> np.ndarray:
    """[syndrome] -> offsets to the codewords within distance 2 (home first)."""
    table = np.zeros((32, 16), dtype=np.uint32)
    for s in range(1, 32):
        pairs = [(1 << (p - 1)) | (1 << (q - 1)) for p in range(1, 32) for q in range(p + 1, 32) if p ^ q == s]
        table[s] = [1 << (s - 1), *pairs]
    return table


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, fp, home) rows: each half's home anchor and the others within reach."""
    table = _offsets()
    for rows in batches:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        for lo in range(0, len(fp), 1 << 14):
            part = fp[lo:lo + (1 << 14)]
            for half in (0, 1):
                bits = ((part >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
                s = _syndrome(bits)
                anchors = bits[:, None] ^ table[s]
                keep = np.ones(anchors.shape, dtype=bool)
                keep[s == 0, 1:] = False  # a codeword is its only anchor within 2
                home = np.zeros(anchors.shape, dtype=bool)
                home[:, 0] = True
                key = anchors.astype(np.int64) | (half << 32)
                wide = np.broadcast_to(part.view(np.int64)[:, None], anchors.shape)
                yield pd.DataFrame({"key": key[keep], "fp": wide[keep], "home": home[keep]})


def _forest(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links between the home members and all members of one anchor."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= MAX_BITS)
        a = root(int(i))
        for j in near:
            b = root(int(j))
            if a != b:
                parent[b] = a
                edges.append((int(i), int(j)))
    return edges


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges of each key; rows come sorted by key, one key is held at a time."""

    def edges(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pd.DataFrame:
        cut = np.flatnonzero(np.diff(key)) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut, [len(key)]))
        pairs: list[tuple[int, int]] = []
        for a, b in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist()):
            if home[a:b].any():
                pairs += [(int(fp[a + i]), int(fp[a + j])) for i, j in _forest(fp[a:b], home[a:b])]
        both = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
        return pd.DataFrame({"a": both[:, 0].view(np.int64), "b": both[:, 1].view(np.int64)})

    held: list[np.ndarray] = []
    for rows in batches:
        new = [rows["key"].to_numpy(), rows["fp"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool)]
        cols = [np.concatenate(x) for x in zip(held, new)] if held else new
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
        if last:
            yield edges(*(np.ascontiguousarray(c[:last]) for c in cols))
        held = [np.ascontiguousarray(c[last:]) for c in cols]
    if held:
        yield edges(*held)


def _by_key(members: DataFrame) -> DataFrame:
    """Links within the groups of equal ``key`` (a long that identifies the anchor)."""
    width = partitions_for(members.sparkSession)
    return members.repartition(width, "key").sortWithinPartitions("key").mapInPandas(_links, "a long, b long")


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span every component of the links."""
    members = written(distinct_fps.mapInPandas(_anchors, "key long, fp long, home boolean"), "simhash-anchors")
    crowded = members.groupBy("key").count().where(F.col("count") > FINE).select("key")
    plain = _by_key(members.join(crowded, "key", "left_anti"))
    # The other half agrees in one of its four bytes: (anchor, byte, value) are finer anchors.
    other = F.when(F.col("key") < F.lit(1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    finer = members.join(crowded, "key", "left_semi").select("key", "fp", "home", F.posexplode(F.array(*[
        F.shiftright(other, 8 * k).bitwiseAND(F.lit(255)) for k in range(4)])).alias("k", "v"))
    finer = finer.select((F.col("key") + F.shiftleft(F.col("k").cast("long") + 1, 34) * 256
                          + F.shiftleft(F.col("v"), 34)).alias("key"), "fp", "home")
    return plain.unionByName(_by_key(finer)).distinct()


def _classes(distinct: DataFrame) -> DataFrame:
    """``distinct`` (one row per fingerprint) with the class its fingerprint is linked into."""
    labels = components(links(distinct.select("fp")))  # (node, root) of linked fingerprints
    return distinct.join(labels, distinct["fp"] == labels["node"], "left").withColumn(
        "class", F.coalesce("root", "fp")).drop("node", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    fps = written(docs.select(F.col("doc_id").cast("long"), fingerprint_of(F.col("text"), shingle).alias("fp")), "simhash-fps")
    classes = written(_classes(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), "simhash-classes")
    smallest = classes.groupBy("class").agg(F.min("first_id").alias("component_id"))
    by_fp = classes.join(smallest, "class").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all its columns."""
    rows = written(docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), fingerprint_of(F.col("text"), shingle).alias("fp"),
        F.monotonically_increasing_id().alias("_uid")), "simhash-rows")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_uid")).alias("first")
    classes = _classes(rows.groupBy("fp").agg(first))
    keep = classes.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first._uid").alias("_uid"))
    return rows.join(keep, "_uid", "left_semi").select("_row.*")


def simhash_report(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint in hexadecimal and component per document."""
    return near_duplicates(docs, shingle).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
