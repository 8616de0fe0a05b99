"""Document fingerprints by SimHash (DataFrame functions only).

The terms of a text are its runs of three words; a term weighs as often as it occurs. Each of the 64
bits of a term's XXH64 votes for (1) or against (0) that bit with the term's weight, and the
fingerprint has the bits whose votes sum to more than zero. The votes are counted for many bits at once: a
long has four counters of 16 bits, 16 longs count all, and every 65,535 terms they are
emptied into whole counters, so texts of any length are whole.

Fingerprints within a Hamming radius r are found by permuted block tables: the bits are cut into r + 3
blocks; two fingerprints that differ in r bits agree in at least 3 blocks. There is a table for every choice of 3
blocks, keyed by their bits (for r = 3, 20 tables of 31 to 33 bits). Pairs that meet in a table are compared
in all bits and kept in the first of the tables where they meet. Only distinct fingerprints take part,
copies are a count beside them, and the search is for a stated set of queries.

The successor of a document (here in descending id) comes without an order over one task: the ids alone are sorted by range
(as many ranges as the texts' bytes ask for), the first of each range is a head; texts are shuffled once, each to the range that a
binary search among the heads (one a range) names, and a head's text also to the range before its own.

Defined results: a null text is empty; a text without words has fingerprint 0, one of fewer words than a term is one term;
equal texts have equal fingerprints, order decides nothing; rows of equal id follow each other by a hash
of their texts, null ids come last; a single row is its own successor; repeated rows each get their row; an
empty table gives no rows; only id and text are read of the input's columns.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACE_CLASS, let, partitions_for, text_of, written

TERM = 3
RADIUS = 3
EVERY = 50  # rows whose id this divides are the queries of the report's search
FULL = 65_535  # what a counter of 16 bits holds
RANGE_BYTES = 64 << 20  # text that one range of successors should hold
_LANES = 0x0001_0001_0001_0001
_STEPS = [1 << k for k in range(20, -1, -1)]  # of the binary search: up to 2^21 ranges


def _long(bits: int) -> Column:
    """A literal of 64 bits as Spark's signed long."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def term_hashes(text: Column, size: int = TERM) -> Column:
    """XXH64 of every run of ``size`` words (of all words, if fewer)."""

    def of_words(words: Column) -> Column:
        def run(w: Column, i: Column) -> Column:
            return F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)])

        return F.when(F.size(words) >= size, F.transform(F.slice(words, 1, F.size(words) - (size - 1)), run)) \
            .when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))) \
            .otherwise(F.array().cast("array<bigint>"))

    return let(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != ""), of_words)


def _ones(hashes: Column) -> Column:
    """How many of at most FULL hashes have each of the 64 bits set."""

    def lanes(k: int) -> Column:
        def add(acc: Column, h: Column) -> Column:
            return acc + F.shiftrightunsigned(h, k).bitwiseAND(_long(_LANES))

        return F.aggregate(hashes, _long(0), add)

    # Bit k + 16 j is counted in 16 bits of long k, from bit 16 j on.
    return let(F.array(*[lanes(k) for k in range(16)]), lambda packed: F.array(*[
        F.shiftrightunsigned(packed[bit % 16], 16 * (bit // 16)).bitwiseAND(_long(0xFFFF)) for bit in range(64)]))


def fingerprint(text: Column, size: int = TERM) -> Column:
    """The 64-bit fingerprint of a text, as a long."""

    def of_hashes(hashes: Column) -> Column:
        n = F.size(hashes)
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / FULL).cast("int")),
                             lambda c: F.slice(hashes, c * FULL + 1, FULL))
        zeros = F.array_repeat(_long(0), 64)
        ones = F.aggregate(chunks, zeros, lambda acc, c: F.zip_with(acc, _ones(c), lambda x, y: x + y))
        bits = F.transform(ones, lambda votes, bit: F.when(
            votes * 2 > n, F.call_function("shiftleft", _long(1), bit)).otherwise(_long(0)))
        return F.aggregate(bits, _long(0), lambda acc, b: acc.bitwiseOR(b))

    return let(term_hashes(text, size), of_hashes)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - distance(a, b) / F.lit(64.0)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ------------------------------------------------------------- block tables

def masks(radius: int) -> list[int]:
    """The bits of each table: every choice of 3 of radius + 3 blocks."""
    n = radius + 3
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [x | y | z for x, y, z in combinations(blocks, 3)]


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp, bits): all fingerprints of ``prints`` (fp, distinct) within the radius of those
    of ``queries`` (fp, distinct)."""
    tables = masks(radius)

    def filed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("key"))
                         for t, m in enumerate(tables)])
        return df.select(F.col("fp").alias(name), F.explode(keys).alias("_k")).select(name, "_k.t", "_k.key")

    pairs = filed(queries, "query").join(filed(prints, "fp"), ["t", "key"])
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(_long(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    return pairs.where((F.bit_count(differ) <= radius) & (first == F.col("t"))) \
        .select("query", "fp", F.bit_count(differ).alias("bits"))


def count_near(rows: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n): how many of ``rows`` (fp, one a document) lie within the radius of each distinct fp of ``queries``."""
    counted = rows.groupBy("fp").agg(F.count("*").alias("n"))
    found = near_fingerprints(queries.select("fp").distinct(), counted.select("fp"), radius)
    return found.join(counted, "fp").groupBy("query").agg(F.sum("n").alias("n")).withColumnRenamed("query", "fp")


# --------------------------------------------------------------- successors

def with_next(docs: DataFrame, id_column: str, text: Column, carry: dict[str, Column]) -> DataFrame:
    """(id, text, carried columns, next_text, next_<carried>): each document and the next one in descending id,
    after the last the first."""
    place = F.struct(F.col(id_column).alias("id"), F.xxhash64(text).alias("tie"))
    keys = written(docs.select(place.alias("place"), F.octet_length(text).cast("long").alias("size")), "print-keys")
    size = keys.agg(F.sum("size")).first()[0] or 0
    # A stated number of ranges is not merged: the keys are small, the texts that follow are not.
    ranges = max(4 * partitions_for(docs.sparkSession), -(-size // RANGE_BYTES))
    heads = keys.repartitionByRange(ranges, F.desc("place")) \
        .groupBy(F.spark_partition_id()).agg(F.max("place").alias("head")) \
        .agg(F.sort_array(F.collect_list("head"), asc=False).alias("heads"))  # one a range
    heads = written(heads, "print-heads")

    def seek(low: Column, step: Column) -> Column:
        to = low + step
        return F.when((to < F.size("heads")) & (F.get(F.col("heads"), to) >= F.col("place")), to).otherwise(low)

    placed = docs.select(F.col(id_column).alias("id"), text.alias("text"), place.alias("place"),
                         *[c.alias(n) for n, c in carry.items()]).crossJoin(F.broadcast(heads))
    placed = placed.withColumn("_range", F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), seek))
    before = F.pmod(F.col("_range") - 1, F.size("heads"))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    homes = F.when(F.col("place") == F.get(F.col("heads"), F.col("_range")),
                   F.array(own, F.struct(before.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = placed.withColumn("_home", F.explode(homes)).select("id", "text", "place", *carry, "_home.range", "_home.guest")
    in_range = Window.partitionBy("range").orderBy("guest", F.desc("place"))
    following = {f"next_{n}": F.lead(n).over(in_range) for n in ("text", *carry)}
    return dealt.withColumns(following).where(~F.col("guest")).select("id", "text", *carry, *following)


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """Fingerprints of each document and of its text edited with the next one's, their likeness, and, for ids that
    ``every`` divides, how many other documents lie within the radius."""
    pairs = with_next(docs, "doc_id", text_of(), {"fp": fingerprint(text_of()), "n_chars": F.length(text_of()).cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    edited_rows = pairs.select("id", "n_chars", "fp", "next_fp", let(edited, lambda e: F.struct(
        F.sha2(e, 256).alias("edited_sha256"), fingerprint(e).alias("edited_fp"))).alias("_e"))
    rows = written(edited_rows.select("id", "n_chars", "fp", "next_fp", "_e.*"), "prints")
    asks = F.coalesce(F.col("id").cast("long") % every == 0, F.lit(False))
    found = count_near(rows.select("fp"), rows.where(asks).select("fp"), radius)
    shown = [F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"),
             hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
             likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
             likeness(F.col("fp"), F.col("next_fp")).alias("near_next")]
    return rows.where(asks).join(found, "fp").select(*shown, (F.col("n") - 1).alias("n_near")).unionByName(
        rows.where(~asks).select(*shown, F.lit(None).cast("long").alias("n_near")))
