"""Language-model scores by a weighted backoff automaton, kept as Spark tables.

Every word of the training documents counts, and every longer n-gram up to ``ORDER`` that
they have ``LEAST`` times or more has an arc, whatever the input's size. An n-gram can only be
that frequent if the shorter ones in it are, so each order counts extensions of the last
one's arcs only.

Texts are dealt in chunks of a bounded number of tokens. A chunk lists each of its words,
pairs and so on once, with how often its training texts have it, and deals the list by hash to
buckets. A row is a chunk's list for one bucket, sorted, as differences in byte planes, so an n-gram
travels in a few bytes and not as a row of its own. Per bucket the lists are summed, and a row a chunk
goes back with which of its n-grams have arcs, their counts and numbers. So no task holds the
vocabulary or the automaton, only a bucket of it or the arcs that a chunk's texts meet.
A word or n-gram with an arc is numbered within its bucket; a longer n-gram's key is made of its history's
and its last word's numbers by a one-to-one mapping, so counts are exact. Pairs with a word
seen once are seen once themselves and only counted.

Probabilities are interpolated absolute discounting, with each order's discount from
its counts of counts: an arc (h, w) has (c(hw) - D) / c(h) + g(h) P(w | h'), and g(h), the
weight of the failure arc from h to its own suffix h', is the mass that h's arcs
leave. Single words have (c - D) / N, and all unseen words together, as one, the mass D V / N
so freed; so for every history the probabilities of the known words and the unseen word
sum to one.

The state after each word, its longest history with arcs, is looked up order by order for all
positions of a chunk at once, and so are the weights of the arcs and failure arcs taken.

Defined results: a null or empty text has the end token alone; a null doc_id counts as
the empty text for the choice of training documents; repeated rows are counted and
scored each; an empty table gives no rows; without training documents every probability
is that of the one unseen word, 1; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import partitions_for, text_of, written
from shelfspark.llm.simhash import _LOWER

ORDER = 3
LEAST = 2  # occurrences that give an n-gram of two words or more an arc
END = b""  # no word is empty
HELD_OUT, OF = 2, 7
CHUNK_TOKENS = 1 << 20  # a longer text is a chunk of its own
CHUNK_BITS = 14  # of a chunk's number: its place in the task
BUCKET_TOKENS = 1 << 22  # a bucket has a list entry for each of so many tokens at most, on average
SPREAD = 0x9E3779B97F4A7C15  # odd: multiplying by it maps the keys of any number of bits one to one


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % OF == HELD_OUT


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lowered; bytes.split() cuts at exactly space and tab .. carriage return."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def discount(ones: int, twos: int) -> float:
    return (ones + 0.5) / (ones + 2 * twos + 1)


# ------------------------------------------------------------------- packing

def packed(values: np.ndarray) -> bytes:
    """Integers from 0 on as compressed byte planes, the lowest first."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(6, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:6], "little"), data[6]
    out = np.zeros((n, 8), dtype=np.uint8)
    if n and width:
        planes = pa.decompress(data[7:], decompressed_size=n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    """Integers that mostly rise, by their differences (a falling one costs space only)."""
    steps = np.diff(values, prepend=values[:1])
    return int(values[0] if len(values) else 0).to_bytes(8, "little") + packed(steps << 1 ^ steps >> 63)


def unpacked_sorted(data: bytes) -> np.ndarray:
    steps = unpacked(data[8:])
    return int.from_bytes(data[:8], "little") + np.cumsum(steps >> 1 ^ -(steps & 1))


def joined(words: list[bytes]) -> bytes:
    text = b"\n".join(words)
    return len(text).to_bytes(6, "little") + pa.compress(text, codec="zstd", asbytes=True)


def split(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:6], "little")
    return pa.decompress(data[6:], decompressed_size=size, codec="zstd", asbytes=True).split(b"\n") if size else [END]


class Keys:
    """One-to-one keys of (history, word) numbers below the given bounds, spread over buckets in their order."""

    def __init__(self, histories: int, words: int, buckets: int):
        self.words, self.buckets = words, buckets
        self.bits = max(1, (histories * words).bit_length())
        if self.bits > 63:
            raise ValueError("too many n-grams with arcs for one key of 63 bits")
        self.back = pow(SPREAD, -1, 1 << 64)

    def _times(self, keys: np.ndarray, factor: int) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return (keys.astype(np.uint64) * np.uint64(factor) & mask).astype(np.int64)

    def of(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._times(history * self.words + word, SPREAD)

    def history(self, keys: np.ndarray) -> np.ndarray:
        return self._times(keys, self.back) // self.words

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        drop = max(0, self.bits - 32)
        return (keys >> drop) * self.buckets >> (self.bits - drop)


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    firsts = np.flatnonzero(np.diff(sorted_values, prepend=-1)).tolist()
    return zip(sorted_values[firsts].tolist(), firsts, [*firsts[1:], len(sorted_values)])


# -------------------------------------------------------------------- chunks

CHUNKS = ("chunk long, tokens long, trained long, doc_ids array<long>, held binary, sizes binary, ids binary, "
          "words binary, n binary")


def chunks(docs: DataFrame, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """A row per chunk of ``docs`` (doc_id, text, held): its documents with the chunk's numbers of their words and
    ends, and its words by hash with their training counts (``n``). No word holds a line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = first = TaskContext.get().partitionId() << CHUNK_BITS
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        doc_ids, held, ids = [], [], []
        size = 0

        def flush() -> pa.RecordBatch:
            words = list(number)
            by_hash = np.argsort(np.fromiter(map(zlib.crc32, words), np.int64, len(words)), kind="stable")
            rank = np.empty(len(words), dtype=np.int64)
            rank[by_hash] = np.arange(len(words))
            flat = rank[np.concatenate(ids)]
            sizes = np.array([len(i) for i in ids])
            train = ~np.repeat(held, sizes)
            row = {"chunk": chunk, "tokens": len(flat), "trained": int(train.sum()), "doc_ids": list(doc_ids),
                   "held": packed(np.array(held)), "sizes": packed(sizes), "ids": packed(flat),
                   "words": joined([words[i] for i in by_hash.tolist()]),
                   "n": packed(np.bincount(flat, weights=train, minlength=len(words)).astype(np.int64))}
            for kept in (doc_ids, held, ids, number):
                kept.clear()
            return pa.RecordBatch.from_pylist([row], schema=_schema(CHUNKS))

        for batch in batches:
            for doc_id, text, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held"))):
                words = words_of(text)
                words.append(END)
                if ids and size + len(words) > tokens:
                    yield flush()
                    chunk, size = chunk + 1, 0
                    if chunk - first >> CHUNK_BITS:
                        raise ValueError("too many tokens in one task; deal the input to more partitions")
                ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc_id)
                held.append(h)
                size += len(words)
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "held").mapInArrow(run, CHUNKS)


def _schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, types[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


class Chunk:
    """A chunk's tokens (-1 between documents), and for each order so far the n-grams with arcs.

    ``answers`` are rows of ``ANSWERS`` for this chunk, ``keys`` the ``Keys`` of the orders from two on.
    """

    def __init__(self, docs: pa.Table, answers: pa.Table, order: int, buckets: int, keys: list[Keys],
                 discounts: list[float] | None = None):
        self.chunk, self.buckets, self.keys = docs.column("chunk")[0].as_py(), buckets, keys
        self.doc_ids = docs.column("doc_ids").combine_chunks().flatten()
        self.held = unpacked(docs.column("held")[0].as_py()).astype(bool)
        self.sizes = sizes = unpacked(docs.column("sizes")[0].as_py())
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.ids = np.full(int(sizes.sum()) + len(sizes), -1, dtype=np.int64)
        self.ids[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = unpacked(docs.column("ids")[0].as_py())
        self.trains = np.repeat(~self.held, sizes + 1)
        self.width = int(self.ids.max()) + 1
        self.names: list[np.ndarray] = []  # of each order's listed n-grams: the number
        self.index: list[np.ndarray] = []  # at each position the n-gram with an arc that ends there, -1 for none
        self.counts: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        rows: dict[tuple[int, int], tuple] = {}
        for n, bucket, *data in zip(*(answers.column(c).to_pylist() for c in ("n", "bucket", "x", "y", "z"))):
            rows[n, bucket] = data
        for k in range(1, order + 1):
            grams, listed = self.listed(k)
            at = np.arange(len(grams)) if k == 1 else self.sent(k, grams)[0]
            has, count, back = np.zeros(len(grams), bool), np.ones(len(grams), np.int64), np.ones(len(grams))
            names = np.full(len(grams), -1, dtype=np.int64)
            begin = 0
            for n, bucket in sorted(key for key in rows if key[0] == k):
                flags, c, numbers = rows[n, bucket]
                flags = unpacked(flags).astype(bool)
                mine = at[begin:begin + len(flags)]
                begin += len(flags)
                arcs = mine[flags]
                has[arcs] = True
                if c is not None:
                    count[mine if k == 1 else arcs] = unpacked(c)
                if numbers is not None:
                    names[arcs] = unpacked_sorted(numbers) * buckets + bucket
                if discounts and (-k, bucket) in rows:
                    mass, after = map(unpacked, rows[-k, bucket][:2])
                    left = 1 - (mass - discounts[k] * after) / count[arcs]
                    back[arcs] = np.where(after > 0, np.maximum(left, 1e-300), 1.0)
            self.names.append(names)
            self.index.append(np.where((listed >= 0) & has[listed] if len(grams) else False, listed, -1))
            self.counts.append(count)
            self.back.append(back)

    def sent(self, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order in which the listed k-grams are sent, and their keys in it."""
        keys = self.keys[k - 2].of(self.names[k - 2][grams // self.width], self.names[0][grams % self.width])
        order = np.argsort(keys)
        return order, keys[order]

    def listed(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-grams both of whose parts have arcs, sorted, and which of them ends at each position (-1 for none)."""
        if k == 1:
            return np.arange(self.width), self.ids
        before, last = self.before(self.index[-1]), self.index[-1]
        places = np.flatnonzero((before >= 0) & (last >= 0))
        keys, which = np.unique(before[places] * self.width + self.ids[places], return_inverse=True)
        listed = np.full(len(self.ids), -1, dtype=np.int64)
        listed[places] = which
        return keys, listed

    @staticmethod
    def before(index: np.ndarray) -> np.ndarray:
        return np.concatenate((np.full(1, -1, dtype=np.int64), index[:-1]))

    def probabilities(self, total: int, distinct: int, discounts: list[float]) -> np.ndarray:
        """Of the word at each position (1 between documents)."""
        c, d = self.counts[0], discounts[0]
        p = np.where(c > 0, (c - d) / total, d * distinct / total) if total else np.ones(len(c))
        p = np.where(self.ids >= 0, p[self.ids], 1.0)
        for k in range(1, len(self.index)):
            history, own = self.before(self.index[k - 1]), self.index[k]
            at = np.flatnonzero((history >= 0) & (self.ids >= 0))
            p[at] *= self.back[k - 1][history[at]]
            at = np.flatnonzero(own >= 0)
            p[at] += (self.counts[k][own[at]] - discounts[k]) / self.counts[k - 1][history[at]]
        return p

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values at each document's positions."""
        return np.add.reduceat(np.where(self.ids >= 0, values, 0), self.starts)


# ------------------------------------------------------------------ training

LISTS = "chunk long, bucket int, keys binary, n binary, rest long"
# Of a bucket's (n > 0) n-grams for a chunk: the flags (x), the arcs' counts (of words: all; y) and numbers (z). Without a chunk:
# the bucket's figures (seen), or for another bucket (n = 0) histories (x) with the counts (y) and number (z) of their arcs.
ANSWERS = "chunk long, n int, bucket int, x binary, y binary, z binary, seen array<long>"


def word_lists(table: DataFrame, buckets: int) -> DataFrame:
    """``LISTS`` of the chunks' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "n"))):
                words, n = split(words), unpacked(n)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * buckets >> 32
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": chunk, "bucket": b, "keys": joined(words[i:j]), "n": packed(n[i:j]), "rest": 0}
                     for b, i, j in runs(bucket)], schema=_schema(LISTS))

    return table.select("chunk", "words", "n").mapInArrow(run, LISTS)


def gram_lists(docs: DataFrame, answers: DataFrame, k: int, buckets: int, keys: list[Keys]) -> DataFrame:
    """``LISTS`` of the chunks' k-grams both of whose parts have arcs. For pairs, ``rest`` counts the training pairs
    that are not listed, as a word in them has no arc."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = Chunk(left, right, k - 1, buckets, keys)
        grams, listed = mine.listed(k)
        places = listed >= 0
        n = np.bincount(listed[places], weights=mine.trains[places], minlength=len(grams)).astype(np.int64)
        order, sent = mine.sent(k, grams)
        n = n[order]
        out = [{"chunk": mine.chunk, "bucket": b, "keys": packed_sorted(sent[i:j]), "n": packed(n[i:j]), "rest": 0}
               for b, i, j in runs(keys[k - 2].bucket(sent))]
        if k == 2:
            rest = int(((mine.before(mine.ids) >= 0) & (mine.ids >= 0) & mine.trains & ~places).sum())
            out.append({"chunk": None, "bucket": mine.chunk % buckets, "keys": None, "n": None, "rest": rest})
        return pa.Table.from_pylist(out, schema=_schema(LISTS))

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, LISTS)


def answered(lists: DataFrame, k: int, least: int, buckets: int, keys: Keys | None = None) -> DataFrame:
    """``ANSWERS`` of each bucket to the chunks' lists of k-grams. Words are numbered by hash, as the lists have them."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = table.filter(table.column("chunk").is_valid())
        lists = asked.column("keys").to_pylist()
        if k == 1:
            lists = [split(x) for x in lists]
            coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
            which, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            known = coded.dictionary.to_pylist()
            by_hash = np.argsort(np.fromiter(map(zlib.crc32, known), np.int64, distinct), kind="stable")
            rank = np.empty(distinct, dtype=np.int64)
            rank[by_hash] = np.arange(distinct)
            which = rank[which]
            always = np.zeros(distinct, dtype=bool)
            always[[rank[i] for i, w in enumerate(known) if w == END]] = True
        else:
            lists = [unpacked_sorted(x) for x in lists]
            found, which = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_inverse=True)
            distinct, always = len(found), False
        n = np.concatenate([np.zeros(0, np.int64), *map(unpacked, asked.column("n").to_pylist())])
        c = np.bincount(which, weights=n, minlength=distinct).astype(np.int64)
        arc = (c >= least) | always
        number = np.cumsum(arc) - 1
        rest = sum(table.column("rest").to_pylist())
        seen = [int((c == 1).sum()), int((c == 2).sum()), int((c > 0).sum()), rest, int(arc.sum())]
        out = [{"n": k, "bucket": bucket, "seen": seen}]
        end = 0
        for chunk, keys_of in zip(asked.column("chunk").to_pylist(), lists):
            begin, end = end, end + len(keys_of)
            mine = which[begin:end]
            arcs = mine[arc[mine]]
            out.append({"chunk": chunk, "n": k, "bucket": bucket, "x": packed(arc[mine]), "y": packed(c[mine if k == 1 else arcs]),
                        "z": packed_sorted(number[arcs])})
        if k > 1:
            history, which = np.unique(keys.history(found[arc]), return_inverse=True)
            mass = np.bincount(which, weights=c[arc], minlength=len(history)).astype(np.int64)
            after = np.bincount(which, minlength=len(history))
            order = np.argsort(history % buckets, kind="stable")
            history, mass, after = history[order], mass[order], after[order]
            out += [{"n": 0, "bucket": b, "x": packed_sorted(history[i:j] // buckets), "y": packed(mass[i:j]), "z": packed(after[i:j])}
                    for b, i, j in runs(history % buckets)]
        return pa.Table.from_pylist(out, schema=_schema(ANSWERS))

    return lists.groupBy("bucket").applyInArrow(run, ANSWERS)


def backoffs(mine: DataFrame, longer: DataFrame, k: int) -> DataFrame:
    """``ANSWERS`` (n = -k) with the counts (x) and number (y) of the arcs that leave each chunk's k-grams with arcs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        if right.num_rows and left.num_rows:
            at, mass, after = (np.concatenate([f(x) for x in right.column(c).to_pylist()])
                               for c, f in (("x", unpacked_sorted), ("y", unpacked), ("z", unpacked)))
            chunk, bucket, numbers = (left.column(c).to_pylist() for c in ("chunk", "bucket", "z"))
            numbers = [unpacked_sorted(x) for x in numbers]
            size = 1 + max(int(x.max(initial=0)) for x in [at, *numbers])
            mass, after = (np.bincount(at, weights=v, minlength=size).astype(np.int64) for v in (mass, after))
            out = [{"chunk": c, "n": -k, "bucket": b, "x": packed(mass[x]), "y": packed(after[x])}
                   for c, b, x in zip(chunk, bucket, numbers)]
        return pa.Table.from_pylist(out, schema=_schema(ANSWERS))

    left = mine.where("chunk IS NOT NULL").groupBy("bucket")
    return left.cogroup(longer.where("n = 0").groupBy("bucket")).applyInArrow(run, ANSWERS)


class Training:
    """The chunks' documents, the answers to their lists, training tokens and words, and what ``Chunk`` needs."""

    def __init__(self, mine: DataFrame, order: int = ORDER, rarity: int | None = None, chunk_tokens: int = CHUNK_TOKENS):
        table = written(chunks(mine, chunk_tokens), "lm-chunks")
        self.docs = table.select("chunk", "doc_ids", "held", "sizes", "ids")
        sizes = table.agg(F.sum("tokens").alias("all"), F.sum("trained").alias("trained")).first()
        self.total = sizes["trained"] or 0
        self.buckets = max(partitions_for(mine.sparkSession), (sizes["all"] or 0) // BUCKET_TOKENS)
        # With ``rarity`` only n-grams with at least one in ``rarity`` training tokens get arcs (a smaller model on demand).
        rare = -(-self.total // rarity) if rarity else 1
        least = max(rare, LEAST)
        self.discounts: list[float] = []
        self.keys: list[Keys] = []
        self.distinct = 0
        tables: list[DataFrame] = []
        bounds: list[int] = []
        for k in range(1, order + 1):
            if k == 1:
                rows = answered(word_lists(table, self.buckets), k, least, self.buckets)
            else:
                self.keys.append(Keys(bounds[-1], bounds[0], self.buckets))
                # Lists need no counts, and the last order's numbers are needed nowhere.
                lists = gram_lists(self.docs, self._answers(tables).withColumn("y", F.lit(None).cast("binary")), k, self.buckets, self.keys)
                rows = answered(lists, k, least, self.buckets, self.keys[-1])
            tables.append(written(rows, f"lm-grams{k}"))
            ones, twos, every, rest, most = tables[-1].where("seen IS NOT NULL").agg(
                *[F.sum(F.col("seen")[i]) for i in range(4)], F.max(F.col("seen")[4])).first()
            mine.sparkSession._jvm.System.gc()  # by now the step's shuffle files are let go
            bounds.append(self.buckets * max(most or 0, 1))
            self.distinct = self.distinct if tables[1:] else every or 0
            # Pairs with a word seen once, which are not listed, are seen once each.
            self.discounts.append(discount((ones or 0) + (rest or 0 if rare <= 1 else 0), twos or 0))
        if order > 1:
            unnumbered = self._answers(tables[-1:]).withColumn("z", F.lit(None).cast("binary"))
            answers = self._answers(tables[:-1]).unionByName(unnumbered)
        else:
            answers = self._answers(tables)
        self.answers = reduce(DataFrame.unionByName, [answers, *[
            backoffs(tables[k - 1], tables[k], k).drop("seen") for k in range(1, order)]])

    @staticmethod
    def _answers(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.where("chunk IS NOT NULL").drop("seen") for t in tables])


# ------------------------------------------------------------------- scoring

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, order: int = ORDER, rarity: int | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Scores of each document (doc_id, text): counts, add-one base score and the model's log10 probability."""
    mine = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), held_out(F.col("doc_id")).alias("held"))
    trained = Training(mine, order, rarity, chunk_tokens)
    total, distinct, discounts = trained.total, trained.distinct, trained.discounts
    buckets, keys = trained.buckets, trained.keys

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left, right, order, buckets, keys, discounts)
        c = chunk.counts[0][chunk.ids]
        return pa.Table.from_arrays(
            [chunk.doc_ids, pa.array(chunk.held), pa.array(chunk.sizes),
             pa.array(chunk.sums(c > 0).astype(np.int64)), pa.array(np.full(len(chunk.sizes), total, dtype=np.int64)),
             pa.array(chunk.sums(np.log10((c + 1) / (total + distinct + 1)))),
             pa.array(chunk.sums(np.log10(chunk.probabilities(total, distinct, discounts))))], schema=SCORED)

    return trained.docs.groupBy("chunk").cogroup(trained.answers.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
