"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut before each space that follows another character; no piece of the
model crosses such a cut (checked when the model is loaded), so only the distinct units of a
batch are encoded. They are concatenated and indexed by a suffix array. All pieces
are binary-searched in it together, character by character, which gives each
piece's range of occurrences. The occurrences are the edges of the units'
lattices; sorted by position they are relaxed from left to right.

The model is a BPE model, whose encoding isn't the lattice's best sum of scores. What
is relaxed is the BPE encoding of each prefix: it is unique, and it ends in a piece t
exactly if the prefix before t is encoded with a last piece s such that the pair
(s, t) stays a pair when its own characters are merged. So an edge may extend a position
if the pair of the position's last piece and its own is stable (memoised).
Characters that no piece has fall back to bytes. Runs of spaces, whose pieces
tie in score, are merged directly.

Decoding joins the pieces, turns byte pieces into text and drops the space put
in front.

Defined results: a null or empty text has no ids and decodes to the empty text;
very long texts are whole; repeated rows each get their row; an empty table
gives no rows; only ``doc_id`` and ``text`` are read of the input's columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import induced
from shelfspark.llm.common import id_text, per_process, text_of, with_long_id

MARK = "▁"
_BOUNDS = re.compile(rf"(?<=\w)(?=[^\w{MARK}])|(?<=[^\w{MARK}])(?=\w)")
CACHED_UNITS = 400_000  # bounds of the memos, not of the texts
CACHED_PARTS = 800_000
CACHED_PAIRS = 1_000_000
BATCH_CHARS = 1 << 22
NEVER = float("-inf")
LONE, START, NOT_REACHED = -1, -2, -3  # in the place of a piece's id


class Stable(dict):
    """Whether merging the characters of the pieces a and b leaves that pair; of a * pieces + b, found when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, pair: int) -> bool:
        a, b = (self.model.names[i] for i in divmod(pair, len(self.model.names)))
        self[pair] = a + b not in self.model.score and self.model.merge(a + b) == [a, b]
        return self[pair]


class Model:
    """Pieces of a model file, as the matcher needs them."""

    def __init__(self, path: str):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [loaded.id_to_piece(i) for i in range(loaded.get_piece_size())]
        self.byte_of = {i: int(n[3:-1], 16) for i, n in enumerate(self.names) if loaded.is_byte(i)}
        self.bytes = {b: i for i, b in self.byte_of.items()}
        self.control = {i for i in range(len(self.names)) if loaded.is_control(i)}
        self.unknown = loaded.unk_id()
        skip = self.control | set(self.byte_of) | {self.unknown}
        self.ids = {n: i for i, n in enumerate(self.names) if i not in skip and not loaded.is_unused(i)}
        self.score = {n: loaded.get_score(i) for n, i in self.ids.items()}
        if any(MARK in n.lstrip(MARK) for n in self.ids):
            raise ValueError("a piece crosses the start of a word: units cannot be encoded alone")
        # Neighbouring characters that some piece holds: only between these can a merge reach over.
        self.joined = {n[k:k + 2] for n in self.ids for k in range(len(n) - 1)}
        # Pieces that merging never leaves standing take no part in the lattice.
        self.pieces = [n for n in self.ids if MARK * 2 not in n and self.merge(n) == [n]]
        # What each id stands for when decoded.
        self.spelled = [name.replace(MARK, " ").encode("utf-8") for name in self.names]
        self.spelled[self.unknown] = " ⁇ ".encode()
        for i in self.control:
            self.spelled[i] = b""
        for i, b in self.byte_of.items():
            self.spelled[i] = bytes([b])
        self.stable = Stable(self)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbouring pair first, the leftmost among equals."""
        parts, rate = list(text), self.score.get
        scores = [rate(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NEVER:
            k = scores.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = rate(parts[k - 1] + parts[k], NEVER)
            if k < len(scores):
                scores[k] = rate(parts[k] + parts[k + 1], NEVER)
        return parts

    def cut(self, unit: str) -> list[str]:
        """The unit cut between letters and other characters where no merge reaches over, so that a word is encoded once
        whatever marks follow it."""
        if unit[1:].isalpha() or MARK * 2 in unit or "\0" in unit:
            return [unit]
        first, *rest = _BOUNDS.split(unit)
        out = [first]
        for part in rest:
            if out[-1][-1] + part[0] in self.joined:
                out[-1] += part
            else:
                out.append(part)
        return out

    def packed(self, parts: list[str]) -> bytes:
        ids: list[int] = []
        for p in parts:
            if p in self.ids:
                ids.append(self.ids[p])
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        return np.array(ids, dtype="<u4").tobytes()


def load(path: str) -> Model:
    """The model of a file, loaded once in each worker process."""
    cache = per_process()
    if ("pieces", path) not in cache:
        cache["pieces", path] = Model(path)
    return cache["pieces", path]


def occurrences(symbols: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [low, high) of the suffix array whose suffixes start with each piece.

    ``pieces`` holds the pieces' symbols, padded with -1. All pieces are searched together:
    character k narrows the range that the first k characters left.
    """
    low = np.zeros(len(pieces), dtype=np.int64)
    high = np.full(len(pieces), len(order), dtype=np.int64)
    last = len(symbols) - 1
    for k in range(pieces.shape[1]):
        alive = np.flatnonzero((lengths > k) & (low < high))
        want = pieces[alive, k]

        def edge(after: bool) -> np.ndarray:
            """First suffix of the range whose character k is not less (or is greater) than the piece's."""
            a, b = low[alive].copy(), high[alive].copy()
            while (a < b).any():
                mid = (a + b) >> 1
                seen = symbols[np.minimum(order[np.minimum(mid, len(order) - 1)] + k, last)]
                go = (a < b) & ((seen <= want) if after else (seen < want))
                b = np.where((a < b) & ~go, mid, b)
                a = np.where(go, mid + 1, a)
            return a

        low[alive], high[alive] = edge(False), edge(True)
    return low, high


def edges_of(model: Model, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, id) of every occurrence of a piece in the text, and of every character that has none (id LONE)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    alphabet, dense = np.unique(points, return_inverse=True)
    symbols = np.append(dense.astype(np.int64) + 1, 0)
    order = induced.suffix_array(symbols, len(alphabet) + 1)
    number = {chr(p): k + 1 for k, p in enumerate(alphabet.tolist())}
    usable = [p for p in model.pieces if all(c in number for c in p)]
    lengths = np.array([len(p) for p in usable], dtype=np.int64)
    table = np.full((len(usable), int(lengths.max(initial=1))), -1, dtype=np.int64)
    for k, p in enumerate(usable):
        table[k, :len(p)] = [number[c] for c in p]
    low, high = occurrences(symbols, order, table, lengths)
    count = high - low
    piece = np.repeat(np.arange(len(usable)), count)
    at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    ids = np.array([model.ids[p] for p in usable], dtype=np.int64)
    bare = np.array([chr(p) not in model.ids and p != 0 for p in alphabet.tolist()])
    lone = np.flatnonzero(bare[dense])
    return (np.concatenate((at, lone)), np.concatenate((lengths[piece], np.ones(len(lone), np.int64))),
            np.concatenate((ids[piece], np.full(len(lone), LONE))))


def relax(model: Model, edges: tuple[np.ndarray, np.ndarray, np.ndarray], begins: np.ndarray, sizes: np.ndarray,
          total: int) -> np.ndarray:
    """last[p]: id of the last piece of the encoding of its unit up to p.

    Edges are taken by position; those at the same distance from their units' starts go together.
    """
    at, length, ids = edges
    offset = at - begins[np.searchsorted(begins, at, side="right") - 1]
    by_position = np.argsort(offset, kind="stable")
    at, length, ids, offset = at[by_position], length[by_position], ids[by_position], offset[by_position]
    last = np.full(total + 1, NOT_REACHED, dtype=np.int64)
    cuts = np.searchsorted(offset, np.arange(int(sizes.max()) + 1))
    last[begins] = START
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        here = np.arange(low, high)
        before = last[at[low:high]]
        here, before = here[before != NOT_REACHED], before[before != NOT_REACHED]
        good = (before < 0) | (ids[here] < 0)  # nothing merges across a start or a lone character
        ask = np.flatnonzero(~good)
        pairs, which = np.unique(before[ask] * len(model.names) + ids[here[ask]], return_inverse=True)
        good[ask] = np.fromiter(map(model.stable.__getitem__, pairs.tolist()), dtype=bool, count=len(pairs))[which]
        here = here[good]
        last[at[here] + length[here]] = ids[here]
    return last


def encode_units(model: Model, units: list[str]) -> list[bytes]:
    """Packed ids of distinct units or parts of units; those with runs of marks are merged directly."""
    direct = [u for u in units if MARK * 2 in u or "\0" in u]
    done = {u: model.packed(model.merge(u)) for u in direct}
    plain = [u for u in units if u not in done]
    if plain:
        # Index the batch: its units, each followed by a gap that no piece holds.
        text = "\0".join(plain) + "\0"
        sizes = np.array([len(u) for u in plain], dtype=np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        last = relax(model, edges_of(model, text), begins, sizes, len(text))
        width = np.array([len(n) for n in model.names], dtype=np.int64)
        active, p = np.arange(len(plain)), begins + sizes
        found = []
        while len(active):  # one step back in every unit
            ids = last[p]
            p = p - np.where(ids < 0, 1, width[ids])
            found.append((active, p, ids))
            more = p > begins[active]
            active, p = active[more], p[more]
        unit, p, ids = (np.concatenate(x) for x in zip(*found))
        by_text = np.argsort(p)
        unit, p, ids = unit[by_text], p[by_text], ids[by_text]
        ends = np.searchsorted(unit, np.arange(len(plain)), side="right").tolist()
        lone = set(unit[ids < 0].tolist())
        packed = ids.astype("<u4").tobytes()
        begin = 0
        for k, (u, end) in enumerate(zip(plain, ends)):
            if k in lone:
                done[u] = model.packed([text[q] if i < 0 else model.names[i]
                                        for q, i in zip(p[begin:end].tolist(), ids[begin:end].tolist())])
            else:
                done[u] = packed[4 * begin:4 * end]
            begin = end
    return [done[u] for u in units]


_RUNS = re.compile("^ |  |" + MARK)
_CUTS = re.compile("(?<=[^ ])(?= )")


def units_of(text: str) -> list[str]:
    """Units of a text with the space put in front, spaces as marks."""
    if _RUNS.search(text):
        return [u.replace(" ", MARK) for u in _CUTS.split(" " + text.replace(MARK, " "))]
    return [MARK + w for w in text.split(" ")]


def encode_all(path: str, texts: list[str]) -> list[bytes]:
    """Packed ids of each text."""
    model = load(path)
    cache, parts = (per_process().setdefault((name, path), {}) for name in ("piece units", "piece parts"))
    for known, bound in ((cache, CACHED_UNITS), (parts, CACHED_PARTS), (model.stable, CACHED_PAIRS)):
        if len(known) > bound:
            known.clear()
    cut = [units_of(t) if t else [] for t in texts]
    missing = {u: model.cut(u) for u in set().union(*cut) - cache.keys()}
    wanted = sorted(set().union(*missing.values()) - parts.keys())
    parts.update(zip(wanted, encode_units(model, wanted)))
    cache.update((u, b"".join(map(parts.__getitem__, p))) for u, p in missing.items())
    return [b"".join(map(cache.__getitem__, units)) for units in cut]


def decode(path: str, ids: bytes) -> str:
    """The text of packed ids."""
    text = b"".join(map(load(path).spelled.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
    return text.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip, ids) of each document (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, low = rows["text"].tolist(), 0
            while low < len(texts):  # bounded memory: so many characters at once, one text at least
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH_CHARS):
                    size += len(texts[high])
                    high += 1
                ids = encode_all(path, texts[low:high])
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"].iloc[low:high], "n_ids": [len(x) // 4 for x in ids],
                    "ids_crc32": [zlib.crc32(x) for x in ids],
                    "round_trip": [decode(path, x) == t for x, t in zip(ids, texts[low:high])], "ids": ids})
                low = high

    return with_long_id(docs.select(id_text(), text_of().alias("text")).mapInPandas(
        run, "doc_id string, n_ids long, ids_crc32 long, round_trip boolean, ids binary"))
