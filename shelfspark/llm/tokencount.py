"""Token counts by a compiled finite-state tokenizer.

A deterministic transducer reads character classes and marks where
the pre-tokens start (``_rules`` is the word tokenizer's split pattern as states and
transitions). A batch of texts is cut into chunks of equal length; every chunk's state map (end
state and number of starts for each possible start state) is computed at once, the maps
compose through a parallel prefix scan, and a second pass from the states so
known emits the starts. The number of tokens of a pre-token does not come from a transducer: the
``tokenizers`` library applies the file's own merges to each pre-token when it is first seen, and
a memo in the worker process keeps the counts, up to a bound.

The counts are those of the ``tokenizers`` library: special strings in a text
count one token each and end what surrounds them.

Defined results: a null or empty text has 0 bytes and 0 tokens; very long texts
are whole (chunks do not end words); repeated rows each get their row; an empty
table gives no rows; only ``doc_id`` and ``text`` are read of the input's columns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import tokenizing
from shelfspark.llm.common import id_text, per_process, text_of, with_long_id

LIMIT = 2048
BATCH_CHARS = 1 << 21
CHUNK = 512
COMPILED = 500_000  # bound of the compiled transitions kept, not of the texts

# Character classes of the split pattern, and the letters its contractions use.
SPACE, LETTER, NUMBER, OTHER, APOSTROPHE = range(5)
SINGLE, R, V, L, E = range(5, 10)  # SINGLE: s t m d
# States: at a fresh start, in a run of letters or of others, and inside a possible contraction.
FRESH, LETTERS, OTHERS, SAW, SAW_R, SAW_V, SAW_L = range(7)
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts) for [state, class]."""
    to = np.zeros((7, 10), dtype=np.int8)
    out = np.zeros((7, 10), dtype=np.int8)
    for c in range(10):
        letter = c == LETTER or c >= SINGLE
        run = LETTERS if letter else {SPACE: FRESH, NUMBER: FRESH, OTHER: OTHERS, APOSTROPHE: SAW}[c]
        starts = 0 if c == SPACE else HERE
        for state in (FRESH, LETTERS, OTHERS, SAW):
            to[state, c], out[state, c] = run, starts
        for state in (SAW_R, SAW_V, SAW_L):  # no contraction after all: letters since the last character
            to[state, c], out[state, c] = run, BEFORE | (0 if letter else starts)
        if letter:
            out[LETTERS, c] = 0
    for state in (OTHERS, SAW):  # an apostrophe or another sign goes on with the run
        for c in (OTHER, APOSTROPHE):
            to[state, c], out[state, c] = OTHERS, 0
    for c, state in ((SINGLE, FRESH), (R, SAW_R), (V, SAW_V), (L, SAW_L)):
        to[SAW, c], out[SAW, c] = state, 0
    for state, c in ((SAW_R, E), (SAW_V, E), (SAW_L, L)):
        to[state, c], out[state, c] = FRESH, 0
    return to, out


def _class_table() -> np.ndarray:
    """Class of every code point, built once in each worker process."""
    cache = per_process()
    if "classes" not in cache:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for point in range(0x110000):
            kind = unicodedata.category(chr(point))[0]
            if kind in "LN":
                table[point] = LETTER if kind == "L" else NUMBER
        # White space by the Unicode property (fixed values).
        for low, high in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
            table[low:high + 1] = SPACE
        for letters, kind in (("'", APOSTROPHE), ("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
            for letter in letters:
                table[ord(letter)] = kind
        cache["classes"] = table
    return cache["classes"]


def token_starts(classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of a class string that ends in a space."""
    to, out = _rules()
    n = len(classes)
    chunks = -(-n // CHUNK)
    lanes = np.full(chunks * CHUNK, SPACE, dtype=np.uint8)
    lanes[:n] = classes
    lanes = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
    # State map of every chunk: where each of the 7 states ends up.
    flat_to = to.ravel()
    maps = np.tile(np.arange(7, dtype=np.int8), (chunks, 1))
    for step in lanes:
        maps = flat_to[maps.astype(np.intp) * 10 + step[:, None]]
    # Parallel prefix scan: after round k a map covers 2^k chunks.
    reach = 1
    while reach < chunks:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.concatenate(([FRESH], maps[:-1, FRESH])).astype(np.intp)
    marks = np.empty((CHUNK, chunks), dtype=np.int8)
    flat_out = out.ravel()
    for k, step in enumerate(lanes):
        at = state * 10 + step
        marks[k] = flat_out[at]
        state = flat_to[at].astype(np.intp)
    marks = marks.T.ravel()[:n]
    here = (marks & HERE) > 0
    here[:-1] |= (marks[1:] & BEFORE) > 0
    return np.flatnonzero(here)


class _Emissions(dict):
    """Pre-token -> emitted tokens; a missing transition is compiled from the merge table."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        self.letters = tokenizing.byte_letters()

    def __missing__(self, word: str) -> int:
        count = len(self.tokenize("".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))))
        if len(self) < COMPILED:
            self[word] = count
        return count


def normalised(text: str) -> str:
    """Composed and lower-cased character by character (no final-sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def count_all(path: str, texts: list[str]) -> np.ndarray:
    """Number of tokens of each text."""
    tokenizer = tokenizing.load(path)
    cache = per_process()
    emissions = cache.setdefault(("emissions", path), None) or _Emissions(tokenizer)
    cache["emissions", path] = emissions
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    extra = np.zeros(len(texts), dtype=np.int64)
    parts = []
    for k, text in enumerate(texts):
        for special in specials:
            if special in text:
                extra[k] += text.count(special)
                text = text.replace(special, " ")
        parts.append(normalised(text) + " ")  # the space ends the text's last pre-token
    whole = "".join(parts)
    if not whole:
        return extra
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    classes = _class_table()[points]
    starts = token_starts(classes)
    space = classes == SPACE
    gaps = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    stops = np.minimum(np.append(starts[1:], len(whole)), gaps[np.searchsorted(gaps, starts)]) if len(starts) else starts
    emitted = np.fromiter(map(emissions.__getitem__, [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())]),
                          dtype=np.int64, count=len(starts))
    edges = np.cumsum([0, *map(len, parts)])
    total = np.concatenate(([0], np.cumsum(emitted)))
    return extra + np.diff(total[np.searchsorted(starts, edges)])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, counts, low = rows["text"].tolist(), [], 0
            while low < len(texts):  # bounded memory: so many characters at once, one text at least
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH_CHARS):
                    size += len(texts[high])
                    high += 1
                counts.append(count_all(path, texts[low:high]))
                low = high
            if counts:
                yield pd.DataFrame({"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": np.concatenate(counts)})

    counted = docs.select(id_text(), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text")) \
        .mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return with_long_id(counted).withColumn("over_limit", F.col("n_tokens") > limit)
