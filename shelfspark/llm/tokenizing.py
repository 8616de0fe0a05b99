"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import os
import re
from array import array

from shelfspark.llm.common import per_process

CACHED_UNITS = 600_000  # bound of each of the memo's two generations, not of the texts
BATCH_CHARS = 6 << 20


def load(path: str):
    """The tokenizer of a JSON file, loaded once in each worker process."""
    cache = per_process()
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        cache[path] = Tokenizer.from_file(path)
    return cache[path]


# White space by either library's rules; the pre-tokenizer never lets a space join what precedes it.
_SPACE = r"\s\x1c-\x1f\x85"
_RUNS = re.compile(rf"[{_SPACE}] ")
_CUTS = re.compile(rf"(?<=[^{_SPACE}])(?= )")
# Marks that the pre-tokenizer parts from a letter before them; an apostrophe may open a contraction.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def units(text: str) -> list[str]:
    """Cut a text before every space that follows a non-space.

    Such a cut is always a boundary of the byte-level pre-tokenizer (a token
    holds at most one space, at its start, unless it is white space only), so
    the units are encoded alone without changing an id. The first unit is
    returned as it is, the others without their leading space.
    """
    if _RUNS.search(text):
        first, *rest = _CUTS.split(text)
        return [first, *[r[1:] for r in rest]]
    return text.split(" ")


def _parts(unit: str, marks: str) -> list[str]:
    """Cut a unit where a letter meets closing marks or at a lone line end: boundaries of the pre-tokenizer too."""
    out = []
    for k, line in enumerate(unit.split("\n") if "\n" in unit else [unit]):
        if k:
            out.append("\n")
        out.append(line)
    if len(out) > 1:
        lines = out[::2]
        if lines[0][:1] == " ":
            lines[0] = lines[0][1:]
        if any(not p or p[0].isspace() or p[-1].isspace() for p in lines):
            return [unit]  # runs of white space stay whole
    cut = []
    for p in out:
        word = p.rstrip(marks)
        if len(word) < len(p) and word and word[-1].isalpha() and word[-1] < "\u0250":
            cut += [word, p[len(word):]]
        else:
            cut.append(p)
    return cut


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _is_word(unit: str) -> bool:
    """Latin letters only: letters by every library's tables."""
    return unit.isalpha() and (unit.isascii() or max(unit) < "\u0250")


class Units(dict):
    """The ids of units by what follows their space, packed as native unsigned integers; found when first asked for.

    Letters are one pre-token, with a space or without: they go straight to the merges. ``parts`` keeps what has no space.
    """

    def __init__(self, tokenizer, typecode: str):
        super().__init__()
        self.encode, self.merge, self.typecode = tokenizer.encode, tokenizer.model.tokenize, typecode
        self.letters = byte_letters().__getitem__
        special = "".join(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.marks = "".join(c for c in _MARKS if c not in special)
        self.parts: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older[0].get(unit)
        if ids is None:
            if _is_word(unit):
                ids = self._merged("\u0120" + self._spelled(unit))
            elif _is_word(word := unit.rstrip(self.marks)):
                ids = self[word] + self.part(unit[len(word):])
            else:
                ids = b"".join(map(self.part, _parts(" " + unit, self.marks)))
        self[unit] = ids
        return ids

    def part(self, part: str) -> bytes:
        if part[0] == " " and _is_word(part[1:]):
            return self[part[1:]]
        ids = self.parts.get(part)
        if ids is None:
            ids = self.older[1].get(part)
            if ids is None and _is_word(part):
                ids = self._merged(self._spelled(part))
            elif ids is None:
                ids = array(self.typecode, self.encode(part, add_special_tokens=False).ids).tobytes()
            self.parts[part] = ids
        return ids

    def _spelled(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.letters, word.encode("utf-8")))

    def _merged(self, spelled: str) -> bytes:
        return array(self.typecode, [t.id for t in self.merge(spelled)]).tobytes()

    def forget(self) -> None:
        """Change of generation, when there are too many: what isn't seen until the next one is forgotten."""
        if len(self) + len(self.parts) > CACHED_UNITS:
            self.older = dict(self), self.parts
            self.clear()
            self.parts = {}


def encode_all(path: str, texts: list[str], typecode: str = "I") -> list[bytes]:
    """The ids of each text, packed as native unsigned integers. Units seen lately are not encoded again."""
    process = per_process()
    if ("units", path, typecode) not in process:
        process["units", path, typecode] = Units(load(path), typecode)
    known = process["units", path, typecode]
    find, out, size = known.__getitem__, [], 0
    for text in texts:
        size += len(text)
        if size > BATCH_CHARS:
            size = len(text)
            known.forget()
        first, *rest = units(text)
        out.append(b"".join([*map(known.part, _parts(first, known.marks) if first else ()), *map(find, rest)]))
    known.forget()
    return out
