"""Helpers that tests import. Both conftest files pass them on, whichever of the two `conftest` names when all tests are run."""

import random

WORDS = "the of and to in ouent thion resty anche blent orist ening voste larne quist pedra".split()


def rows(df, *cols):
    """Collected rows as sorted tuples (small test frames only)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def prose(rng: random.Random, n: int) -> str:
    """Invented prose of n words."""
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "ed", str(rng.randrange(50))]) for _ in range(n))
