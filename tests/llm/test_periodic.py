import hashlib
import random
import zlib

import pytest
from conftest import prose

from shelfspark.llm import periodic


def runs_of(w):
    """Every run by the definition: per period the stretches that keep it, smallest period only."""
    out, n = [], len(w)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            unit = w[i:i + length]
            if length >= max(24, 3 * p) and not any(unit[q:] == unit[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(doc_id, text, edit=edited):
    w = edit((text or "").encode().split(), doc_id)
    runs = runs_of(w)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = None
    for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in dropped)).hexdigest())


def repetitive(seed, count):
    """Word strings with nested, broken and shifted repetitions."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, rng.choice([3, 9, 40, 90])))]
            if rng.random() < 0.3:
                unit = unit * rng.randrange(2, 5) + [rng.choice("abcd")]
            words += unit * rng.randrange(1, 6) + unit[:rng.randrange(len(unit) + 1)]
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows(texts):
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    more = repetitive(2, 250) + [" ".join(fibonacci[-1]), "x " * 1500, "a\tb\nc\x0bd " * 300, " ".join("ab" * 300 + "c" + "ab" * 300),
                                 prose(random.Random(4), 700), "Ü  ü " * 40, "a b c " * 7 + "a b c", "a " * 23, "a " * 24]
    big = 1152921504606846977
    return [(k, t) for k, t in enumerate(texts) if t is None or len(t) < 20000] + [(big + k, t) for k, t in enumerate(more)] + [
        (None, "p q r s " * 30), (None, None), (3, more[0]), (3, more[0])]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_matches_brute_force(spark, rows, empty):
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, period int, key string").repartition(4)
    got = sorted((tuple(r) for r in periodic.periodic_report(frame, edit=periodic.replant).collect()), key=key)
    want = sorted((brute(*r) for r in rows), key=key)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 100
    assert periodic.periodic_report(empty).count() == 0


def test_runs_without_an_edit(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id IS NOT NULL AND doc_id <> 3")
    got = sorted(tuple(r) for r in periodic.periodic_runs(frame).collect())
    assert got == sorted((i, *r) for i, t in rows if i not in (None, 3) for r in runs_of((t or "").encode().split()))


def test_tiles_alone_tell_agreement():
    rng = random.Random(8)
    for _ in range(200):
        codes = [rng.randrange(2) for _ in range(rng.randrange(1, 60))]
        at = rng.randrange(len(codes) + 1)
        for low, high, step in ((1, 8, 3), (4, 8, 8)):
            want = []
            for p in range(low, min(high - 1, len(codes) - at) + 1):
                a = b = at
                while a > 0 and codes[a - 1] == codes[a - 1 + p]:
                    a -= 1
                while b + p < len(codes) and b < at + step and codes[b] == codes[b + p]:
                    b += 1
                if b - a >= step:
                    want.append((p, a, b))
            assert periodic.solve_tile(codes, at, low, high, step) == want


def test_batches_and_hot_documents_change_nothing(spark, monkeypatch):
    text = "u v w " * 4000 + "end"
    monkeypatch.setattr(periodic, "BATCH_WORDS", 50)
    frame = spark.createDataFrame([(1, text), (2, "one two"), (3, text)], "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in periodic.periodic_report(frame).collect()}
    assert got == {1: (1, 0, 12000, 3), 2: (0, None, None, None), 3: (1, 0, 12000, 3)}
