import hashlib
import random

import xxhash
from conftest import prose
from pyspark.sql import functions as F

from shelfspark.llm import prints


def fingerprint(text):
    words = (text or "").encode().split()
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = []
        for k in range(len(words) - 2):
            h = 42
            for w in words[k:k + 3]:
                h = xxhash.xxh64_intdigest(w, h)
            hashes.append(h)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows):
    def tie(t):
        return signed(xxhash.xxh64_intdigest((t or "").encode(), 42))

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])), reverse=True)
    fps = [fingerprint(t) for _, t in order]
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        e, f, g = fingerprint(edited), fps[k], fps[(k + 1) % len(order)]
        near = None if i is None or i % 50 else sum((f ^ x).bit_count() <= 3 for x in fps) - 1
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}",
                    1 - (e ^ f).bit_count() / 64, 1 - (f ^ g).bit_count() / 64, near))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def check(spark, rows, parts):
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, fp int, place string")
    got = [tuple(r) for r in prints.fingerprint_report(frame.repartition(parts)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_report_matches_brute_force(spark, texts, empty):
    rng = random.Random(6)
    base = [prose(rng, 160) for _ in range(3)]
    more = [*texts, *[b + " x" * (k % 3) for k in range(6) for b in base], "😀 É" * 30, "a b"]
    big = 1152921504606846900
    rows = [(k * 5, t) for k, t in enumerate(more)] + [(big + k, prose(rng, rng.randrange(40))) for k in range(120)]
    rows += [(None, base[0]), (None, None), (7, base[1]), (7, base[1]), (7, base[2]), (-50, base[0])]
    check(spark, rows, 5)
    check(spark, [(3, "only one, its own successor")], 1)
    assert prints.fingerprint_report(empty).count() == 0


def test_counters_are_emptied_in_time(spark, monkeypatch):
    text = prose(random.Random(1), 500)
    monkeypatch.setattr(prints, "FULL", 7)
    frame = spark.createDataFrame([(text,), ("",)], "text string")
    got = [r.fp for r in frame.select(prints.fingerprint(F.col("text")).alias("fp")).collect()]
    assert got == [signed(fingerprint(text)), 0]


def test_block_tables_find_all_within_any_radius(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for radius in (0, 1, 3, 5):
        got = sorted(tuple(r) for r in prints.near_fingerprints(frame, frame, radius).collect())
        assert got == sorted((signed(a), signed(b), (a ^ b).bit_count()) for a in fps for b in fps
                             if (a ^ b).bit_count() <= radius)


def test_no_python_on_the_main_path(spark, docs):
    plan = prints.fingerprint_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
