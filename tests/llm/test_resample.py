import hashlib
import math
import random
import re
import zlib
from collections import Counter

from conftest import prose

from shelfspark.llm import resample

BUCKETS = 10_000


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % BUCKETS for r in runs)


def brute(rows, target):
    """(id, n_features, weight, score, rank) by the definition."""
    bags = [bag(t) for _, t in rows]
    s, t = sum((b for _, b in bags), Counter()), sum((bag(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)]
    out = []
    for (i, _), (n, b) in zip(rows, bags):
        weight = sum(gain[k] * c for k, c in b.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[:5 * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def rows_of(df):
    return [tuple(r)[:5] for r in df.collect()]


def corpus(texts):
    rng = random.Random(5)
    big = 1152921504606846977
    more = [prose(rng, rng.randrange(15, 60)) for _ in range(200)] + ["ß" * 70 + " É9 x" + "y" * 64 + " z Ünï-cödé 漢字 " * 9, "\0a\0b A\tB" * 9]
    return [(big + k, t) for k, t in enumerate(more)] + [(k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (None, None), (3, texts[5])]


def test_matches_brute_force(spark, texts, empty, monkeypatch):
    rows, target = corpus(texts), [texts[5], None, prose(random.Random(9), 300)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, weight int, rank string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    want = sorted(brute(rows, target), key=key)
    assert sorted(rows_of(resample.resampling_report(frame, goal)), key=key) == want
    assert sum(r[4] is not None for r in want) >= 8
    none = spark.createDataFrame([], "text string")
    assert sorted(rows_of(resample.resampling_report(frame, none)), key=key) == sorted(brute(rows, []), key=key)
    assert resample.resampling_report(empty, goal).count() == 0


def test_small_blocks_and_batches_change_nothing(monkeypatch, texts):
    data = [(t or "").encode() for t in texts[:16]]
    table = resample._shift_table()

    def counted():
        return sorted((d, int(c), n) for doc, crc, n in resample.features(data, table) for d, c in zip(doc.tolist(), crc.tolist()))

    want = counted()
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(resample, "BLOCK", size)
        assert counted() == want


def test_drawn_documents_keep_their_columns(spark, texts):
    frame = spark.createDataFrame([(*r, "z") for r in corpus(texts)], "doc_id long, text string, rank string")
    goal = frame.select("text").limit(3)
    drawn = resample.resample(frame, goal)
    ids = {r.doc_id for r in resample.resampling_report(frame, goal).where("rank IS NOT NULL").collect()}
    assert drawn.columns == frame.columns and {r.doc_id for r in drawn.collect()} == ids


def test_ties_go_to_the_smaller_id_and_every_copy_has_its_rank(spark):
    rows = [(k // 2, 30, 90, 7, 7) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    got = sorted((r.rank, r.doc_id) for r in resample.draw(frame).where("rank IS NOT NULL").collect())
    assert got == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]
