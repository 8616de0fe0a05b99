import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np

from shelfspark.llm import lm


def tokens(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [b""]


def brute(rows, order, rarity):
    """The same model as nested interpolation, word by word, without an automaton."""
    toks = [tokens(t) for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    train = [t for t, h in zip(toks, held) if not h]
    grams = [Counter(tuple(t[k:k + n]) for t in train for k in range(len(t) - n + 1)) for n in range(1, order + 1)]
    c1 = Counter({g[0]: c for g, c in grams[0].items()})
    total, distinct = sum(c1.values()), len(c1)
    least = -(-total // rarity)
    kept = [{g: c for g, c in grams[0].items() if c >= max(least, 1) or g == (b"",)}]
    kept[0].setdefault((b"",), 0)
    discounts = [lm.discount(sum(c == 1 for c in c1.values()), sum(c == 2 for c in c1.values()))]
    for n in range(2, order + 1):
        cand = {g: c for g, c in grams[n - 1].items() if g[:-1] in kept[-1] and g[1:] in kept[-1]}
        d = lm.discount(sum(c == 1 for c in cand.values()), sum(c == 2 for c in cand.values()))
        good = {g: c for g, c in cand.items() if c >= max(least, 2)}
        if not good:
            break
        kept.append(good)
        discounts.append(d)
    after: dict = {}
    for n in range(2, len(kept) + 1):
        for g, c in kept[n - 1].items():
            after.setdefault(g[:-1], {})[g[-1]] = (c - discounts[n - 1]) / kept[n - 2][g[:-1]]

    def p(history, w):
        if not history:
            if not total:
                return 1.0
            return (c1[w] - discounts[0]) / total if c1[w] else discounts[0] * distinct / total
        arcs = after.get(history, {})
        left = 1 - sum(arcs.values())
        return arcs.get(w, 0.0) + left * p(history[1:], w)

    out = []
    for (i, _), t, h in zip(rows, toks, held):
        base = sum(math.log10((c1[w] + 1) / (total + distinct + 1)) for w in t)
        score, history = 0.0, ()
        for w in t:
            score += math.log10(p(history, w))
            history = (*history, w)[-(order - 1):]
            while history and (len(history) >= len(kept) + 1 or history not in kept[len(history) - 1]):
                history = history[1:]
        out.append((str(i), h, len(t), sum(c1[w] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(out), c1, p


def run(frame, order, rarity):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in lm.score_documents(frame, order, rarity).collect())


def near(a, b):
    return len(a) == len(b) and all(x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-4 and abs(x[6] - y[6]) < 1e-4 for x, y in zip(a, b))


def test_scores_match_plain_interpolation(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for order, rarity in ((3, 200), (2, 3000), (1, 50)):
        assert near(run(docs, order, rarity), brute(rows, order, rarity)[0])


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(["a b", "b c", "c a", "d", f"r{rng.randrange(500)}"], weights=[8, 5, 3, 2, 1], k=60))) for k in range(60)]
    want, c1, p = brute(rows, 3, 300)
    for history in ((), (b"a",), (b"a", b"b"), (b"c", b"a")):
        assert abs(sum(p(history, w) for w in c1) + p(history, b"unseen word") - 1) < 1e-9
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), 3, 300)
    assert near(got, want)
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)


def test_empty_and_untrained(spark, empty):
    assert lm.score_documents(empty).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_every_ngram_seen_twice_has_an_arc(spark, docs):
    """The default model has no threshold that rises with the input; chunks of any size give the same scores."""
    rng = random.Random(9)
    # 'rare pair here' occurs twice among 300,000 training tokens or more.
    rows = [(k, " ".join(rng.choices("abcdefgh", k=3000)) + (" rare pair here" if k in (0, 1, 3, 16) else "")) for k in range(130)]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    assert sum(not held[k] for k in (0, 1, 3, 16)) >= 2 and sum(len(tokens(t)) for (_, t), h in zip(rows, held) if not h) > 300_000
    everything = 10 ** 12
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                       for r in lm.score_documents(frame).collect()), brute(rows, 3, everything)[0])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                 for r in lm.score_documents(docs, chunk_tokens=50).collect())
    assert near(got, brute(rows, 3, everything)[0])


def test_ngrams_travel_in_a_few_bytes(spark, monkeypatch):
    """The tables between the steps hold a row per chunk and bucket, not one per n-gram."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.choices(words, k=1500))) for k in range(40)]
    tables = []
    keep = lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: tables.append(keep(df, name)) or tables[-1])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert lm.score_documents(frame).count() == 40
    n_tokens = 40 * 1501
    assert sum(t.count() for t in tables) < n_tokens / 20
    files = [f for t in tables for f in t.inputFiles()]
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < 12 * n_tokens


def test_keys_are_one_to_one():
    rng = np.random.default_rng(3)
    for histories, words, buckets in ((1, 1, 1), (5, 7, 3), (1 << 30, 1 << 31, 100), (200_000, 90_000, 2048)):
        keys = lm.Keys(histories, words, buckets)
        h, w = rng.integers(0, histories, 5000), rng.integers(0, words, 5000)
        found = keys.of(h, w)
        assert (keys.history(found) == h).all() and len(set(found.tolist())) == len(set(zip(h.tolist(), w.tolist())))
        bucket = keys.bucket(np.sort(found))
        assert (np.diff(bucket) >= 0).all() and 0 <= bucket[0] and bucket[-1] < buckets
    for values in ([], [0], [0, 0, 255, 256], [5, 1 << 40]):
        assert lm.unpacked(lm.packed(np.array(values, np.int64))).tolist() == values
        assert lm.unpacked_sorted(lm.packed_sorted(np.array(values, np.int64))).tolist() == values
