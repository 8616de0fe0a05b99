import hashlib
import random
from collections import Counter

import numpy as np

from shelfspark.llm import anchors, induced, suffix


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, width=400):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], width)))
    got = Counter(tuple(r) for r in suffix.repeats_report(docs, width).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want


def test_report_matches_brute_force(docs):
    check(docs)


def test_narrower_windows_match_too(docs):
    check(docs, 200)


def test_crowded_grams_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "FINE_BYTES", 1000)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 4000)
    check(docs)


def test_near_copies_with_edits_everywhere(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    texts = []
    for k in range(40):
        t = list(base[rng.randrange(300):])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("xyzé")
        texts.append("".join(t))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_suffix_array_and_repeated_starts():
    rng = random.Random(2)
    for _ in range(120):
        letters = rng.choice([b"ab", b"a", b"abcdefg ", bytes(range(256))])
        t = np.array([*rng.choices(range(1, 5), k=rng.randrange(1, 80)), 0])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert induced._by_doubling(t).tolist() == want
        s_type = induced._types(t)
        samples = np.flatnonzero(np.concatenate(([False], s_type[1:] & ~s_type[:-1])))
        is_sample = np.isin(np.arange(len(t)), samples)
        first = induced._induce(t, s_type, samples, 5)
        names = induced._names(t, samples, first[is_sample[first]])
        assert induced._induce(t, s_type, samples[induced._by_doubling(names)], 5).tolist() == want
        width = rng.choice([1, 3, 20])
        base = bytes(rng.choices(letters, k=120))
        pieces = [base[rng.randrange(60):rng.randrange(60, 121)] for _ in range(rng.randrange(1, 6))]
        seen = Counter(p[k:k + width] for p in pieces for k in range(len(p) - width + 1))
        got = [x.tolist() for x in induced.repeated_starts(pieces, width)]
        assert got == [[k for k in range(len(p) - width + 1) if seen[p[k:k + width]] > 1] for p in pieces]


def test_large_shard_is_induced():
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoin", k=rng.randrange(2, 8))) for _ in range(500)]
    text = " ".join(rng.choices(words, k=30_000)).encode()
    t = np.append(np.frombuffer(text, dtype=np.uint8).astype(np.int64) + 1, 0)
    order = induced.suffix_array(t, 257)
    assert len(t) > 257 * 256  # by buckets, not by doubling alone
    keys = [bytes(text[i:i + 60]) for i in order[:2000]]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(t)))


def test_equal_windows_own_equal_anchors():
    rng = random.Random(5)
    shared = bytes(rng.choices(b"abcdefghij klm", k=700))
    for a, b in ((b"", b"zz"), (b"q" * 900, shared[:30]), (b"a" * 50, b"")):
        where = []
        for lead in (a, b):
            data = lead + shared
            gram, lo, n, dist = anchors.owned_windows(data)
            owner = {}
            for g, start, count, d in zip(gram, lo, n, dist):
                owner |= {start + k: (g, d - k) for k in range(count)}
            assert sorted(owner) == list(range(max(len(data) - 399, 0)))
            where.append([owner[len(lead) + k] for k in range(len(shared) - 399)])
        assert where[0] == where[1]


def test_removal_keeps_columns_and_counts(docs, empty):
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)
    assert suffix.repeats_report(empty).count() == 0 and suffix.remove_repeats(empty).count() == 0


def test_no_task_holds_a_crowded_core(spark, monkeypatch):
    """A passage in many texts that differ before and after it: each deal that a task settles is bounded."""
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=420))
    texts = ["".join(rng.choices("ijklm ", k=60)) + passage + "".join(rng.choices("nopqr ", k=60)) for _ in range(30)]
    monkeypatch.setattr(suffix, "FINE_BYTES", 4000)
    deals, by_deal = [], suffix._by_deal

    def watched(pieces, window):
        deals.extend(r.b for r in pieces.selectExpr("deal", "octet_length(piece) AS n").groupBy("deal").agg({"n": "sum"}).toDF("deal", "b").collect())
        return by_deal(pieces, window)

    monkeypatch.setattr(suffix, "_by_deal", watched)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert max(deals, default=0) <= 4000


def passage_counts(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for k in range(len(d) - width + 1):
            if seen[d[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        out.append((sum(gone), sum(1 for a, b in zip(b"\0" + gone, gone) if b > a)))
    return out


def check_both(docs, window=400, passage=200):
    rows = docs.select("doc_id", "text").collect()
    texts = [r.text for r in rows]
    want = Counter((r.doc_id, *b, *p) for r, b, p in zip(rows, brute(texts, window), passage_counts(texts, min(passage, window))))
    got = suffix.repeats_report(docs, window, passage)
    assert got.columns[-2:] == ["n_passage_bytes", "n_passages"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_passages_below_the_window_are_counted(spark):
    """Passages of 51 words in two documents, shorter than the window: nothing goes, but they are told."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 8)))
    own = lambda n: [word() for _ in range(n)]
    texts = [" ".join(own(150)) for _ in range(20)]
    for _ in range(10):
        passage = own(51)
        assert 200 <= len(" ".join(passage)) < 390
        texts += [" ".join(own(rng.randrange(40, 90)) + passage + own(rng.randrange(40, 90))) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix.repeats_report(docs).collect()}
    assert all(r.n_removed == 0 for r in rows.values())
    assert all((rows[k].n_passage_bytes > 0) == (k >= 20) and rows[k].n_passages == (k >= 20) for k in rows)
    check_both(docs)


def test_both_widths_match_brute_force(spark, docs, monkeypatch):
    check_both(docs)
    check_both(docs, 100, 200)
    rng = random.Random(22)
    base = "".join(rng.choices("abcdefgh é", k=1500))
    texts = [base[:250], base[:250], base[:450], base[:450], None, ""]  # whole copies with and without a window
    for k in range(30):
        t = list(base[rng.randrange(400):rng.randrange(700, 1500)])
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t) + base[:rng.randrange(500)])
    near = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_both(near)
    monkeypatch.setattr(suffix, "FINE_BYTES", 1000)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 4000)
    check_both(near, 300, 120)
