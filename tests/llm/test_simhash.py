import random
import re

import xxhash

from shelfspark.llm import simhash
from shelfspark.llm.components import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_components_match_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    group = classes(fps)
    smallest = {g: min((r.doc_id for r, h in zip(rows, group) if h == g and r.doc_id is not None), default=None) for g in group}
    want = sorted((str(r.doc_id), f"{f:016x}", str(smallest[g])) for r, f, g in zip(rows, fps, group))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_report(docs).collect())
    assert got == want


def test_links_are_complete_with_and_without_finer_anchors(spark, monkeypatch):
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    want = classes(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for fine in (simhash.FINE, 2):
        monkeypatch.setattr(simhash, "FINE", fine)
        root = {r.node: r.root for r in components(simhash.links(frame)).collect()}
        mine = [root.get(s, s) for s in signed]
        for i in range(len(fps)):
            for j in range(i):
                assert (want[i] == want[j]) == (mine[i] == mine[j])


def test_deduplicate_keeps_one_of_each_component(docs, empty):
    kept = simhash.deduplicate(docs)
    assert kept.schema == docs.schema
    # A repeated doc_id may name two components, so the components are counted, not their names.
    assert kept.count() == len(set(classes([fingerprint(r.text) for r in docs.collect()])))
    assert simhash.simhash_report(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
