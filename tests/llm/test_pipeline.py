import hashlib
import re

import public_tokenizers
from test_packing import verify
from test_pii import base
from test_quality import brute as quality_counts
from test_simhash import classes, fingerprint
from test_suffix import brute as repeats

import corpus_pipeline
from shelfspark.llm import packing
from shelfspark.llm.common import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra double"


def cut(texts, width):
    from collections import Counter

    data = [t.encode() for t in texts]
    seen = Counter(d[k:k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        out.append(bytes(c for c, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def redact(text):
    spans = sorted((int(a), int(b), k) for x in base(text) for k, a, b in (s.split(":") for s in x))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"<{k.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_stages_match_brute_force(spark, texts, tmp_path):
    more = [t for t in texts if t] + [texts[5] + " mail ann.b@example.com or +1 (409) 555-8231 now", texts[9] + " 10.1.2.3"]
    rows = [(k, t, "en", "s", len(t), 0.5) for k, t in enumerate(more)] + [(900, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    state = {r[0]: r[1] for r in rows}
    frame = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if name == "packing":
            verify(state, out.collect(), packing.WINDOW)
            break
        assert out.columns == docs.columns
        frame = written(out, f"test-{name}")
        got = {r.doc_id: r.text for r in frame.collect()}
        if name == "quality_rules":
            failed = {i for i, t in state.items() if quality_counts(t)[5]}
            assert not failed & set(got) and len(got) >= 8
            state = {i: state[i] for i in got}
        elif name == "simhash_near_dedup":
            ids = sorted(state)
            group = classes([fingerprint(state[i]) for i in ids])
            state = {min(j for j, h in zip(ids, group) if h == g): None for g in set(group)} and {
                i: state[i] for i in {min(j for j, h in zip(ids, group) if h == g) for g in set(group)}}
        elif name == "suffix_array_dedup":
            ids = sorted(state)
            state = dict(zip(ids, cut([state[i] for i in ids], corpus_pipeline.REPEAT_BYTES)))
        else:
            state = {i: redact(t) for i, t in state.items()}
            assert not any(re.search("ann.b@|555-8231|10.1.2.3", t) for t in got.values())
        assert got == state, name


def test_run_over_a_table(spark, texts, tmp_path):
    rows = [(k, t, "en", "s", len(t), 0.5) for k, t in enumerate(texts) if t]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)
    none = spark.createDataFrame([], COLUMNS)
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_helpers_agree():
    assert repeats([None, "a"], 400)[0][3] == hashlib.sha256(b"").hexdigest()
    assert public_tokenizers.path("byte_bpe_50k.json")
