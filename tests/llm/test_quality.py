import re
from collections import Counter

from shelfspark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {k, k + 1, k + 2}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_counts_match_brute_force(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.quality_report(docs).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())


def test_adaptive_fences_reject_junk_and_keep_clean(spark):
    clean = " ".join(f"word{i} other{i}" for i in range(60))
    symbols = " ".join(f"w{i}### o{i}$$$" for i in range(60))
    data = [(i, clean + f" n{i}", "en", "a") for i in range(200)] + [(900 + i, symbols + f" n{i}", "en", "a") for i in range(10)]
    data += [(990, clean, "fr", "rare"), (991, symbols, "fr", "rare")]  # a small group uses the coarser sketches
    out = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(200)) and not any(out[900 + i] for i in range(10))
    assert out[990] and not out[991]


def test_sketches_merge_exactly(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS g", "1 AS one", *[f"id AS {m}" for m in quality.FENCES])
    merged = quality.merge_sketches(quality.quantile_sketches(rows, ["g"]), [])
    whole = quality.quantile_sketches(rows, [])
    assert {(r.metric, r.bin, r.n) for r in merged.collect()} == {(r.metric, r.bin, r.n) for r in whole.collect()}
    assert all(b.bin <= 4999 for b in whole.collect())


def test_filter_keeps_columns_and_empty_tables(docs, empty):
    kept = quality.filter_documents(docs)
    assert kept.schema == docs.schema
    assert kept.count() == quality.quality_report(docs).where("kept").count()
    assert quality.quality_report(empty).count() == 0 and quality.filter_documents(empty).columns == empty.columns
