"""Integer ids beyond 2^53 beside a null id come back as they are."""

import public_tokenizers

from shelfspark.llm import html, packing, pieces, tokencount

IDS = [1152921504606846977, None, -9007199254740995, 9223372036854775807, 0]


def test_large_ids_beside_a_null(spark):
    texts = ["one two three", None, "words", "ab " * 900, ""]
    frame = spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").repartition(1)
    bpe, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    want = sorted(IDS, key=str)
    for out in (packing.pack_documents(frame, bpe), pieces.encode_documents(frame, model),
                tokencount.token_counts(frame, public_tokenizers.path("word_bpe_49k.json"))):
        assert sorted({r.doc_id for r in out.collect()}, key=str) == want
        assert dict(out.dtypes)["doc_id"] == "bigint"
    pages = spark.createDataFrame([(i, "http://a.example/x", "<p>some words here</p>") for i in IDS],
                                  "page_id long, url string, html string").repartition(1)
    assert sorted([r.page_id for r in html.extract_pages(pages).collect()], key=str) == want
