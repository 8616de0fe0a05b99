import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from shelfspark.llm import pieces, tokencount

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'s", "'t", "'re", "'r", "'v", "'l", "'ll", "'", "''", " ", "  ", "\n", "a", "Re", "9", "½", "É", "é", "ΑΣ ", "İ",
         " ", "\x1c", "​", "<|endoftext|>", "<|", "!", "漢字", "😀", "ﬁ", "▁", "the", "tion", "<s>", "<0x41>", "    ", "\0", "==="]


def mixed(seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(800)] + [None, "", "x" * 2000, "ab " * 3000]


def test_counts_are_the_librarys(spark, empty):
    texts = mixed(1)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(BPE)
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for r in tokencount.token_counts(frame, BPE).collect():
        assert r.n_tokens == want[r.doc_id] and r.over_limit == (want[r.doc_id] > 2048)
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
    assert tokencount.token_counts(empty, BPE).count() == 0


def test_chunks_compose(monkeypatch):
    tokenizer = Tokenizer.from_file(BPE)
    texts = [t or "" for t in mixed(2)]
    monkeypatch.setattr(tokencount, "CHUNK", 3)  # words and contractions cross chunks
    got = tokencount.count_all(BPE, texts).tolist()
    assert got == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_are_the_librarys(spark, empty):
    texts = [t or "" for t in mixed(3)]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    packed = pieces.encode_all(PIECES, texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in packed] == model.encode(texts)
    assert [pieces.decode(PIECES, x) for x in packed] == [model.decode(x) for x in model.encode(texts)]
    frame = spark.createDataFrame([(1, None), (None, "plain text, round trip. Ünï 漢字"), (3, "")], "doc_id long, text string")
    rows = pieces.encode_documents(frame, PIECES).collect()
    assert all(r.round_trip for r in rows) and {r.doc_id: r.n_ids for r in rows}[1] == 0
    assert pieces.encode_documents(empty, PIECES).count() == 0


def test_occurrence_ranges():
    text = np.array([1, 2, 1, 2, 1, 3, 0])
    order = np.array(sorted(range(7), key=lambda i: text[i:].tolist()))
    low, high = pieces.occurrences(text, order, np.array([[1, 2], [1, -1], [3, 1], [2, 1]]), np.array([2, 1, 2, 2]))
    assert [sorted(order[a:b].tolist()) for a, b in zip(low, high)] == [[0, 2], [0, 2, 4], [], [1, 3]]


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    asked, keep = [], pieces.encode_units
    monkeypatch.setattr(pieces, "encode_units", lambda model, units: asked.extend(units) or keep(model, units))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "qzxa qzxa, qzxa### qzxa.\nQzxb qzxa!?"
    ids = pieces.encode_all(PIECES, [text])[0]
    assert np.frombuffer(ids, dtype="<u4").tolist() == model.encode(text) and pieces.decode(PIECES, ids) == model.decode(model.encode(text))
    assert sum("qzxa" in u for u in asked) == 1
    rng = random.Random(4)
    pool = ["a", "É", "z9", ".", "##", "'", "'s", "\n", " ", "\t", "_", "-", "漢", " ", "▁", "the", "ing"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(3000)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in pieces.encode_all(PIECES, texts)] == model.encode(texts)
