import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfspark.llm import packing, tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def verify(docs, pieces, window):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs.items()}
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        mine = ids[p.doc_id][p.start:p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length == len(mine) > 0
        packed = np.array(mine, dtype="<u4").tobytes()
        assert bytes(p.ids) == packed and p.ids_crc32 == zlib.crc32(packed)
        by_doc[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for doc, all_ids in ids.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == len(all_ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0  # the last sequence is cut at powers of two


def test_pieces_cover_every_document(spark, texts, empty):
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 7) for i, t in docs.items()], "doc_id long, text string, ids int").repartition(3)
    for window in (64, 2048):
        verify(docs, packing.pack_documents(frame, PATH, window).collect(), window)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_plan_places_every_remainder_once():
    rng = np.random.default_rng(1)
    window = 64
    hist = rng.integers(0, 400, window)
    hist[0] = 5
    plan = packing.Plan(hist.astype(np.int64), 3, window)
    used = defaultdict(list)
    whole = 0
    for length in range(1, window):
        for rank in range(hist[length]):
            parts = plan.place(length, rank)
            assert sum(p[1] for p in parts) == length
            whole += len(parts) == 1
            for _, size, sequence, offset in parts:
                used[sequence].append((offset, size))
    sizes = []
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        sizes.append(at)
    assert min(used) == 3 and len(used) == max(used) - 2
    assert all(s == window or s & (s - 1) == 0 for s in sizes)
    assert whole > 0.8 * hist[1:].sum()  # most remainders stay whole, also with a flat histogram


def test_unit_cache_gives_the_library_ids():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["a  b", " lead", "trail ", "x.\nY z,\n\nw", "it's 'll <|endoftext|>, É ñ. \t\n q", "", "\x1c a", "don't.!? ok", "漢字, 😀."]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in tokenizing.encode_all(PATH, texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_merged_once_whatever_closes_it():
    tokenizer = tokenizing.load(PATH)
    units, asked = tokenizing.Units(tokenizer, "I"), []
    units.encode = lambda part, **how: asked.append(part) or tokenizer.encode(part, **how)
    text = "qzxa qzxa.\nQzxb qzxa### (qzxa, <|endoftext|>.\n\n qzxa's x<|endoftext|> qzxa!?\nÉqz"
    first, *rest = tokenizing.units(text)
    ids = b"".join([units.part(first), *[units[u] for u in rest]])
    assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not {" qzxa.\nQzxb", " qzxa###", " qzxa!?\nÉqz"} & set(asked)
    # No order of words and marks is new to the library.
    rng = random.Random(4)
    pool = ["a", "É", "z9", ".", "##", "'", "'s", "\n", " ", "\t", "<|endoftext|>", "_", "-", "漢", " "]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(3000)]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in tokenizing.encode_all(PATH, texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
