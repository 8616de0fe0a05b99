import random

import pytest
from helpers import prose, rows  # noqa: F401


@pytest.fixture(scope="session")
def texts() -> list:
    """Edge cases and families of copies: nulls, empties, ties, repeats, very long texts."""
    rng = random.Random(11)
    base = [prose(rng, 180) for _ in range(4)]
    passage = prose(rng, 90)
    near = base[0].split()
    near[90] = "changed"
    return [
        None, "", " \t\n", "word", "Two words", base[0], base[0], base[0].upper(), " ".join(near), base[1],
        prose(rng, 30) + " " + passage + " " + prose(rng, 40), passage + " " + prose(rng, 55), base[2] + "\n" + base[2],
        "a" * 3000, "ab" * 1200, prose(rng, 9000), "É" * 500 + base[3], base[3], "x\n" * 300, "same line here\n" * 40,
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with a null and a repeated id and columns whose names clash with the operators' own."""
    ids = [*range(len(texts) - 2), None, 5]
    data = [(i, t, "en", f"s{k % 2}", None if t is None else len(t), k, "z", 1.5)
            for k, (i, t) in enumerate(zip(ids, texts))]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, _row double")
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
