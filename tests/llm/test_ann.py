import numpy as np

from shelfspark.llm import ann


def brute(ids, x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    return [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != ids[query]][:k]


def answers(frame, queries):
    out: dict = {}
    for r in sorted(ann.nearest_neighbours(frame, queries).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16))])
    ids = rng.permutation(5000)[:len(x)]
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, shard int")
    monkeypatch.setattr(ann, "SHARD", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    got = answers(frame, frame.where("vec_id % 10 = 0"))
    hits = []
    for q in np.flatnonzero(ids % 10 == 0):
        want = brute(ids, x, q, 10)
        mine = got[int(ids[q])]
        assert len(mine) == 10 and mine == sorted(mine, key=lambda p: (p[1], p[0]))
        hits.append(len({v for v, _ in mine} & {v for v, _ in want}) / 10)
    assert np.mean(hits) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    good = [(i, [1.0, 2.0]) for i in range(300)] + [(400, [1.0, 3.0]), (500, [9.0, 9.0]), (600, [1.0, 2.0, 3.0])]
    bad = [(700, None), (701, []), (702, [0.0, 0.0]), (703, [1.0, float("nan")]), (704, [float("inf"), 1.0]), (705, [None, 1.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(good + bad + [(3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = answers(frame, frame.where("vec_id % 100 = 0"))
    assert [v for v, _ in got[0]] == list(range(1, 11)) and [v for v, _ in got[200]] == list(range(10))
    assert got[400][0] == (0, 1.0) and [v for v, _ in got[400]] == list(range(10))
    assert set(got) == {0, 100, 200, 400, 500}  # the only vector of its length finds none
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(none, none).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert answers(few, few) == {0: [(1, 1.0)], 1: [(0, 1.0)]}


def test_shards_grow_with_the_table_and_a_query_meets_few(spark, monkeypatch):
    """Twenty-four times the least shard: four graphs, not twenty-four, and the answers are as near."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SHARD", 50)
    monkeypatch.setattr(ann, "SHARDS", 4)
    written, graphs = ann.written, []
    monkeypatch.setattr(ann, "written", lambda df, name: (graphs.append(written(df, name)), graphs[-1])[1])
    got = answers(frame, frame.where("vec_id % 20 = 0"))
    assert graphs[1].select("shard").distinct().count() == 4 and graphs[1].count() == 1200
    ids = np.arange(1200)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in brute(ids, x, q, 10)}) / 10 for q in range(0, 1200, 20)]
    assert np.mean(hits) >= 0.95
    assert [ann.shard_size(*n) for n in ((100, 64), (10_000, 64), (10 ** 8, 64), (10 ** 8, 4096))] == [50, 2500, 65_536, 1024]
