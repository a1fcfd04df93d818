import numpy as np

from strandline.llm import ann


def brute(vectors, k, every):
    ids = [i for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = {i: np.array(v, float) for i, v in vectors if i in set(ids)}
    out = {}
    for q in [i for i in ids if i % every == 0]:
        near = [(-(good[q] @ good[i] / (np.linalg.norm(good[q]) * np.linalg.norm(good[i]))), i) for i in ids if i != q and len(good[i]) == len(good[q])]
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def test_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    vectors = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=24))]) for i in range(1500)]
    vectors += [(2000 + i, vectors[0][1]) for i in range(300)]  # a large group of copies
    vectors += [(5000, None), (5010, [0.0] * 24), (5020, [1.0, None] * 12), (5030, [float("nan")] * 24), (5040, [float("inf")] * 24), (5050, []), (6000, [1.0, 2.0]), (6001, [2.0, 1.0]), (6010, [1.0, 0.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumnsRenamed({}).selectExpr("*", "'x' as v", "1 as shard", "0 as rank")
    rows = ann.nearest(table, table.filter("vec_id % 10 = 0"), shard_size=600).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
    want = brute(vectors, 5, 10)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) > 0.95
    for q in (2000, 2010):
        assert got[q] == [i for i in (0, *range(2000, 2300)) if i != q][:5]
    assert got[6000] == [6001, 6010]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none).count() == 0


def test_flat_arrays_give_the_same_graph():
    v = np.random.default_rng(1).normal(size=(400, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = ann.Graph(v)
    again = ann.Graph.of(v, graph.flat(), ann.LINKS)
    assert (graph.search(v[:20], 10) == again.search(v[:20], 10)).all()
    assert (graph.layers[0][1] >= 0).any(axis=1).all()
