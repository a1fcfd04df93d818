import random

import numpy as np

from strandline.llm import similar


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    docs, parent = [], {}
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([30, 80, 200, 700]))]
        whole = " ".join(text) + " " + shared * (i % 3 == 0)
        docs.append((i, whole))
        for k in range(3):  # near copies of at most one changed word in sixty
            copy = whole.split()
            for _ in range(max(1, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = "changed"
            docs.append((1000 + 10 * i + k, " ".join(copy)))
            parent[1000 + 10 * i + k] = i
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {d: set(similar.shingles(t.encode(), 5).tolist()) for d, t in docs}
    close = [c for c, p in parent.items() if len(sets[c] & sets[p]) / len(sets[c] | sets[p]) >= 0.8]
    assert len(close) > 120
    assert sum(got[c] == got[parent[c]] for c in close) / len(close) >= 0.95
    assert all(got[i] == i for i in range(60))


def test_similarity():
    a, b = np.arange(100, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64)
    assert similar.similarity(a, b) == 50 / 150
    assert similar.similarity(a[:0], a) == 0
    assert similar.similarity(a, a) == 1


def test_odd_rows(spark, odd, none):
    assert similar.groups(none).count() == 0
    assert similar.keep_one(none).count() == 0
    rows = similar.keep_one(odd)
    assert rows.columns == odd.columns
    assert sorted((r.doc_id for r in rows.collect()), key=str) == sorted([-8, 1, 1, 2, 5, 6, 7, None], key=str)  # two different texts under id 1


def exact_groups(docs, least=0.8):
    """doc_id to the least doc_id of its group, by comparing all pairs."""
    sets = {d: set(similar.shingles(t.encode(), 5).tolist()) for d, t in docs}
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both / max(1, len(sets[a]) + len(sets[b]) - both) >= least and find(a) != find(b):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in sets}


def test_copies_that_only_their_original_joins(spark):
    rng = random.Random(3)
    original = [f"w{i}" for i in range(104)]
    docs = [(500, " ".join(original))]
    for k in range(300):  # two changed words change ten of a hundred shingles; copies differ among themselves
        copy = list(original)
        one = rng.randrange(4, 47)
        for at in (one, rng.randrange(one + 5, 100)):
            copy[at] = f"c{k}x{at}"
        docs.append((k, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and got == exact_groups(docs)


def changed(words, at, mark):
    return [f"{mark}x{i}" if i in at else w for i, w in enumerate(words)]


def test_long_texts_near_the_limit(spark):
    docs = []
    for k in range(60):  # each changed word in the midst changes five of 600 shingles: 0.786 to 0.818
        words = [f"d{k}w{i}" for i in range(604)]
        docs += [(k, " ".join(words)), (1000 + k, " ".join(changed(words, {20 + 40 * j for j in range(12 + k % 3)}, f"c{k}")))]
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == exact_groups(docs)
    assert sum(got[1000 + k] == k for k in range(60)) == 40


def test_short_texts(spark):
    docs, k = [], 0
    for size, more in ((4, 1), (5, 1), (6, 1), (8, 2), (9, 1), (10, 2), (12, 3), (24, 6), (40, 10)):
        for _ in range(12):
            words = [f"d{k}w{i}" for i in range(size + 4)]
            docs += [(k, " ".join(words)), (1000 + k, " ".join(words + [f"m{i}x{k}" for i in range(more)]))]
            k += 1
    docs += [(5000 + n, " ".join(f"s{i}" for i in range(n))) for n in range(1, 9)]
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == exact_groups(docs)
    assert all(got[1000 + i] == i for i in range(k))


def test_fingerprints_meet_in_the_covering_join(spark):
    fps = [0, 1, 3, 7, 1 << 60, (1 << 63) - 1, -1, -4]  # classes of one size
    rows = [(i, fp, 100) for i, fp in enumerate(fps)] + [(50, 0, 90), (51, 0, 10)]
    got = {(r.a, r.b) for r in similar.covered(spark.createDataFrame(rows, "class long, fp long, n int"), 0.8).collect()}
    near = {(i, j) for i in range(8) for j in range(i + 1, 8) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2}
    assert got == near | {(0, 50)} and (0, 4) in near and (6, 7) in near


def test_different_texts_under_one_id_stay(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(3)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[0] + " end"), (9, texts[2]), (7, texts[2]), (10, None), (10, ""), (None, texts[0])]
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.filter("doc_id is not null and doc_id < 10").collect()) == sorted((7, t) for t in texts)
    assert got.filter("doc_id = 10").count() == 1 and got.filter("doc_id is null").count() == 1
