import random

import numpy as np
import xxhash

from strandline.llm.graph import components
from strandline.llm.simhash import fingerprint, homes, links, near_duplicates, reached


def brute(text, shingle=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for text in ("", " \n", "a", "a B", "a b c", "A b\tc d d d d d", "é É ß"):
        assert fingerprint(text.encode()) == brute(text)


def test_codewords_cover():
    rng = np.random.default_rng(1)
    for x in rng.integers(-(2**63), 2**63 - 1, 40):
        flips = [0, *(1 << a for a in range(63)), *((1 << a) ^ (1 << b) for a in range(0, 63, 4) for b in range(a + 1, 63, 3))]
        near = np.array([int(x) ^ f for f in flips], np.int64)
        _, keys = reached(np.array([x]), 2)
        assert len(set(keys.tolist())) == len(keys)
        assert set(homes(near).tolist()) <= set(keys.tolist())


def test_links_by_brute_force(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) - 2**63 for _ in range(60)}
    for v in list(values):
        values |= {v ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (rng.randrange(2) << 5) for _ in range(3)}
    rows = sorted(values)
    want = {(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a ^ b & (2**64 - 1)).bit_count() <= 2 or bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = links(spark.createDataFrame([(v,) for v in rows], "fp long"))
    assert {tuple(r) for r in got.collect()} == want


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(7, 7), (3, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({n for p in pairs for n in p if p[0] != p[1]}, pairs)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_by_brute_force(spark, odd, none):
    assert near_duplicates(none).count() == 0
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    docs = [(r.doc_id, brute(r.text or "")) for r in odd.collect()]
    nodes = {f for _, f in docs}
    group = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for d, f in docs:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    assert sorted(map(str, ((d, f"{f:016x}", least.get(group[f])) for d, f in docs))) == sorted(str(tuple(r)) for r in rows)

