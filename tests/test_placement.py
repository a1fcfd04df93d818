import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import matching as M


def by_hand(q, r):
    """class, how, q_start, q_end, r_start, r_end, len of one pair, from the rule."""
    if r in q:
        return "exact", "inside", q.find(r), q.find(r) + len(r), 0, len(r), len(r)
    if q in r:
        return "exact", "around", -r.find(q), len(r) - r.find(q), 0, len(r), len(q)
    found = []
    for i in range(len(q)):
        for j in range(len(r)):
            n = 0
            while i + n < len(q) and j + n < len(r) and q[i + n] == r[j + n]:
                n += 1
            if n >= 10 and not (i and j and q[i - 1] == r[j - 1]):
                found.append((-n, i, j))
    if not found:
        return "unmatched", "", None, None, None, None, 0
    n, i, j = min(found)
    qs, qe, rs, re = i, i - n, j, j - n
    if (rs == 0 or qs == 0) and qe < len(q) and all(r[re + k] == "CTG"[k] for k in range(min(3, len(r) - re))):
        return "exact", "left" if re == len(r) else "after", qs, qe, 0, re, -n
    if (re == len(r) or qe == len(q)) and qs and all(r[rs - 1 - k] == "GAC"[k] for k in range(min(3, rs))):
        return "exact", "right" if rs == 0 else "before", qs, qe, rs, len(r), -n
    return "inexact", "", qs, qe, rs, re, -n


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(8)
    dna = lambda n, letters="ACGT": "".join(rng.choices(letters, k=n))
    queries = [dna(rng.choice([40, 60, 150])) for _ in range(12)] + ["A" * 50, "ACAC" * 20, dna(60, "AC")]
    reads = []
    for q in queries * 6:
        at = rng.randrange(max(1, len(q) - 45))
        r = (dna(20) if rng.random() < 0.3 else "") + q[at : at + rng.randrange(30, 70)] + rng.choice(["", "CTG", "CT", "CTGAAAC", dna(20), q[-12:]])
        r = rng.choice(["", "", "CAG", "G", "AAG", "TTCAG"]) + r
        if rng.random() < 0.4:
            k = rng.randrange(len(r))
            r = r[:k] + rng.choice("ACGTN") + r[k + 1 :]
        reads.append((r + dna(45))[: max(45, len(r))])
    return queries, reads


def test_longest_stretch_and_class_by_the_rule(spark, pairs, monkeypatch):
    queries, reads = pairs
    asked = [(i, q, j, r) for i, q in enumerate(queries) for j, r in enumerate(reads) if (i + j) % 3 == 0 or j % len(queries) == i]
    monkeypatch.setattr(M, "seeded", lambda *a: spark.createDataFrame([(i, j) for i, _, j, _ in asked], "query long, read_id long"))
    got = M.classified(spark.createDataFrame(list(enumerate(queries)), "query long, q string"), spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"))
    held = {(r.query, r.read_id): tuple(r)[2:] for r in got.collect()}
    assert held == {(i, j): by_hand(q, r) for i, q, j, r in asked}
    assert {x[:2] for x in held.values()} >= {("exact", h) for h in ("inside", "left", "right", "after", "before")} | {("inexact", ""), ("unmatched", "")}


def test_candidates_lie_inside_over_both_ends_and_around(spark):
    g = "".join(random.Random(4).choices("ACGT", k=300))
    queries = spark.createDataFrame([(1, g[100:200]), (2, g[130:160]), (3, g[140:152])], "query long, q string")
    reads = spark.createDataFrame([(1, g[50:130]), (2, g[170:250]), (3, g[110:180]), (4, g[:60]), (5, g[60:260])], "read_id long, seq string")
    got = {(r.query, r.read_id): r.how for r in M.classified(queries, reads).collect()}
    assert got == {(1, 1): "left", (1, 2): "right", (1, 3): "inside", (1, 5): "around", (2, 3): "around", (2, 5): "around", (3, 3): "around", (3, 5): "around"}


def test_competition(spark):
    rows = [(1, 10, "exact", 5), (2, 10, "inexact", 90), (3, 10, "unmatched", 0), (1, 11, "inexact", 40), (2, 11, "inexact", 41), (3, 11, "inexact", 41), (4, 11, "unmatched", 0), (1, 12, "unmatched", 0), (2, 12, "unmatched", 0)]
    got = M.compete(spark.createDataFrame(rows, "query long, read_id long, class string, len int"))
    assert sorted(map(tuple, got.collect())) == [(1, 10, "exact", 5), (1, 12, "unmatched", 0), (2, 11, "inexact", 41), (2, 12, "unmatched", 0), (3, 11, "inexact", 41)]
    assert M.compete(got.limit(0)).count() == 0


def test_reads_are_sifted_by_the_seeds_of_few_queries(spark, monkeypatch):
    """Reads without a seed of a query are not shuffled, as all were before; the same placements come out when seeds are too many to send."""
    import random

    from strandline.operators import matching

    rng = random.Random(6)
    q = "".join(rng.choice("ACGT") for _ in range(300))
    cut = [q[i : i + 60] for i in range(0, 200, 9)] + ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(50)]
    queries = spark.createDataFrame([(1, q), (2, q[100:130])], "query long, q string")
    reads = spark.createDataFrame([(i, x[:30] + ("A" if i % 2 else x[30]) + x[31:]) for i, x in enumerate(cut)], "read_id long, seq string")
    rows = lambda f: sorted(map(str, f(queries, reads).collect()))
    queries_ = (matching.within, lambda a, b: matching.within_rate(a, b, 16), matching.classified)
    few = [rows(f) for f in queries_]
    assert "LeftSemi" in matching.within(queries, reads)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(matching, "FEW", 0)
    assert few == [rows(f) for f in queries_] and all(few)
