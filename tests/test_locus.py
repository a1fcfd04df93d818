import random
from collections import Counter

import pytest

from strandline.operators import locus, overlap


def grown(seq, reads, least=50, support=2):
    """One end of one locus by plain loops: (sequence, rounds)."""
    rounds = 0
    while True:
        exts = []
        for r, n in reads.items():
            ol = next((k for k in range(min(len(r) - 1, len(seq)), least - 1, -1) if seq.endswith(r[:k])), 0)
            if ol and r not in seq:
                exts += [r[ol:]] * n
        path = ""
        while True:
            after = Counter(e[len(path)] for e in exts if e.startswith(path) and len(e) > len(path))
            held = [b for b, n in after.items() if n >= support]
            if len(held) != 1:
                break
            path += held[0]
        if not path:
            return seq, rounds
        seq, rounds = seq + path, rounds + 1


def check(spark, loci, seqs, least=50, support=2):
    rows = overlap.classes(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"))
    got = {r.locus: (r.seq, r.to_left, r.to_right, r.rounds) for r in locus.extended(spark.createDataFrame(list(enumerate(loci)), "locus long, seq string"), rows, least, support).collect()}
    reads, back = Counter(seqs), Counter(s[::-1] for s in seqs)
    for i, s in enumerate(loci):
        right, a = grown(s, reads, least, support)
        left, b = grown(s[::-1], back, least, support)
        assert got[i] == (left[len(s) :][::-1] + right, len(left) - len(s), len(right) - len(s), max(a, b)), i
    return got


def test_planted_loci(spark):
    """Reads over one stretch reach its ends; a fork stops; one read alone adds nothing; a tandem repeat ends."""
    rng = random.Random(3)
    g = "".join(rng.choices("ACGT", k=600))
    other = g[:300] + "".join(rng.choices("ACGT", k=300))
    alone = "".join(rng.choices("ACGT", k=300))
    tandem = "".join(rng.choices("ACGT", k=7)) * 40
    tiled = lambda x, step, times: [x[i : i + 100] for i in range(0, len(x) - 99, step)] * times
    reads = tiled(g, 25, 1) + tiled(other, 40, 2) + tiled(alone, 50, 1) + tiled(tandem, 3, 2)
    got = check(spark, [g[400:480], g[100:180], alone[100:200], tandem[:90], "ACGT"], reads)
    assert got[0][0].endswith(g[480:575]) and got[0][2] == 95
    assert got[1][0] == g[:300] and got[2][1:] == (0, 0, 0) and got[4][0] == "ACGT"


@pytest.mark.parametrize("seed", [1])
def test_random_reads(spark, seed):
    rng = random.Random(seed)
    g = ["".join(rng.choices("AC", k=400)) for _ in range(3)]
    g.append(g[0][:200] + g[1][150:])
    reads = [x[i : i + rng.randint(30, 60)] for _ in range(120) for x in [rng.choice(g)] for i in [rng.randrange(360)]]
    check(spark, [x[i : i + 40] for x in g for i in (60, 200, 330)], reads, 20)


def test_nothing(spark):
    rows = overlap.classes(spark.createDataFrame([], "read_id long, seq string"))
    some = spark.createDataFrame([(1, "ACGT" * 30), (2, None)], "locus long, seq string")
    assert sorted((r.locus, r.seq) for r in locus.extended(some, rows).collect()) == [(1, "ACGT" * 30), (2, None)]
    assert locus.extended(some.limit(0), rows).count() == 0
