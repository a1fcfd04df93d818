import random

from strandline.operators import loci, matching


def changed(g, *places):
    for at in places:
        g = g[:at] + "ACGTA"["ACGT".index(g[at]) + 1] + g[at + 1 :]
    return g


def test_places_by_rate_equal_plain_loops(spark):
    rng = random.Random(8)
    g = "".join(rng.choices("ACGT", k=300))
    queries = [(0, g), (1, g[40:90] + g[100:220]), (2, "ACG"), (3, "A" * 60)]
    reads = [(0, ""), (1, "AC"), (2, "A" * 48), (3, g[10:30])]
    for i in range(4, 90):
        n = rng.choice([31, 32, 50, 64, 80])
        at = rng.randrange(0, 300 - n)
        reads.append((i, changed(g[at : at + n], *rng.sample(range(n), rng.randint(0, 6)))))
    want = set()
    for q, text in queries:
        for r, s in reads:
            for at in range(len(text) - len(s) + 1 if s else 0):
                off = sum(a != b for a, b in zip(text[at:], s))
                if off <= len(s) // 16:
                    want.add((q, r, at, at + len(s), off))
    got = matching.within_rate(spark.createDataFrame(queries, "query long, q string"), spark.createDataFrame(reads, "read_id long, seq string"), 16)
    assert set(map(tuple, got.collect())) == want and len({x[4] for x in want}) > 4


def test_planted_loci(spark):
    """Two alleles pass; one, a third, uneven depths, a short query, far alleles and no reads are told apart."""
    rng = random.Random(21)
    queries, reads, want = [], [], {}

    def planted(verdict, n, *alleles):
        locus = len(queries)
        g = "".join(rng.choices("ACGT", k=n))
        queries.append((locus, g))
        for places, step in alleles:
            a = changed(g, *places)
            reads.extend(a[i : i + 60] for i in range(0, n - 59, step))
        want[locus] = verdict

    marks = list(range(20, 340, 40))
    planted("good", 360, ([], 10), (marks, 10))
    planted("nondiploid", 360, ([], 10))
    planted("nondiploid", 360, ([], 10), (marks, 10), ([100, 180], 10))
    planted("good", 360, ([], 10), (marks, 10), ([100], 30))
    planted("miscovered", 360, ([], 5), (marks, 15))
    planted("short", 200, ([], 10), (marks[:5], 10))
    planted("dissimilar", 360, ([], 10), (range(20, 340, 28), 10))
    planted("unmatched", 360)
    planted("nondiploid", 62, *[([], 1)] * 21)
    queries.append((len(queries), None))
    want[len(want)] = "unmatched"
    asked = spark.createDataFrame(queries, "query long, q string")
    rows = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    out = loci.judged(asked, rows, 60, least_similarity=97.0)
    got = {r.locus: r for r in out.collect()}
    assert {k: r.verdict for k, r in got.items()} == want
    assert got[0].len == 360 and got[0].similarity > 97 and got[0].coverage == 12
    row = loci.tally(out).first()
    assert (row.queried, row.unmatched, row.nondiploid, row.short, row.miscovered, row.dissimilar, row.good) == (10, 2, 3, 1, 1, 1, 2)
    empty = loci.judged(asked.limit(0), rows, 60)
    assert empty.count() == 0 and loci.tally(empty).first().queried == 0
    assert {r.verdict for r in loci.judged(asked, rows.limit(0), 60).collect()} == {"unmatched"}
