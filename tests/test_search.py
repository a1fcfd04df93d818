import random

from strandline.functions.seq import END
from strandline.operators import index


def reads_of(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def suffixes(seqs):
    return sorted((s[k:] + END, s[::-1], i) for i, s in enumerate(seqs) for k in range(len(s) + 1))


def by_hand(seqs, patterns):
    order, out = suffixes(seqs), {}
    whole = [i for s, _, i in order if s == seqs[i] + END]
    for p in patterns:
        at = [k for k, (s, _, _) in enumerate(order) if s.startswith(p)]
        if at:
            starts = sum((s + END).startswith(p) for s in seqs)
            before = sum(order[k][0] == seqs[order[k][2]] + END for k in range(at[0]))
            out[p] = at[0], at[-1] + 1, before, starts
    return out, whole


def looked_up(spark, seqs, patterns, step):
    rows = reads_of(spark, seqs)
    found = index.search(index.stored(rows, step), spark.createDataFrame([(p,) for p in patterns], "pattern string"), index.counted(rows), step)
    return found


def test_the_golden_fixture(spark):
    """Interval of CA and read order of the four reads."""
    seqs = ["ACCA", "TGGT", "CCAG", "CTGG"]
    got = {r.pattern: tuple(r)[1:] for r in looked_up(spark, seqs, ["CA", "A", "CC", "TG", "ACCA", "GA", "N", ""], 4).collect()}  # 20 ranks, so the last block is full
    assert got == {"CA": (7, 9, 1, 0), "A": (4, 7, 0, 1), "CC": (9, 11, 1, 1), "TG": (18, 20, 3, 1), "ACCA": (5, 6, 0, 1)}


def test_equals_scanning_and_every_read_finds_itself(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACG", k=rng.randint(3, 14))) for _ in range(25)]
    seqs += [seqs[0], seqs[1], "A" * 12, "ACACACACAC", "T"]
    patterns = sorted({s[a : a + n] for s in seqs for a in range(len(s)) for n in (1, 2, 5, 9)} | set(seqs) | {s[-3:] + END for s in seqs} | {"TTT", "GGGGGGGG", "ACGX"})
    found = looked_up(spark, seqs, patterns, 8)
    want, whole = by_hand(seqs, patterns)
    assert {r.pattern: tuple(r)[1:] for r in found.collect()} == want
    rows = reads_of(spark, seqs)
    ids = {(r.pattern, r.read_id) for r in index.ids_of(found, index.sorted_reads(rows)).collect()}
    assert ids == {(p, i) for p in patterns for i, s in enumerate(seqs) if (s + END).startswith(p)}
    assert {(s, i) for i, s in enumerate(seqs)} <= ids  # every read finds itself
    got = {r.pattern: tuple(r)[1:] for r in index.lookups(rows, found.filter("pattern not like '%$'").select("pattern")).collect()}
    assert got == {p: (b - a, n, sum(s.endswith(p) for s in seqs)) for p, (a, b, _, n) in want.items() if END not in p}


def test_no_patterns_and_no_reads(spark):
    assert looked_up(spark, ["ACGT"], ["GG"], 4).count() == 0
    rows = reads_of(spark, ["ACGT"])
    none = spark.createDataFrame([], "pattern string")
    assert index.search(index.stored(rows), none, index.counted(rows)).count() == 0
