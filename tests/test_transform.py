import random

import numpy as np
import pytest

from strandline.operators import index, transform


def by_hand(reads):
    """The transform's symbols from suffixes sorted one by one."""
    rows = [(x[p:] + "$", x[::-1], i, x[p - 1] if p else "$") for i, x in enumerate(reads) for p in range(len(x) + 1)]
    return "".join(r[3] for r in sorted(rows))


def made(kind, rng=None):
    rng = rng or random.Random(4)
    if kind == "long":
        text = "".join(rng.choice("ACGT") for _ in range(300)) + "A" * 150
        return [text[i : i + rng.randint(1, 120)] for i in (rng.randrange(400) for _ in range(90))] + ["A" * n for n in range(45)] + ["ACGT" * 63] * 2
    return {"short": ["ACCA", "TGGT", "", "A"], "letters": ["ACGN" * 5, "ACGTACGTACGT"], "very long": ["ACGT" * 70, "A" * 12], "one": ["ACGTACGTA"]}[kind]


@pytest.mark.parametrize("kind", ["long", "short", "letters", "very long", "one"])
def test_blocks_are_the_transform(spark, kind, monkeypatch):
    for name, value in (("BUCKET", 400), ("PASS", 2000), ("TOGETHER", 40), ("SENT", 700)):
        monkeypatch.setattr(transform, name, value)
    reads = made(kind)
    rows = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    want, step = by_hand(reads), 64
    table = index.symbol_blocks(rows, step)
    got = sorted(map(tuple, table.collect()))
    assert [b for b, _ in got] == list(range(-(-len(want) // step))) and "".join(s for _, s in got) == want
    if kind == "letters":
        return
    counts = sorted(map(tuple, index.block_checkpoints(table).collect()))
    assert counts == [(b, *(want[: b * step].count(s) for s in "$ACGT")) for b, _ in got]
    runs, at = [], 0
    while at < len(want):
        n = len(want[at:]) - len(want[at:].lstrip(want[at]))
        runs.append((at, want[at], n))
        at += n
    assert sorted((r.start_rk, r.sym, r.run_len) for r in index.block_runs(table, step).collect()) == runs
    ranks = sorted(map(tuple, index.ranks_of(table, index.block_checkpoints(table), "$", step).collect()))
    assert ranks == [(i, *(want[:i].count(s) for s in "$ACGT")) for i, x in enumerate(want) if x == "$"]


def test_only_packed_suffixes_are_shuffled(spark):
    """No exchange of the transform carries strings of suffixes and whole reads, as all did before."""
    rows = spark.createDataFrame([(i, "ACGT" * 20) for i in range(5)], "read_id long, seq string")
    plan = index.symbol_blocks(rows)._jdf.queryExecution().executedPlan().toString()
    assert "suffix" not in plan and "order" not in plan


def test_order_of_tied_words():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, 2000, np.uint64) << np.uint64(shift) for shift in (60, 62, 0, 31)]
    last = rng.integers(0, 4, 2000).astype(np.uint16)
    got = transform.order_of(words, last)
    want = np.lexsort((last, *words[::-1]))
    for x in (*words, last):
        assert (x[got] == x[want]).all()


def test_words_are_counted_before_they_are_sent(spark):
    """A task sends a row for each word; before, each place of a read was a row."""
    rng = random.Random(9)
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["ACGNACGTACG", "", "ACG", "NNNN"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(reads)], "read_id long, seq string")
    want: dict = {}
    for x in reads:
        for p in range(len(x) - 2):
            for key in (x[p : p + 3], (x[p : p + 3], x[p - 1] if p else "$")):
                n = want.setdefault(key, [0, 0])
                n[0] += 1
                n[1] += p + 3 == len(x)
    assert {r.kmer: [r.cnt, r.edge] for r in index.kmers(rows, 3).collect()} == {k: v for k, v in want.items() if isinstance(k, str)}
    assert {(r.pattern, r.sym): [r.n, r.n_edge] for r in index.interval_symbols(rows, 3).collect()} == {k: v for k, v in want.items() if not isinstance(k, str)}
    assert index.onward(rows, 3).filter("not holds").count() == 0
    for query in (index.kmers(rows, 3), index.interval_symbols(rows, 3)):
        assert "Generate" not in query._jdf.queryExecution().optimizedPlan().toString()
