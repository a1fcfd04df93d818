import random

import pyarrow as pa
import pytest

from strandline.operators import overlap, seeds


def made(letters="ACGT", n=120, seed=3):
    """Distinct reads of 20 to 110 letters that share passages, some of one letter."""
    rng = random.Random(seed)
    text = "".join(rng.choice(letters) for _ in range(400)) + "A" * 120 + "".join(rng.choice(letters) for _ in range(200))
    cut = [text[i : i + rng.randint(20, 110)] for i in (rng.randrange(len(text) - 20) for _ in range(n))]
    changed = [x[:60] + rng.choice("ACGT") + x[61:] for x in cut[::3]]
    return sorted(set(cut + changed))


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN", "AC"])
def test_seeded_pairs_are_all_pairs_of_equal_windows(spark, letters):
    reads, least = made(letters), 30
    rows = spark.createDataFrame([(i, x, 1 + i % 3) for i, x in enumerate(reads)], "id long, seq string, copies long")
    want = set()
    for l, a in enumerate(reads):
        for r, b in enumerate(reads):
            for p in range(len(a) - least + 1) if l != r and len(b) >= least else ():
                if a[p : p + least] == b[:least]:
                    k = next((k for k, (x, y) in enumerate(zip(a[p:], b)) if x != y), min(len(a) - p, len(b)))
                    want.add((l, p + 1, r, 1 + r % 3, len(a), len(b), k, b[k : k + 4]))
    got = [tuple(x) for x in overlap._seeded(rows, least, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_a_read_sends_few_hashes(spark):
    """The rows that are shuffled for the windows of a read: one for each window, 56, before."""
    rng = random.Random(5)
    reads = [(i, "".join(rng.choice("ACGT") for _ in range(100)), 1) for i in range(500)]
    rows = seeds.packed(spark.createDataFrame(reads, "id long, seq string, copies long"))
    assert 500 < seeds.anchors(rows, 45).count() < 500 * 9
    assert seeds.anchors(rows, 45, first=True).count() == 500


def test_packed_reads():
    reads = made()[:50] + ["", "A", "ACG", "ACGT"]
    for x in (reads, reads + ["ACGN", "acgt", "N" * 300]):
        held = seeds.pack(pa.array(x))
        data, starts, sizes = seeds.unpack(held)
        assert [data[a : a + n].tobytes().decode() for a, n in zip(starts, sizes)] == x
    assert len(seeds.pack(pa.array(["ACGT" * 25]))[0].as_py()) == 26
