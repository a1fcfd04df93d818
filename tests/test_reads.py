import pytest
from pyspark.sql import functions as F

from strandline.functions import seq as S
from strandline.operators import align, index, libraries, matching, overlap
from strandline.sources import reads as R

#: Reads ACCA and CCAG with their reverse complements; ranks, ids, places and symbols worked out by hand.
GOLDEN = [(0, 4, "A"), (2, 4, "G"), (3, 4, "G"), (1, 4, "T"), (0, 3, "C"), (0, 0, "$"), (2, 2, "C"), (0, 2, "C"), (2, 1, "C"), (0, 1, "A"), (2, 0, "$"), (3, 0, "$"), (2, 3, "A"), (3, 3, "G"), (3, 2, "T"), (1, 1, "T"), (1, 2, "G"), (1, 3, "G"), (3, 1, "C"), (1, 0, "$")]


@pytest.fixture(scope="module")
def golden(spark):
    return R.oriented(spark.createDataFrame([(0, "ACCA"), (1, "CCAG")], "frag_id long, seq string"))


def test_golden_transform(golden):
    rows = index.bwt(golden).orderBy("rk").collect()
    assert [(r.read_id, r.pos, r.sym) for r in rows] == GOLDEN
    assert [r.rk for r in rows] == list(range(20))
    assert [r.read_id for r in index.sorted_reads(golden).orderBy("ids_rank").collect()] == [0, 2, 3, 1]
    assert {r.sym: r.start_rk for r in index.c_array(golden).collect()} == {"$": 0, "A": 4, "C": 7, "G": 12, "T": 17}
    assert index.intervals(golden, 2).filter("pattern = 'CA'").first()[1:] == (7, 2, 0)


def test_ranks_from_checkpoints(spark, golden):
    transform = index.bwt(golden)
    table = index.checkpoints(transform, 4)
    got = index.rank_before(transform, table, spark.range(20).withColumnRenamed("id", "rk"), 4).orderBy("rk").collect()
    for r in got:
        before = [s for _, _, s in GOLDEN[: r.rk]]
        assert tuple(r)[1:] == tuple(before.count(s) for s in "$ACGT")


def test_transform_inverts_to_the_reads(spark, golden):
    text = [r.sym for r in index.bwt(golden).orderBy("rk").collect()]
    starts = {s: sum(t < s for t in text) for s in "$ACGT"}
    found = []
    for first in range(4):  # ranks of the ends
        at, word = first, ""
        while text[at] != "$":
            word = text[at] + word
            at = starts[text[at]] + text[:at].count(text[at])
        found.append(word)
    assert sorted(found) == sorted(["ACCA", "TGGT", "CCAG", "CTGG"])


def test_scalars(spark):
    row = spark.createDataFrame([("ACGTNx", "IIII#I", "AACGGGT", "TTT")], "a string, q string, b string, t string")
    got = row.select(
        S.revcomp(F.col("a")), S.mask_low_quality(F.col("a"), F.col("q"), 64), S.longest_known(F.lit("ACNGGNTT")), S.end_run(F.col("t")), S.run_score(F.lit("AAACCCCG")),
        S.overlap_length(F.lit("ACGT"), F.lit("GTTT"), 1), S.hamming(F.lit("ACGT"), F.lit("AGGA")), S.symbol_code(F.lit("n")), S.symbol_code(F.lit("t")), S.symbol_code(F.lit("-")),
    ).first()
    assert tuple(got) == ("NNACGT", "ACGTNx", "AC", 3, 3, 2, 2, 5, 3, 6)
    twice = spark.createDataFrame([("ACGTTG",)], "s string").select(S.revcomp(S.revcomp(F.col("s")))).first()[0]
    assert twice == "ACGTTG"
    assert [r[0] for r in spark.range(4).select(S.mate_id(F.col("id"), F.lit(False))).collect()] == [3, 2, 1, 0]
    assert [r[0] for r in spark.range(4).select(S.mate_id(F.col("id"), F.lit(True))).collect()] == [2, 3, 0, 1]
    assert [r[0] for r in spark.createDataFrame([(1, 5), (1, 20), (2, 45), (3, 45)], "c long, m long").select(S.branch_cull(F.col("c"), F.col("m"))).collect()] == [1, 0, 0, 3]


def test_files(spark, tmp_path):
    read = "ACGT" * 20
    (tmp_path / "a.fa").write_text(f">x\n{read}\n>y\n{read[:50]}\n")
    (tmp_path / "b.fq").write_text(f"@x\n{read}\n+\n{'I' * 79}!\n@cut\nACGT\n")
    (tmp_path / "c.txt").write_text(f"{read}\nACGTN\n")
    (tmp_path / "d.txt").write_text("")
    got = {(r.path.rpartition("/")[2], r.n): (r.seq, r.quality) for r in R.read_files(spark, [str(tmp_path / f) for f in ("a.fa", "b.fq", "c.txt", "d.txt")]).collect()}
    assert got == {("a.fa", 0): (read, None), ("a.fa", 1): (read[:50], None), ("b.fq", 0): (read, "I" * 79 + "!"), ("b.fq", 1): ("ACGT", None), ("c.txt", 0): (read, None), ("c.txt", 1): ("ACGTN", None)}
    rows = R.read_files(spark, [str(tmp_path / "b.fq")]).select("n", R.cleaned(F.col("seq"), F.col("quality"), 40).alias("seq"))
    assert [r.seq for r in rows.orderBy("n").collect()] == [read[:79], None]
    assert R.read_length(R.read_files(spark, [str(tmp_path / "a.fa")])) == 80
    long = "".join(f"@r{i}\n{'ACGT' * (i % 30 + 1)}\n+\n{'I' * 4 * (i % 30 + 1)}\n" for i in range(3000))
    (tmp_path / "long.fq").write_text(long)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:  # one file over many splits
        rows = R.read_files(spark, [str(tmp_path / "long.fq")]).collect()
        assert len(long) > 10 * 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.n, r.header, r.seq, r.quality) for r in rows} == {(i, f"r{i}", "ACGT" * (i % 30 + 1), "I" * 4 * (i % 30 + 1)) for i in range(3000)}
    with pytest.raises(ValueError):
        R.read_length(R.read_files(spark, [str(tmp_path / "a.fa")]).filter("n = 1"))
    (tmp_path / "bad.txt").write_text("?\n")
    with pytest.raises(Exception, match="neither"):
        R.read_files(spark, [str(tmp_path / "bad.txt")]).collect()
    (tmp_path / "libs").write_text("# all\nsingle c.txt\n\npaired a.fa b.fq\npaired ab.fa\n")
    assert [(r.lib_id, r.kind, r.paths) for r in R.manifest(spark, str(tmp_path / "libs")).orderBy("lib_id").collect()] == [(0, "paired", ["a.fa", "b.fq"]), (1, "paired", ["ab.fa"]), (2, "single", ["c.txt"])]
    (tmp_path / "libs2").write_text("double a b\n")
    with pytest.raises(Exception, match="bad line"):
        R.manifest(spark, str(tmp_path / "libs2")).collect()


def test_pairs_and_libraries(spark):
    left = spark.createDataFrame([(0, "A"), (1, None), (2, "C")], "n long, seq string")
    right = spark.createDataFrame([(0, "G"), (1, "T"), (2, None)], "n long, seq string")
    assert sorted(map(tuple, R.pair_up(left, right).collect())) == [(0, "A", "G"), (1, "T", None), (2, "C", None)]
    with pytest.raises(ValueError, match="more than 255"):
        libraries.library_of(spark.range(1), spark.range(300).selectExpr("id as lib_id", "id as end_count"))
    libs = libraries.libraries(spark.createDataFrame([(0, 1000, 4), (1, 100, 2)], "lib_id int, size long, n long"))
    assert [tuple(r) for r in libs.orderBy("lib_id").collect()] == [(0, 1000, 4, 100, 1400), (1, 100, 6, 1, 320)]
    ids = spark.range(7).select("id")
    assert [r.lib_id for r in libraries.library_of(ids, libs).orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, None]


def test_matches_by_brute_force(spark):
    import random

    rng = random.Random(3)
    q = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(3)]
    reads = []
    for i in range(40):
        s = rng.randrange(0, 130)
        r = list(q[i % 3][s : s + rng.choice([45, 60, 70])])
        for _ in range(i % 4):
            r[rng.randrange(len(r))] = rng.choice("ACGT")
        reads.append((i, "".join(r)))
    targets = spark.createDataFrame(list(enumerate(q)), "query long, q string")
    table = spark.createDataFrame(reads, "read_id long, seq string")
    want = {(k, i, s, s + len(r), m) for k, t in enumerate(q) for i, r in reads for s in range(len(t) - len(r) + 1) if (m := sum(a != b for a, b in zip(r, t[s:]))) <= 2}
    assert {tuple(x) for x in matching.within(targets, table).collect()} == want
    assert {tuple(x) for x in matching.exact(targets, table).collect()} == {x[:4] for x in want if x[4] == 0}
    rows = overlap.classes(table)
    ids = {r.seq: r.id for r in rows.collect()}
    best = {}
    for a in ids:
        for b in ids:
            k = max((k for k in range(45, min(len(a), len(b))) if a != b and a[-k:] == b[:k]), default=0)
            if k:
                best[ids[a], ids[b]] = k
    assert {(r.left_id, r.right_id): r.ol for r in overlap.overlaps(rows).collect()} == best


def test_alignment():
    assert align.mems("AACGTACGTT", "TTCGTACGAA", 6) == [(2, 2, 6)]
    assert align.similarity("ACGTACGT", "ACGTACGT") == 100.0
    assert align.similarity("ACGTACGT", "ACCTACGT") == 87.5
    assert align.similarity("TTACGT", "ACGT") == 100.0
    assert align.similarity("", "A") == 0.0


def test_tries_and_paths(spark):
    ext = spark.createDataFrame([(1, "ACG"), (1, "ACT"), (1, "ACGT"), (2, "A"), (2, "A")], "key long, ext string")
    assert sorted(map(tuple, align.tries(ext).collect())) == [(1, "AC", 3), (1, "ACG", 2), (1, "ACGT", 1), (1, "ACT", 1), (2, "A", 2)]
    genome = "ACGTTGCAAGGCTATTCGACCGTAAGCTTGCACTGATCCGAT"
    reads = [(0, genome[s : s + 20], s) for s in (0, 5, 10, 15, 20)]
    got = align.paths(spark.createDataFrame(reads, "locus long, seq string, start int"), least=10).filter("rank = 1").first()
    assert (got.seq, got.n_reads) == (genome[:40], 5)


def test_query_files_and_sinks(spark, tmp_path):
    from strandline.sources import queries as Q

    (tmp_path / "a.fa").write_text(">one\nACGT\n>two\nACNT\n>bad\nACXT\n>late\nACGT\n")
    (tmp_path / "b.fq").write_text("@r\nACGTA\n+\nIIIII\n")
    (tmp_path / "c.txt").write_text("ACGT\nGGTT\n\nCCCC\n")
    got = Q.query_files(spark, [str(tmp_path / n) for n in ("a.fa", "b.fq", "c.txt")]).collect()
    assert sorted((r.path[-4:], r.n, r.query, r.q) for r in got if r.query) == [("a.fa", 0, "one", "ACGT"), ("a.fa", 1, "two", "ACNT"), ("b.fq", 0, "r", "ACGTA")]
    assert sorted((r.n, r.q) for r in got if not r.query) == [(0, "ACGT"), (1, "GGTT")]
    (tmp_path / "d.txt").write_text("A" * 300 + "\n" + "C" * 299 + "\n")
    assert [(r.n, len(r.q)) for r in Q.coverage_queries(spark, str(tmp_path / "d.txt")).collect()] == [(0, 300)]
    assert tuple(Q.literal(spark, {"x": "ACG"}).first()) == ("x", "ACG")
    lines = spark.createDataFrame([("b", 0, "GG"), ("a", 1, "-C"), ("a", 0, "AC")], "query string, line_no int, line string")
    Q.write_fasta(lines, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).coalesce(1).collect()] in (["AC", "-C", "GG"], ["GG", "AC", "-C"])
    Q.write_coverage(spark.createDataFrame([("a", 2.005), ("b", 3.0)], "query string, coverage double"), str(tmp_path / "cov"))
    assert sorted(float(r.value) for r in spark.read.text(str(tmp_path / "cov")).collect()) in ([2.0, 3.0], [2.01, 3.0])


def test_adapters_and_ends(spark):
    stretch = "ACGGTCATTGCAGGCTTAACCGTATCGA"
    q = spark.createDataFrame([(1, "TT" + stretch + "AATT")], "query long, q string")
    rows = spark.createDataFrame([(1, stretch + "CTGAAA"), (2, "TTCAG" + stretch), (3, stretch + "GTG"), (4, stretch + "CT"), (5, stretch)], "read_id long, seq string")
    got = sorted(tuple(r) for r in matching.without_adapters(q, rows).collect())
    assert got == [(1, 1, 1, 2, 30), (1, 2, 0, 2, 30), (1, 4, 1, 2, 30)]
    assert [tuple(r) for r in spark.createDataFrame([("ACGT", "GTTT"), ("ACGT", ""), ("AC", "GT")], "a string, b string").select(S.congruent(F.col("a"), F.col("b"), 2), S.common_prefix(F.col("a"), F.col("b"))).collect()] == [(True, 0), (False, 0), (False, 0)]
