"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import seq as S
from strandline.operators import align, coverage, graph, index, libraries, loci, locus, matching, overlap, tries
from strandline.plans.sql import G, steps
from strandline.sources import reads as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = lambda spark, d: _long(f(spark, d))
        if sql is not None:
            SQL[name] = steps(needs, sql) if needs else sql
        return f

    return register


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, as in the SQL."""
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _frags(spark: SparkSession, d: str) -> DataFrame:
    return R.fragments(_docs(spark, d))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query"), R.bases(F.col("text")).alias("q"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.classes(_frags(spark, d).select(F.col("frag_id").alias("read_id"), "seq"))


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    return R.noisy(R.reads(spark, d))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return matching.exact(_targets(spark, d), R.reads(spark, d))


# Cleaning -----------------------------------------------------------------------------------------------------------

#: Letters that stand for unknown bases in the queries on cleaning.
UNKNOWN = "kwxyz"
_KNOWN = "regexp_replace(" + G.replace("text", f"regexp_replace(text, '[{UNKNOWN}]', '?', 'g')", 1).replace("[^A-Za-z]", "[^A-Za-z?]") + r", '\?', 'N', 'g')"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with unknown bases in them."""
    kept = F.regexp_replace(F.regexp_replace("text", f"[{UNKNOWN}]", "?"), "[^A-Za-z?]", "")
    return R.fragments(_docs(spark, d), F.translate(kept, R.LETTERS + "?", R.BASES + "N"))


_RAW_F = f"WITH g AS (SELECT doc_id, g FROM (SELECT doc_id, {_KNOWN} AS g FROM documents) WHERE length(g) >= 45), f AS (SELECT doc_id * 1048576 + k AS frag_id, substr(g, k * 50 + 1, 100) AS seq FROM (SELECT doc_id, g, unnest(range(0, (length(g) - 45) // 50 + 1)) AS k FROM g))"
_TRIM = ", t AS (SELECT frag_id, list_reduce(list_prepend('', string_split(seq, 'N')), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS best FROM f)"


@query("longest_n_free", sql=_RAW_F + _TRIM + " SELECT frag_id, best, length(best) >= 45 AS keep FROM t")
def longest_n_free(spark, d):
    best = S.longest_known(F.col("seq"))
    return _raw(spark, d).select("frag_id", best.alias("best"), (F.length(best) >= R.LEAST).alias("keep"))


@query("pair_demote", sql=_RAW_F + _TRIM + ", k AS (SELECT * FROM t WHERE length(best) >= 45) SELECT coalesce(a.frag_id // 2, b.frag_id // 2) AS n, coalesce(a.best, b.best) AS seq, CASE WHEN a.best IS NOT NULL THEN b.best END AS mate FROM (SELECT * FROM k WHERE frag_id % 2 = 0) a FULL JOIN (SELECT * FROM k WHERE frag_id % 2 = 1) b ON a.frag_id // 2 = b.frag_id // 2")
def pair_demote(spark, d):
    rows = _raw(spark, d).select("frag_id", R.cleaned(F.col("seq")).alias("seq")).filter("seq is not null")
    each = [rows.filter(F.col("frag_id") % 2 == i).select(F.floor(F.col("frag_id") / 2).alias("n"), "seq") for i in (0, 1)]
    return R.pair_up(*each)


@query("quality_mask", sql=f"SELECT doc_id, array_to_string(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN ascii(substr(l, i, 1)) < 97 THEN 'N' ELSE substr(g, i, 1) END), '') AS masked FROM (SELECT doc_id, {G} AS g, regexp_replace(text, '[^A-Za-z]', '', 'g') AS l FROM documents)")
def quality_mask(spark, d):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return _docs(spark, d).select("doc_id", S.mask_low_quality(R.bases(F.col("text")), letters, 97).alias("masked"))


@query("reads_revcomp", "reads", "SELECT read_id, frag_id, strand, seq FROM reads")
def reads_revcomp(spark, d):
    return R.reads(spark, d)


@query("len_histogram", "reads", "SELECT length(seq) AS len, count(*) AS cnt FROM reads GROUP BY ALL")
def len_histogram(spark, d):
    return R.reads(spark, d).groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("cnt"))


@query("base_position_counts", "reads", "SELECT prev, base, pos, count(*) AS cnt FROM (SELECT substr(seq, pos, 1) AS prev, substr(seq, pos + 1, 1) AS base, pos FROM (SELECT seq, unnest(range(1, length(seq))) AS pos FROM reads)) GROUP BY ALL")
def base_position_counts(spark, d):
    each = R.reads(spark, d).select("seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 1)).alias("pos"))
    return each.groupBy(F.expr("substring(seq, pos, 1)").alias("prev"), F.expr("substring(seq, pos + 1, 1)").alias("base"), "pos").agg(F.count(F.lit(1)).alias("cnt"))


@query("last_two_counts", "reads", "SELECT right(seq, 2) AS tail, count(*) AS cnt FROM reads GROUP BY ALL")
def last_two_counts(spark, d):
    return R.reads(spark, d).groupBy(F.right("seq", F.lit(2)).alias("tail")).agg(F.count(F.lit(1)).alias("cnt"))


# Index --------------------------------------------------------------------------------------------------------------


@query("suffix_bwt", "bwt", "SELECT rk // 1024 AS block, string_agg(sym, '' ORDER BY rk) AS symbols FROM bwt GROUP BY ALL")
def suffix_bwt(spark, d):
    return index.symbol_blocks(R.reads(spark, d))


@query("bwt_runs", "bwt", "SELECT sym, start_rk // 4096 AS stretch, count(*) AS n, CAST(sum(start_rk) AS BIGINT) AS starts, CAST(sum(run_len) AS BIGINT) AS symbols, CAST(sum(start_rk % 1009 * run_len) AS BIGINT) AS mixed FROM (SELECT sym, min(rk) AS start_rk, count(*) AS run_len FROM (SELECT sym, rk, rk - row_number() OVER (PARTITION BY sym ORDER BY rk) AS island FROM bwt) GROUP BY sym, island) GROUP BY ALL")
def bwt_runs(spark, d):
    """Runs summed up by stretches of ranks, so that each run's start and length counts."""
    rows = index.block_runs(index.symbol_blocks(R.reads(spark, d)))
    return rows.groupBy("sym", F.expr("start_rk div 4096").alias("stretch")).agg(F.count(F.lit(1)).alias("n"), F.sum("start_rk").alias("starts"), F.sum("run_len").alias("symbols"), F.sum(F.col("start_rk") % 1009 * F.col("run_len")).alias("mixed"))


@query("occ_checkpoints", "bwt", "SELECT block, " + ", ".join(f"CAST(coalesce(sum({n}) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS occ_{n}" for n in ("end_", "a", "c", "g", "t")).replace("occ_end_", "occ_end") + " FROM (SELECT rk // 1024 AS block, " + ", ".join(f"count(*) FILTER (sym = '{s}') AS {n}" for s, n in zip("$ACGT", ("end_", "a", "c", "g", "t"))) + " FROM bwt GROUP BY ALL)")
def occ_checkpoints(spark, d):
    return index.block_checkpoints(index.symbol_blocks(R.reads(spark, d)))


@query("sorted_read_ids", "reads", "SELECT row_number() OVER (ORDER BY seq || '$', reverse(seq), read_id) - 1 AS ids_rank, read_id FROM reads")
def sorted_read_ids(spark, d):
    return index.sorted_reads(R.reads(spark, d))


@query("symbol_totals", "sfx", "SELECT sym, count(*) AS cnt FROM sfx GROUP BY ALL")
def symbol_totals(spark, d):
    return index.symbol_totals(R.reads(spark, d))


@query("c_array", "sfx", "SELECT sym, CAST(sum(cnt) OVER (ORDER BY sym) - cnt AS BIGINT) AS start_rk FROM (SELECT sym, count(*) AS cnt FROM sfx GROUP BY ALL)")
def c_array(spark, d):
    return index.c_array(R.reads(spark, d))


def _kmer_sql(k: int) -> str:
    return f"SELECT substr(seq, p, {k}) AS kmer, count(*) AS cnt, CAST(sum(CASE WHEN p = length(seq) - {k - 1} THEN 1 ELSE 0 END) AS BIGINT) AS edge FROM (SELECT seq, unnest(range(1, length(seq) - {k - 2})) AS p FROM reads) GROUP BY ALL"


@query("dinucleotides", "reads", _kmer_sql(2))
def dinucleotides(spark, d):
    return index.kmers(R.reads(spark, d), 2)


@query("kmer_counts", "reads", _kmer_sql(8))
def kmer_counts(spark, d):
    return index.kmers(R.reads(spark, d), 8)


@query("interval_counts", "sfx", "SELECT pattern, lo, width, n_start FROM (SELECT pattern, CAST(sum(width) OVER (ORDER BY pattern) - width AS BIGINT) AS lo, width, CAST(n_start AS BIGINT) AS n_start FROM (SELECT substr(suffix, 1, 6) AS pattern, count(*) AS width, count(*) FILTER (sym = '$') AS n_start FROM sfx GROUP BY ALL)) WHERE NOT contains(pattern, '$')")
def interval_counts(spark, d):
    return index.intervals(R.reads(spark, d), 6)


@query("read_self_lookup", "reads", "SELECT count(*) AS asked, count(*) FILTER (n > 0) AS found, CAST(sum(n) AS BIGINT) AS places FROM (SELECT a.read_id, count(b.read_id) AS n FROM reads a LEFT JOIN reads b ON a.seq = b.seq GROUP BY ALL)")
def read_self_lookup(spark, d):
    rows = R.reads(spark, d)
    held = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(held, "seq", "left").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("n") > 0).alias("found"), F.sum("n").alias("places"))


@query("interval_symbols", "sfx", "SELECT pattern, sym, n, CAST(n_edge AS BIGINT) AS n_edge FROM (SELECT substr(suffix, 1, 6) AS pattern, sym, count(*) AS n, count(*) FILTER (length(suffix) = 7) AS n_edge FROM sfx GROUP BY ALL) WHERE NOT contains(pattern, '$')")
def interval_symbols(spark, d):
    return index.interval_symbols(R.reads(spark, d), 6)


@query("interval_reads", "q reads", "SELECT pattern, ids_rank, read_id FROM (SELECT read_id, seq, row_number() OVER (ORDER BY seq || '$', reverse(seq), read_id) - 1 AS ids_rank FROM reads) JOIN (SELECT DISTINCT left(q, 12) AS pattern FROM q WHERE length(q) >= 12) ON left(seq, 12) = pattern")
def interval_reads(spark, d):
    """Reads that begin as a query does: a backward search through the stored index, then the ids at its places in read order."""
    patterns = _targets(spark, d).filter(F.length("q") >= 12).select(F.left("q", F.lit(12)).alias("pattern")).distinct()
    return index.interval_reads(R.written(R.reads(spark, d)), patterns)


@query("pattern_lookup", "q reads", """SELECT pattern, count(*) AS width, count(*) FILTER (p = 1) AS n_start, count(*) FILTER (p = length(seq) - 15) AS n_edge FROM (SELECT seq, p, substr(seq, p, 16) AS word FROM (SELECT seq, unnest(range(1, length(seq) - 14)) AS p FROM reads))
    JOIN (SELECT DISTINCT pattern FROM (SELECT unnest([substr(q, k, 16), reverse(translate(substr(q, k, 16), 'ACGT', 'TGCA'))]) AS pattern FROM (SELECT q, unnest(range(1, length(q) - 14, 8)) AS k FROM q WHERE length(q) >= 16))) ON word = pattern GROUP BY pattern""")
def pattern_lookup(spark, d):
    """Words of 16 bases at every 8th place of each target, on both strands, looked up in the stored index."""
    words = _targets(spark, d).filter("length(q) >= 16").select("q", F.explode(F.expr("sequence(1, length(q) - 15, 8)")).alias("k")).select(F.expr("substring(q, k, 16)").alias("w"))
    return index.lookups(R.written(R.reads(spark, d)), words.select(F.explode(F.array("w", S.revcomp(F.col("w")))).alias("pattern")))


@query("rank_lookup", "bwt", "SELECT rk, " + ", ".join(f"occ_{n}" for n in ("end", "a", "c", "g", "t")) + " FROM (SELECT rk, sym, " + ", ".join(f"CAST(coalesce(sum((sym = '{s}')::INT) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS occ_{n}" for s, n in zip("$ACGT", ("end", "a", "c", "g", "t"))) + " FROM bwt) WHERE sym = '$'")
def rank_lookup(spark, d):
    """Symbols before the rank of every whole read."""
    table = index.symbol_blocks(R.reads(spark, d))
    return index.ranks_of(table, index.block_checkpoints(table), "$")


# Matching -----------------------------------------------------------------------------------------------------------


@query("exact_match", "hits", "SELECT query, read_id, q_start, q_end FROM hits")
def exact_match(spark, d):
    return _hits(spark, d)


@query("hamming_match", "near", "SELECT query, read_id, q_start, q_end, mismatches FROM near")
def hamming_match(spark, d):
    return matching.within(_targets(spark, d), _noisy(spark, d))


@query("interval_union", "hits", "SELECT query, min(q_start) AS s, max(q_end) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY query ORDER BY q_start, q_end) AS island FROM (SELECT *, CASE WHEN max(q_end) OVER (PARTITION BY query ORDER BY q_start, q_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= q_start THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT query, q_start, q_end FROM hits))) GROUP BY query, island")
def interval_union(spark, d):
    return matching.union_of_intervals(_hits(spark, d))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Queries that share reads: windows of 150 bases at every 60th of each target, and of 50 at every 70th."""

    def cut(step: int, size: int, least: int, first: int) -> DataFrame:
        k = F.explode(F.expr(f"sequence(0, greatest(length(q) - {least}, 0) div {step})"))
        each = _targets(spark, d).select("query", "q", k.alias("k"))
        return each.select((F.col("query") * 4096 + first + F.col("k")).alias("query"), F.expr(f"substring(q, k * {step} + 1, {size})").alias("q"))

    return cut(60, 150, 90, 0).unionByName(cut(70, 50, 50, 2048))


@query("match_classify", "cls", "SELECT query, read_id, class, how, q_start, q_end, r_start, r_end, len FROM cls")
def match_classify(spark, d):
    """How reads with errors and adapters lie on windows of the targets: inside, around, over an end, cut, inexact."""
    return matching.classified(_windows(spark, d), R.written(_noisy(spark, d)))


def _cut_sql(side: int) -> str:
    q, seq = ("q", "seq") if side else ("reverse(q)", "reverse(seq)")
    start = "p - 1" if side else "length(q) - p + 1 - k"
    found = f"SELECT query, read_id, q, seq, p, coalesce(list_min(list_filter(range(1, least(length(q) - p + 1, length(seq)) + 1), lambda i: substr(q, p + i - 1, 1) <> substr(seq, i, 1))) - 1, least(length(q) - p + 1, length(seq))) AS k FROM (SELECT query, q, p, substr(q, p, 24) AS seed FROM (SELECT query, q, unnest(range(1, length(q) - 22)) AS p FROM (SELECT query, {q} AS q FROM q) WHERE length(q) >= 24)) JOIN (SELECT read_id, {seq} AS seq, left({seq}, 24) AS seed FROM noisy) USING (seed)"
    return f"SELECT query, read_id, {side} AS side, {start} AS q_start, {start} + k AS q_end FROM ({found}) WHERE p - 1 + k < length(q) AND k < length(seq) AND starts_with('{S.AFTER if side else S.BEFORE}', substr(seq, k + 1, 3))"


@query("adapter_cut", "q noisy", f"SELECT query, read_id, side, q_start, q_end FROM (SELECT *, row_number() OVER (PARTITION BY query, read_id, side ORDER BY q_end - q_start DESC, q_start) AS n FROM ({_cut_sql(1)} UNION ALL {_cut_sql(0)})) WHERE n = 1")
def adapter_cut(spark, d):
    return matching.without_adapters(_targets(spark, d), _noisy(spark, d))


@query("match_compete", "cls", "SELECT query, read_id, class, len FROM cls WHERE class = 'exact' UNION ALL SELECT query, read_id, class, len FROM (SELECT *, max(CASE WHEN class = 'inexact' THEN len END) OVER (PARTITION BY read_id) AS best FROM cls WHERE class <> 'exact' AND read_id NOT IN (SELECT read_id FROM cls WHERE class = 'exact')) WHERE class = 'unmatched' AND best IS NULL OR class = 'inexact' AND len = best")
def match_compete(spark, d):
    classes = R.written(matching.classified(_windows(spark, d), R.written(_noisy(spark, d))))
    return matching.compete(classes).select("query", "read_id", "class", "len")


@query("match_dropped", "cls", """SELECT class, why, count(*) AS n FROM (SELECT class, CASE WHEN read_id IN (SELECT read_id FROM cls WHERE class = 'exact') THEN 'exact elsewhere' WHEN class = 'unmatched' THEN 'inexact elsewhere' ELSE 'longer elsewhere' END AS why
    FROM (SELECT *, max(CASE WHEN class = 'inexact' THEN len END) OVER (PARTITION BY read_id) AS best FROM cls) WHERE class <> 'exact' AND (read_id IN (SELECT read_id FROM cls WHERE class = 'exact') OR class = 'unmatched' AND best IS NOT NULL OR class = 'inexact' AND len < best)) GROUP BY ALL""")
def match_dropped(spark, d):
    """What competition drops, by class and by what stands elsewhere."""
    classes = R.written(matching.classified(_windows(spark, d), R.written(_noisy(spark, d))))
    gone = classes.join(matching.compete(classes), ["query", "read_id"], "left_anti")
    exact = classes.filter("class = 'exact'").select("read_id").distinct().withColumn("elsewhere", F.lit(True))
    why = F.when(F.col("elsewhere"), "exact elsewhere").when(F.col("class") == "unmatched", "inexact elsewhere").otherwise("longer elsewhere")
    return gone.join(exact, "read_id", "left").groupBy("class", why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("fasta_render", "hits", "SELECT query, 0 AS line_no, q AS line FROM q UNION ALL SELECT query, row_number() OVER (PARTITION BY query ORDER BY q_start, read_id) AS line_no, repeat('-', q_start) || seq || repeat('-', length(q) - q_end) AS line FROM hits JOIN reads USING (read_id) JOIN q USING (query)")
def fasta_render(spark, d):
    return matching.rendered(_targets(spark, d), R.reads(spark, d), _hits(spark, d))


# Overlap ------------------------------------------------------------------------------------------------------------


@query("overlap_join", "ol", "SELECT left_id, right_id, ol, copies FROM ol")
def overlap_join(spark, d):
    return overlap.overlaps(_classes(spark, d))


@query("overlap_counts", "ol", "SELECT left_id, CAST(sum(copies) AS BIGINT) AS n_reads, CAST(sum(ol * copies) AS BIGINT) AS n_bases FROM ol GROUP BY ALL")
def overlap_counts(spark, d):
    return overlap.overlap_counts(overlap.overlaps(_classes(spark, d)))


@query("containment_join", "pairs", "SELECT r AS inner_id, l AS outer_id, p - 1 AS start FROM pairs WHERE length(rs) < length(ls) AND substr(ls, p, length(rs)) = rs")
def containment_join(spark, d):
    return overlap.contained(_classes(spark, d))


@query("end_in_target", "c", "SELECT id, target, max(k) AS k FROM (SELECT a.id AS id, t.id AS target, list_max(list_filter(range(45, least(e, length(a.seq)) + 1), lambda k: substr(t.seq, e - k + 1, k) = right(a.seq, k))) AS k FROM (SELECT id, seq, e, substr(seq, e - 44, 45) AS seed FROM (SELECT id, seq, unnest(range(45, length(seq) + 1)) AS e FROM c)) t JOIN (SELECT id, seq, right(seq, 45) AS seed FROM c) a USING (seed) WHERE a.id <> t.id) GROUP BY ALL")
def end_in_target(spark, d):
    return overlap.ends_inside(_classes(spark, d))


@query("offset_congruence", "f", "SELECT a.frag_id AS frag_id, substr(a.seq, 51, least(length(a.seq) - 50, length(b.seq))) = left(b.seq, least(length(a.seq) - 50, length(b.seq))) AS agrees FROM f a JOIN f b ON b.frag_id = a.frag_id + 1")
def offset_congruence(spark, d):
    """Each fragment against the next of its document."""
    rows = _frags(spark, d)
    after = rows.select((F.col("frag_id") - 1).alias("frag_id"), F.col("seq").alias("b"))
    return rows.join(after, "frag_id").select("frag_id", S.congruent(F.col("seq"), F.col("b"), 50).alias("agrees"))


@query("flay_divergence", "br", "SELECT id, coord, base, cnt FROM br")
def flay_divergence(spark, d):
    return overlap.divergence(_classes(spark, d))


@query("best_branch", "br", "SELECT id, coord, count(*) AS n_branches, CASE WHEN count(*) FILTER (cnt = m) = 1 THEN max(CASE WHEN cnt = m THEN base END) END AS best FROM (SELECT *, max(cnt) OVER (PARTITION BY id, coord) AS m FROM br) GROUP BY id, coord")
def best_branch(spark, d):
    return overlap.best_branch(overlap.divergence(_classes(spark, d)))


@query("branch_cull", "br", "SELECT id, coord, base, CASE WHEN cnt < least(20, 1 + (m > 19)::INT + m // 40) THEN 0 ELSE cnt END AS cnt FROM (SELECT *, max(cnt) OVER (PARTITION BY id, coord) AS m FROM br)")
def branch_cull(spark, d):
    from pyspark.sql import Window

    most = F.max("cnt").over(Window.partitionBy("id", "coord"))
    rows = overlap.divergence(_classes(spark, d)).withColumn("m", most)
    return rows.select("id", "coord", "base", S.branch_cull(F.col("cnt"), F.col("m")).cast("long").alias("cnt"))


# Libraries ----------------------------------------------------------------------------------------------------------


@query("mate_lookup", "reads", "SELECT read_id, read_id + CASE read_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE -3 END AS mate FROM (SELECT read_id, count(*) OVER (PARTITION BY frag_id // 2) AS n FROM reads) WHERE n = 4")
def mate_lookup(spark, d):
    return libraries.mates(R.reads(spark, d))


def _libs(spark: SparkSession, d: str) -> DataFrame:
    """One library for each language, of as many documents; the size is the mean length of its texts."""
    sizes = _docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("n_chars")).alias("size"))
    return libraries.libraries(sizes.select(F.col("lang").alias("lib_id"), "size", "n"))


_LIB_SQL = "WITH s AS (SELECT lang AS lib_id, count(*) AS n, CAST(floor(avg(n_chars)) AS BIGINT) AS size FROM documents GROUP BY lang), l AS (SELECT lib_id, size, CAST(sum(n) OVER (ORDER BY lib_id) AS BIGINT) AS end_count, CAST(greatest(size // 5 - 100, 1) AS BIGINT) AS min_dist, CAST(floor(size * 1.2::DOUBLE + 200) AS BIGINT) AS max_dist, CAST(sum(n) OVER (ORDER BY lib_id) - n AS BIGINT) AS beg FROM s)"


@query("lib_stats", sql=_LIB_SQL + " SELECT lib_id, size, end_count, min_dist, max_dist FROM l")
def lib_stats(spark, d):
    return _libs(spark, d)


@query("lib_range_join", sql=_LIB_SQL + " SELECT doc_id AS id, lib_id FROM documents LEFT JOIN l ON doc_id >= beg AND doc_id < end_count")
def lib_range_join(spark, d):
    return libraries.library_of(_docs(spark, d).select(F.col("doc_id").alias("id")), _libs(spark, d))


@query("mate_direction", "reads", "SELECT read_id, CASE o WHEN 0 THEN 2 WHEN 3 THEN 1 - strand ELSE strand END AS side, CASE o WHEN 0 THEN true WHEN 2 THEN strand = 1 WHEN 3 THEN strand <> 1 ELSE false END AS marks FROM (SELECT read_id, strand, length(seq) % 4 AS o FROM reads)")
def mate_direction(spark, d):
    """Sides of mates, for libraries of every orientation (here by a read's length)."""
    o = F.length("seq") % 4
    return R.reads(spark, d).select("read_id", libraries.direction(F.col("read_id"), o).alias("side"), libraries.marks_mate(F.col("strand"), F.lit(1), o).alias("marks"))


# Scalars ------------------------------------------------------------------------------------------------------------


@query("homopolymer_len", "reads", "SELECT read_id, CAST(length(seq) - length(rtrim(seq, right(seq, 1))) AS BIGINT) AS run FROM reads")
def homopolymer_len(spark, d):
    return R.reads(spark, d).select("read_id", S.end_run(F.col("seq")).alias("run"))


@query("homopolymer_score", "reads", "SELECT read_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(seq, 'AAA+|CCC+|GGG+|TTT+'), lambda x: length(x) - 2)), 0) AS BIGINT) AS score FROM reads")
def homopolymer_score(spark, d):
    return R.reads(spark, d).select("read_id", S.run_score(F.col("seq")).alias("score"))


@query("end_trim", "reads", "SELECT read_id, CAST(coalesce(list_max(list_filter(range(1, 14), lambda k: right(seq, k) = left('AGATCGGAAGAGC', k))), 0) AS BIGINT) AS cut, CAST(coalesce(list_max(list_filter(range(1, 14), lambda k: left(seq, k) = right('AGATCGGAAGAGC', k))), 0) AS BIGINT) AS cut_left FROM reads")
def end_trim(spark, d):
    """Overlap of a read's end with the start of an adapter, and of its start with the adapter's end."""
    adapter = F.lit("AGATCGGAAGAGC")
    return R.reads(spark, d).select("read_id", S.overlap_length(F.col("seq"), adapter, 1).cast("int").alias("cut"), S.overlap_length(adapter, F.col("seq"), 1).cast("int").alias("cut_left"))


@query("symbol_codes", "reads", "SELECT read_id, CAST(strpos('ACGT', left(seq, 1)) - 1 AS BIGINT) AS first_code, CAST(strpos('ACGT', right(seq, 1)) - 1 AS BIGINT) AS last_code FROM reads")
def symbol_codes(spark, d):
    return R.reads(spark, d).select("read_id", S.symbol_code(F.left("seq", F.lit(1))).alias("first_code"), S.symbol_code(F.right("seq", F.lit(1))).alias("last_code"))


# Coverage and graphs ------------------------------------------------------------------------------------------------


@query("depth_per_base", "perbase", "SELECT query, pos, depth FROM perbase")
def depth_per_base(spark, d):
    return coverage.depth(_hits(spark, d))


@query("median_coverage", "perbase", "SELECT query, count(*) AS covered, round(median(depth), 6) AS coverage FROM perbase GROUP BY ALL")
def median_coverage(spark, d):
    return coverage.median_depth(coverage.depth(_hits(spark, d)))


@query("coverage_summary", "q perbase", "SELECT count(*) AS asked, count(*) FILTER (coverage IS NULL) AS unmatched, round(median(coverage), 6) AS coverage FROM q LEFT JOIN (SELECT query, round(median(depth), 6) AS coverage FROM perbase GROUP BY ALL) USING (query)")
def coverage_summary(spark, d):
    """Queries asked, those that no read stands on, and the median of the others' coverage."""
    medians = coverage.median_depth(coverage.depth(_hits(spark, d)))
    return coverage.summary(_targets(spark, d), medians)


@query("top_loci", "perbase", "SELECT row_number() OVER (ORDER BY covered DESC, query) AS place, query, covered, coverage FROM (SELECT query, count(*) AS covered, round(median(depth), 6) AS coverage FROM perbase GROUP BY ALL) ORDER BY covered DESC, query LIMIT 10")
def top_loci(spark, d):
    return coverage.longest_first(coverage.median_depth(coverage.depth(_hits(spark, d))), 10)


def _near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Reads placed with mismatches, beside the stretch of the query that they stand on."""
    targets, rows = _targets(spark, d), _noisy(spark, d)
    near = matching.within(targets, rows).filter("mismatches > 0").join(targets, "query").join(rows.select("read_id", "seq"), "read_id")
    return near.select(F.col("query").alias("a_id"), F.expr("substring(q, q_start + 1, q_end - q_start)").alias("a"), F.col("read_id").alias("b_id"), F.col("seq").alias("b"))


@query("mem_align")
def mem_align(spark, d):
    """Reads placed with mismatches, aligned with the stretch of the query that they stand on."""
    return align.aligned(_near_pairs(spark, d))


def _overhangs(spark: SparkSession, d: str) -> DataFrame:
    rows = _classes(spark, d)
    found = overlap.overlaps(rows).join(rows.select(F.col("id").alias("right_id"), "seq"), "right_id")
    return found.select(F.col("left_id").alias("key"), F.expr("substring(seq, ol + 1)").alias("ext"))


@query("maximal_matches", "q noisy near", """SELECT a_id, b_id, count(*) AS n_mems, max(len) AS longest FROM (SELECT a_id, b_id, i - j AS diagonal, i - n AS island, count(*) AS len FROM (
        SELECT *, row_number() OVER (PARTITION BY a_id, b_id, i - j ORDER BY i) AS n FROM (SELECT *, unnest(range(1, length(b) + 1)) AS j FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM
        (SELECT DISTINCT query AS a_id, substr(q, q_start + 1, q_end - q_start) AS a, read_id AS b_id, seq AS b FROM near JOIN q USING (query) JOIN noisy USING (read_id) WHERE mismatches > 0)))
        WHERE substr(a, i, 1) = substr(b, j, 1)) GROUP BY ALL) WHERE len >= 15 GROUP BY ALL""")
def maximal_matches(spark, d):
    """Maximal exact matches of reads placed with mismatches and their stretch of the query, over all diagonals."""
    return mem_align(spark, d).filter("n_mems > 0").select("a_id", "b_id", "n_mems", "longest")


@query("shared_reads", "hits", "SELECT a.query AS a, b.query AS b, count(*) AS n FROM (SELECT DISTINCT query, read_id FROM hits) a JOIN (SELECT DISTINCT query, read_id FROM hits) b USING (read_id) WHERE a.query < b.query GROUP BY ALL")
def shared_reads(spark, d):
    return align.shared_ids(_hits(spark, d))


@query("fasta_scan", "f", "SELECT CAST(frag_id AS VARCHAR) AS header, seq FROM f")
def fasta_scan(spark, d):
    """Fragments written as FASTA files and scanned again."""
    path = R.shared_folder(spark)
    _frags(spark, d).select(F.explode(F.array(F.concat(F.lit(">"), F.col("frag_id").cast("string")), F.col("seq"))).alias("line")).write.text(path)
    return R.read_files(spark, [path]).select("header", "seq")


@query("extension_trie", "ol c", """SELECT key, path, CAST(sum(n) AS BIGINT) AS n_reads FROM (SELECT key, left(ext, k) AS path, substr(ext, k + 1, 1) AS nx, count(*) AS n FROM (
        SELECT key, ext, unnest(range(1, length(ext) + 1)) AS k FROM (SELECT left_id AS key, substr(seq, CAST(ol AS BIGINT) + 1) AS ext FROM ol JOIN c ON c.id = right_id)) GROUP BY ALL) GROUP BY ALL HAVING bool_or(nx = '') OR count(*) > 1""")
def extension_trie(spark, d):
    """Overhangs of the reads that overlap each read's end, merged."""
    return align.tries(_overhangs(spark, d))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    targets, rows = _targets(spark, d), R.written(_noisy(spark, d))
    near = matching.based(matching.within(targets, rows), targets, rows)
    return near.select(F.col("query").alias("locus"), "seq", F.col("q_start").alias("start"))


_PATHS_SQL = steps("near noisy", """, nd AS MATERIALIZED (SELECT query AS locus, seq, md5(seq) AS id, min(q_start) AS start, count(*) AS n FROM near JOIN noisy USING (read_id) GROUP BY query, seq),
    pr AS MATERIALIZED (SELECT a.locus, a.id AS l, b.id AS r, a.start AS ls, a.seq AS lseq, b.start AS rs, b.n AS rn, length(a.seq) - p + 1 AS ol, length(b.seq) <= length(a.seq) - p + 1 AS inside
        FROM (SELECT *, unnest(range(1, length(seq) - 28)) AS p FROM nd) a JOIN nd b ON a.locus = b.locus AND substr(a.seq, p, 30) = left(b.seq, 30) AND a.id <> b.id
        WHERE starts_with(substr(a.seq, p), b.seq) OR starts_with(b.seq, substr(a.seq, p))),
    inn AS (SELECT DISTINCT locus, r AS id FROM pr WHERE inside),
    host AS (SELECT locus, r, arg_min(l, (ls, lseq)) AS id, any_value(rn) AS more FROM pr WHERE inside AND (locus, l) NOT IN (SELECT locus, id FROM inn) GROUP BY locus, r),
    n1 AS MATERIALIZED (SELECT locus, id, seq, n + coalesce(more, 0) AS n FROM nd LEFT JOIN (SELECT locus, id, sum(more) AS more FROM host GROUP BY ALL) USING (locus, id) WHERE (locus, id) NOT IN (SELECT locus, id FROM inn)),
    edges AS MATERIALIZED (SELECT locus, l, r, max(ol) AS ol FROM pr WHERE NOT inside AND ol >= 30 AND ls < rs AND (locus, l) NOT IN (SELECT locus, id FROM inn) AND (locus, r) NOT IN (SELECT locus, id FROM inn) GROUP BY ALL),
    WALK1, n2 AS MATERIALIZED (SELECT locus, id, seq, CASE WHEN list_contains(b.ids, id) THEN 0 ELSE n END AS n FROM n1 JOIN b1 USING (locus)),
    WALK2 SELECT locus, 1::BIGINT AS rank, b.seq AS seq, CAST(-b.v AS BIGINT) AS n_reads FROM b1 UNION ALL SELECT locus, 2, b.seq, CAST(-b.v AS BIGINT) FROM b2 WHERE b.v < 0""").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , nd AS", "), nd AS", 1)
#: The heaviest walks by levels of edges, over all nodes and over those that the first walk leaves.
_WALK_SQL = """{w}(locus, id, v, seq, ids, k) AS (SELECT locus, id, CAST(n AS BIGINT), seq, [id], 1 FROM {n} UNION ALL SELECT locus, id, CAST(-b.v AS BIGINT), b.seq, b.ids, k FROM (
        SELECT w.locus, e.r AS id, min({{'v': -(w.v + m.n), 'seq': w.seq || substr(m.seq, CAST(e.ol AS BIGINT) + 1), 'ids': w.ids || [e.r]}}) AS b, any_value(w.k) + 1 AS k FROM {w} w JOIN edges e ON e.locus = w.locus AND e.l = w.id JOIN {n} m ON m.locus = e.locus AND m.id = e.r GROUP BY w.locus, e.r)),
    {b} AS (SELECT locus, min({{'v': -v, 'k': k, 'seq': seq, 'ids': ids}}) AS b FROM {w} GROUP BY locus)"""
for _i in "12":
    _PATHS_SQL = _PATHS_SQL.replace(f"WALK{_i}", _WALK_SQL.format(w=f"w{_i}", n=f"n{_i}", b=f"b{_i}"))


@query("graph_paths", sql=_PATHS_SQL)
def graph_paths(spark, d):
    """The two heaviest paths through the reads placed on each query."""
    return align.paths(_placed(spark, d))


#: Gates of the queries on loci for the stand-in reads, which are no longer than 100 bases and lie 50 apart: shortest read, least length of an allele, reads that speak for a third.
LOCUS = {"read_length": 45, "least_length": 100, "least_rivals": 2}

_LOCI_SQL = _PATHS_SQL[: _PATHS_SQL.index(" SELECT locus, 1::BIGINT AS rank")] + f""",
    wk AS MATERIALIZED (SELECT locus, 0 AS allele, b.seq AS q FROM b1 UNION ALL SELECT locus, 1, b.seq FROM b2 WHERE b.v < 0),
    al AS MATERIALIZED (SELECT * FROM wk WHERE locus IN (SELECT locus FROM b2 WHERE b.v < 0)),
    again AS MATERIALIZED (SELECT * FROM (SELECT locus, allele, read_id, q, seq, st, hamming(substr(q, st + 1, length(seq)), seq) AS off FROM (SELECT *, unnest(range(0, length(q) - length(seq) + 1)) AS st FROM al JOIN noisy ON length(seq) <= length(q))) WHERE off <= length(seq) // 16),
    odd AS (SELECT locus, allele, st + i AS pos, substr(seq, CAST(i AS BIGINT), 1) AS base FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY locus, read_id ORDER BY off, allele, st) AS place FROM again) WHERE place = 1) WHERE substr(seq, CAST(i AS BIGINT), 1) <> substr(q, CAST(st + i AS BIGINT), 1)),
    third AS (SELECT DISTINCT locus FROM (SELECT locus FROM odd GROUP BY locus, allele, pos, base HAVING count(*) >= {LOCUS["least_rivals"]})),
    one AS (SELECT locus, allele, s, s + n AS e, 1.0::DOUBLE / count(*) OVER (PARTITION BY locus, read_id) AS share FROM (SELECT locus, allele, read_id, min(st) AS s, any_value(length(seq)) AS n FROM again WHERE off = 0 GROUP BY ALL)),
    med AS (SELECT locus, allele, median(level) AS m FROM (SELECT locus, allele, pos, (SELECT round(coalesce(sum(share), 0), 6) FROM one WHERE one.locus = p.locus AND one.allele = p.allele AND s <= pos AND pos < e) AS level
        FROM (SELECT locus, allele, unnest(range({LOCUS["read_length"] - 1}, length(q) - {LOCUS["read_length"] - 1})) AS pos FROM al WHERE length(q) + 1 >= {2 * LOCUS["read_length"]}) p) GROUP BY ALL),
    dep AS (SELECT locus, round(sum(m), 6) AS coverage, max(m) <= 1.5::DOUBLE * min(m) AS level FROM med GROUP BY locus HAVING count(*) = 2),
    lens AS (SELECT locus, min(length(q)) AS len FROM al GROUP BY locus),
    rd AS (SELECT q.query AS locus, length(q) AS n, (SELECT count(DISTINCT read_id) FROM near WHERE near.query = q.query) AS n_reads FROM q)
    SELECT locus, n_reads, CAST(coalesce(len, 0) AS BIGINT) AS len, CASE WHEN verdict IN ('miscovered', 'good') THEN coverage END AS coverage, verdict FROM (SELECT locus, n_reads, len, coverage, CASE WHEN n_reads = 0 OR n_reads >= 2000 THEN 'unmatched' WHEN n_reads > (n + 1 - {LOCUS["read_length"]}) * 20 THEN 'nondiploid'
        WHEN len IS NULL OR locus IN (SELECT locus FROM third) THEN 'nondiploid' WHEN len < {LOCUS["least_length"]} THEN 'short' WHEN NOT coalesce(level, false) THEN 'miscovered' ELSE 'good' END AS verdict FROM rd LEFT JOIN lens USING (locus) LEFT JOIN dep USING (locus))"""


@query("locus_gates", sql=_LOCI_SQL)
def locus_gates(spark, d):
    """Every query with the verdict on its two walks, without the gate on similarity."""
    return loci.judged(_targets(spark, d), R.written(_noisy(spark, d)), least_similarity=None, **LOCUS)


@query("locus_tally", sql=f"""SELECT count(*) AS queried, count(*) FILTER (verdict = 'unmatched') AS unmatched, count(*) FILTER (verdict = 'nondiploid') AS nondiploid, count(*) FILTER (verdict = 'short') AS short, count(*) FILTER (verdict = 'miscovered') AS miscovered,
    count(*) FILTER (verdict = 'dissimilar') AS dissimilar, count(*) FILTER (verdict = 'good') AS good, round(median(coverage) FILTER (verdict = 'good'), 6) AS coverage FROM ({_LOCI_SQL})""")
def locus_tally(spark, d):
    """How many queries fell at each gate, and the median coverage of those that passed."""
    return loci.tally(locus_gates(spark, d))


@query("coverage_loci")
def coverage_loci(spark, d):
    """Queries whose two walks pass all gates, similarity included, with their coverage."""
    return loci.judged(_targets(spark, d), R.written(_noisy(spark, d)), **LOCUS).filter("verdict = 'good'").select("locus", "len", "similarity", "coverage")


# Checks and gates ---------------------------------------------------------------------------------------------------


@query("valid_sequence", "f", "SELECT frag_id, regexp_full_match(CASE frag_id % 3 WHEN 0 THEN seq || 'x' WHEN 1 THEN seq || 'N' ELSE seq END, '[ACGTN]*') AS valid FROM f")
def valid_sequence(spark, d):
    """Fragments, some with an N or another letter at the end."""
    tail = F.when(F.col("frag_id") % 3 == 0, "x").when(F.col("frag_id") % 3 == 1, "N").otherwise("")
    return _frags(spark, d).select("frag_id", S.is_sequence(F.concat("seq", tail)).alias("valid"))


_CONGRUENT_SQL = """CASE WHEN least(length(l), length(r)) < 45 THEN 0
    WHEN length(l) < length(r) THEN CASE WHEN strpos(r, right(l, 45)) > 0 AND substr(r, strpos(r, right(l, 45)) - least(length(l) - 45, strpos(r, right(l, 45)) - 1), 45 + least(length(l) - 45, strpos(r, right(l, 45)) - 1)) = right(l, 45 + least(length(l) - 45, strpos(r, right(l, 45)) - 1)) THEN 45 + least(length(l) - 45, strpos(r, right(l, 45)) - 1) ELSE 0 END
    WHEN strpos(l, left(r, 45)) > 0 AND substr(l, strpos(l, left(r, 45)), least(length(l) - strpos(l, left(r, 45)) + 1, length(r))) = left(r, least(length(l) - strpos(l, left(r, 45)) + 1, length(r))) THEN least(length(l) - strpos(l, left(r, 45)) + 1, length(r)) ELSE 0 END"""


@query("congruent_overlap", "f", f"SELECT frag_id, strand, CAST({_CONGRUENT_SQL} AS BIGINT) AS agree FROM (SELECT a.frag_id AS frag_id, 0::BIGINT AS strand, a.seq AS l, b.seq AS r FROM f a JOIN f b ON b.frag_id = a.frag_id + 1 UNION ALL SELECT a.frag_id, 1, reverse(translate(b.seq, 'ACGT', 'TGCA')), reverse(translate(a.seq, 'ACGT', 'TGCA')) FROM f a JOIN f b ON b.frag_id = a.frag_id + 1)")
def congruent_overlap(spark, d):
    """Each fragment and the next of its document, on both strands."""
    rows = _frags(spark, d)
    pairs = rows.join(rows.select((F.col("frag_id") - 1).alias("frag_id"), F.col("seq").alias("after")), "frag_id")
    sides = F.array(F.struct(F.lit(0).alias("strand"), F.col("seq").alias("l"), F.col("after").alias("r")), F.struct(F.lit(1).alias("strand"), S.revcomp(F.col("after")).alias("l"), S.revcomp(F.col("seq")).alias("r")))
    return pairs.select("frag_id", F.explode(sides).alias("x")).select("frag_id", "x.strand", S.congruence(F.col("x.l"), F.col("x.r"), 45).alias("agree"))


@query("end_offsets", "reads", "SELECT tail, cnt, CAST(sum(cnt) OVER (ORDER BY tail) - cnt AS BIGINT) AS start FROM (SELECT right(seq, 2) AS tail, count(*) AS cnt FROM reads GROUP BY ALL)")
def end_offsets(spark, d):
    return index.end_offsets(R.reads(spark, d))


@query("kmer_onward", "reads", f"SELECT kmer, a.cnt AS cnt, edge, coalesce(onward, 0) AS onward, a.cnt = edge + coalesce(onward, 0) AS holds FROM ({_kmer_sql(8)}) a LEFT JOIN (SELECT left(kmer, 8) AS kmer, CAST(sum(cnt) AS BIGINT) AS onward FROM ({_kmer_sql(9)}) GROUP BY ALL) USING (kmer)")
def kmer_onward(spark, d):
    return index.onward(R.reads(spark, d), 8)


@query("ids_beyond", "near", "SELECT DISTINCT query, read_id FROM near WHERE q_end < 120")
def ids_beyond(spark, d):
    return matching.ids_beyond(matching.within(_targets(spark, d), _noisy(spark, d)), 120, end=True, after=False)


@query("hits_astray", "q noisy near", "SELECT query, count(*) AS n, count(*) FILTER (strpos(q, seq) = 0) AS n_outside FROM (SELECT DISTINCT query, read_id FROM near) JOIN noisy USING (read_id) JOIN q USING (query) GROUP BY query")
def hits_astray(spark, d):
    """Placements with mismatches allowed, so that some reads do not stand in their query as they are."""
    targets, rows = _targets(spark, d), _noisy(spark, d)
    return matching.astray(targets, rows, matching.within(targets, rows))


@query("inexact_render", "q noisy near", "SELECT query, 0 AS line_no, q AS line FROM q UNION ALL SELECT query, row_number() OVER (PARTITION BY query ORDER BY q_start, read_id) AS line_no, repeat('-', q_start) || seq || repeat('-', length(q) - q_end) AS line FROM near JOIN noisy USING (read_id) JOIN q USING (query)")
def inexact_render(spark, d):
    targets, rows = _targets(spark, d), _noisy(spark, d)
    return matching.rendered(targets, rows, matching.within(targets, rows))


@query("match_conflicts", "q noisy near", """SELECT a_id, b_id, count(*) AS n_mems, count(*) FILTER (i < li OR j < lj) AS n_conflicts FROM (SELECT *, lag(i + len) OVER w AS li, lag(j + len) OVER w AS lj FROM (
        SELECT a_id, b_id, a, min(i) AS i, min(j) AS j, count(*) AS len FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id, a, i - j ORDER BY i) AS n FROM (SELECT *, unnest(range(1, length(b) + 1)) AS j FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM
        (SELECT DISTINCT query AS a_id, substr(q, q_start + 1, q_end - q_start) AS a, read_id AS b_id, seq AS b FROM near JOIN q USING (query) JOIN noisy USING (read_id) WHERE mismatches > 0)))
        WHERE substr(a, i, 1) = substr(b, j, 1)) GROUP BY a_id, b_id, a, i - j, i - n HAVING count(*) >= 4) WINDOW w AS (PARTITION BY a_id, b_id, a ORDER BY i, j)) GROUP BY a_id, b_id""")
def match_conflicts(spark, d):
    """Matches of four bases or more, short enough to stand out of order."""
    return align.conflicts(align.matches(_near_pairs(spark, d), 4))


@query("branch_tries", "pairs", """SELECT key, path, CAST(sum(n) AS BIGINT) AS n_reads FROM (SELECT key, left(ext, k) AS path, substr(ext, k + 1, 1) AS nx, count(*) AS n FROM (SELECT key, ext, unnest(range(1, length(ext) + 1)) AS k FROM (
        SELECT l || ':' || (p + m - 2) AS key, substr(rs, CAST(m AS BIGINT)) AS ext FROM (SELECT *, list_min(list_filter(range(1, least(length(ls) - p + 1, length(rs)) + 1), lambda i: substr(ls, p + i - 1, 1) <> substr(rs, i, 1))) AS m FROM pairs) WHERE m IS NOT NULL)) GROUP BY ALL) GROUP BY ALL HAVING bool_or(nx = '') OR count(*) > 1""")
def branch_tries(spark, d):
    """What reads go on with where they part from another, merged for each such place."""
    return align.tries(overlap.branches_ahead(_classes(spark, d)))


@query("shallow_loci", "hits", "SELECT query, count(DISTINCT read_id) AS n_reads FROM hits GROUP BY query HAVING count(DISTINCT read_id) < 2000")
def shallow_loci(spark, d):
    return coverage.shallow(_hits(spark, d))


@query("allele_coverage", "q near", """SELECT locus, round(sum(m), 6) AS coverage, max(m) <= 1.5::DOUBLE * min(m) AS kept FROM (SELECT locus, allele, median(level) AS m FROM (
        SELECT *, round(sum(step) OVER (PARTITION BY locus, allele ORDER BY pos), 6) AS level FROM (SELECT locus, allele, pos, sum(step) AS step, bool_or(asked) AS asked FROM (
        SELECT query // 2 AS locus, query % 2 AS allele, unnest([q_start, q_end]) AS pos, unnest([share, -share]) AS step, false AS asked FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY query // 2, read_id) AS share FROM near)
        UNION ALL SELECT query // 2, query % 2, unnest(range(44, length(q) - 44)), 0.0, true FROM q WHERE length(q) >= 89) GROUP BY ALL)) WHERE asked GROUP BY ALL) GROUP BY locus HAVING count(*) = 2""")
def allele_coverage(spark, d):
    """Neighbouring queries taken as the two alleles of a locus."""
    split = [F.floor(F.col("query") / 2).alias("locus"), (F.col("query") % 2).alias("allele")]
    targets = _targets(spark, d)
    near = matching.within(targets, _noisy(spark, d))
    placed = near.select(*split, "read_id", F.col("q_start").alias("start"), F.col("q_end").alias("end"))
    return coverage.alleles(placed, targets.select(*split, F.length("q").alias("n")), 45)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _classes(spark, d)
    return rows, overlap.overlaps(rows)


@query("graph_degrees", "c ol", "SELECT id, copies, n_in, n_out, n_in + n_out > 0 OR copies > 2 AS kept FROM (SELECT id, copies, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out FROM c LEFT JOIN (SELECT right_id AS id, count(*) AS i FROM ol GROUP BY ALL) USING (id) LEFT JOIN (SELECT left_id AS id, count(*) AS o FROM ol GROUP BY ALL) USING (id))")
def graph_degrees(spark, d):
    return graph.degrees(*_graph(spark, d))


@query("graph_unbranched", "ol", "SELECT left_id, right_id, ol FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS o, count(*) OVER (PARTITION BY right_id) AS i FROM ol) WHERE o = 1 AND i = 1")
def graph_unbranched(spark, d):
    return graph.unbranched(_graph(spark, d)[1])


@query("graph_support", "c ol", """SELECT id, cover, coalesce(sl, 0) AS strong_left, coalesce(sr, 0) AS strong_right, cover >= 3 AS substantial, least(coalesce(sl, 0), coalesce(sr, 0)) < 60 AS weak FROM (
        SELECT id, CAST(max(level) AS BIGINT) AS cover FROM (SELECT id, sum(sum(step)) OVER (PARTITION BY id ORDER BY pos) AS level FROM (SELECT id, unnest([0, length(seq)]) AS pos, unnest([copies, -copies]) AS step FROM c
        UNION ALL SELECT left_id, unnest([length(seq) - ol, length(seq)]), unnest([ol.copies, -ol.copies]) FROM ol JOIN c ON id = left_id UNION ALL SELECT right_id, unnest([0, ol]), unnest([c.copies, -c.copies]) FROM ol JOIN c ON id = left_id) GROUP BY id, pos) GROUP BY id)
        LEFT JOIN (SELECT right_id AS id, max(ol) AS sl FROM ol GROUP BY ALL) USING (id) LEFT JOIN (SELECT left_id AS id, max(ol) AS sr FROM ol GROUP BY ALL) USING (id)""")
def graph_support(spark, d):
    return graph.support(*_graph(spark, d))


@query("graph_violations", "c ol", "SELECT count(*) AS edges, count(*) FILTER (left_id = right_id) AS loops, count(*) FILTER (ol >= length(a.seq) OR ol >= length(b.seq)) AS improper, count(*) FILTER (right(a.seq, CAST(ol AS BIGINT)) <> left(b.seq, CAST(ol AS BIGINT))) AS unequal FROM ol JOIN c a ON a.id = left_id JOIN c b ON b.id = right_id")
def graph_violations(spark, d):
    return graph.violations(*_graph(spark, d))


_MERGED_SQL = steps("c ol", """, u AS (SELECT left_id, right_id, ol FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS o, count(*) OVER (PARTITION BY right_id) AS i FROM ol) WHERE o = 1 AND i = 1),
    walk(head, id, k, ol) AS (SELECT id, id, 0, 0::BIGINT FROM c WHERE id NOT IN (SELECT right_id FROM u) UNION ALL SELECT head, u.right_id, k + 1, CAST(u.ol AS BIGINT) FROM walk JOIN u ON u.left_id = walk.id),
    ring(a, b) AS (SELECT left_id, right_id FROM u WHERE left_id NOT IN (SELECT id FROM walk) UNION SELECT a, u.right_id FROM ring JOIN u ON u.left_id = b),
    round(head, id, k, ol) AS (SELECT a, a, 0, 0::BIGINT FROM ring GROUP BY a HAVING min(b) = a UNION ALL SELECT head, u.right_id, k + 1, CAST(u.ol AS BIGINT) FROM round JOIN u ON u.left_id = round.id WHERE u.right_id <> head)
    SELECT head AS id, count(*) AS n_nodes, CAST(sum(copies) AS BIGINT) AS copies, CAST(sum(length(tail)) AS BIGINT) AS len, string_agg(tail, '' ORDER BY k) AS seq FROM (SELECT head, k, copies, substr(seq, ol + 1) AS tail FROM (SELECT * FROM walk UNION ALL SELECT * FROM round) JOIN c USING (id)) GROUP BY head""").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , u AS", "), u AS", 1)


@query("graph_merged", sql=_MERGED_SQL)
def graph_merged(spark, d):
    """The overlap graph with its unbranched chains merged into single nodes."""
    rows = R.written(_classes(spark, d))
    return graph.merged(rows, overlap.overlaps(rows))


_LOCUS_SQL = steps("c q", """, loci AS (SELECT query AS locus, substr(q, length(q) // 2 - 49, 100) AS seq FROM q WHERE length(q) >= 100),
    rd AS MATERIALIZED (SELECT id, copies, 1 AS side, seq, left(seq, 50) AS seed FROM c WHERE length(seq) > 50 UNION ALL SELECT id, copies, 0, reverse(seq), left(reverse(seq), 50) FROM c WHERE length(seq) > 50),
    st(locus, side, seq, r) AS (SELECT locus, 1, seq, 0 FROM loci UNION ALL SELECT locus, 0, reverse(seq), 0 FROM loci UNION ALL
        SELECT locus, side, any_value(s) || max(path) FILTER (n_paths = 1 AND k < coalesce(fork, 1000)), any_value(r) + 1 FROM (
            SELECT *, min(CASE WHEN n_paths > 1 THEN k END) OVER (PARTITION BY locus, side) AS fork FROM (SELECT locus, side, k, any_value(s) AS s, any_value(r) AS r, count(*) AS n_paths, max(path) AS path FROM (
                SELECT locus, side, k, left(ext, k) AS path, any_value(s) AS s, any_value(r) AS r FROM (SELECT *, unnest(range(1, length(ext) + 1)) AS k FROM (
                    SELECT locus, side, st_seq AS s, r, copies, substr(seq, CAST(max(ol) AS BIGINT) + 1) AS ext FROM (
                        SELECT e.locus, e.side, e.seq AS st_seq, e.r, e.ol, rd.id, rd.copies, rd.seq FROM (SELECT *, unnest(range(50, least(length(seq), 99) + 1)) AS ol FROM st) e JOIN rd ON rd.side = e.side AND rd.seed = substr(e.seq, length(e.seq) - e.ol + 1, 50)
                        WHERE length(rd.seq) > e.ol AND right(e.seq, e.ol) = left(rd.seq, e.ol) AND NOT contains(e.seq, rd.seq)) GROUP BY locus, side, st_seq, r, id, copies, seq))
                GROUP BY locus, side, k, left(ext, k) HAVING sum(copies) >= 2) GROUP BY locus, side, k))
        GROUP BY locus, side HAVING max(path) FILTER (n_paths = 1 AND k < coalesce(fork, 1000)) IS NOT NULL),
    fin AS (SELECT locus, side, arg_max(seq, r) AS s, max(r) AS r FROM st GROUP BY ALL)
    SELECT locus, reverse(substr(a.s, 101)) || b.s AS seq, length(a.s) - 100 AS to_left, length(b.s) - 100 AS to_right, CAST(greatest(a.r, b.r) AS BIGINT) AS rounds FROM (SELECT * FROM fin WHERE side = 0) a JOIN (SELECT * FROM fin WHERE side = 1) b USING (locus)""").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , loci AS", "), loci AS", 1)


@query("locus_extended", sql=_LOCUS_SQL)
def locus_extended(spark, d):
    """The middle hundred bases of every query, extended over both ends by the reads that agree there."""
    loci = _targets(spark, d).filter(F.length("q") >= 100).select(F.col("query").alias("locus"), F.expr("substring(q, length(q) div 2 - 49, 100)").alias("seq"))
    return locus.extended(loci, R.written(_classes(spark, d)))


_WALKED_SQL = steps("c ol", """, step AS MATERIALIZED (SELECT 1 AS side, left_id AS here, right_id AS nx, ol FROM ol UNION ALL SELECT 0, right_id, left_id, ol FROM ol),
    rc(id, side, nx, ol) AS (SELECT here, side, nx, CAST(ol AS BIGINT) FROM step WHERE here <> nx UNION SELECT rc.id, rc.side, step.nx, CAST(rc.ol - length(c.seq) + step.ol AS BIGINT) FROM rc JOIN c ON c.id = rc.nx JOIN step ON step.side = rc.side AND step.here = rc.nx WHERE rc.ol - length(c.seq) + step.ol > 0 AND step.nx <> rc.id),
    far AS (SELECT id, side, nx, max(ol) AS ol FROM rc GROUP BY ALL), near_ AS (SELECT here AS id, side, nx, ol FROM step WHERE here <> nx),
    laid AS (SELECT w, id, CASE side WHEN 1 THEN length(seq) - ol ELSE 0 END AS lo, CASE side WHEN 1 THEN length(seq) ELSE ol END AS hi, reads FROM (SELECT 'far' AS w, * FROM far UNION ALL SELECT 'near', * FROM near_) JOIN (SELECT id, seq FROM c) USING (id) JOIN (SELECT id AS nx, copies AS reads FROM c) USING (nx)
        UNION ALL SELECT w, id, 0, length(seq), copies FROM c, (SELECT unnest(['far', 'near']) AS w)),
    cover AS (SELECT w, id, max(level) AS cover FROM (SELECT w, id, sum(sum(s)) OVER (PARTITION BY w, id ORDER BY pos) AS level FROM (SELECT w, id, unnest([lo, hi]) AS pos, unnest([reads, -reads]) AS s FROM laid) GROUP BY w, id, pos) GROUP BY ALL)
    SELECT id, bool_or(w = 'near' AND cover >= 4) AS direct, bool_or(cover >= 4) AS substantial FROM cover GROUP BY id""").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , step AS", "), step AS", 1)


@query("graph_walked_support", sql=_WALKED_SQL)
def graph_walked_support(spark, d):
    """Nodes with four reads over one base, by their neighbours and by walks on."""
    rows = R.written(_classes(spark, d))
    return graph.walked_support(rows, R.written(overlap.overlaps(rows)), 4)


_TIPS_SQL = (
    _MERGED_SQL[: _MERGED_SQL.index(", u AS (")]
    + """, e AS MATERIALIZED (SELECT left_id, right_id, ol, ol.copies AS rc, c.copies AS lc FROM ol JOIN c ON c.id = left_id),
    u AS MATERIALIZED (SELECT left_id, right_id, ol FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY ol DESC, rc DESC, right_id) AS a, row_number() OVER (PARTITION BY right_id ORDER BY ol DESC, lc DESC, left_id) AS b FROM e) WHERE a = 1 AND b = 1)"""
    + _MERGED_SQL[_MERGED_SQL.index(",\n    walk(head") : _MERGED_SQL.index("\n    SELECT head AS id")]
    + """, pl AS MATERIALIZED (SELECT id, head AS chain FROM (SELECT head, id FROM walk UNION ALL SELECT head, id FROM round)), rd AS MATERIALIZED (SELECT chain, CAST(sum(copies) AS BIGINT) AS reads FROM pl JOIN c USING (id) GROUP BY chain),
    jn AS (SELECT DISTINCT a.chain AS l, b.chain AS r FROM e JOIN pl a ON a.id = left_id JOIN pl b ON b.id = right_id WHERE a.chain <> b.chain),
    sd AS (SELECT chain, reads, (SELECT max(x.reads) FROM jn JOIN rd x ON x.chain = jn.r WHERE jn.l = rd.chain) AS after, (SELECT max(x.reads) FROM jn JOIN rd x ON x.chain = jn.l WHERE jn.r = rd.chain) AS before FROM rd)
    SELECT id, chain, reads, beside, (after IS NULL OR before IS NULL) AND reads < beside AND reads <= 1 + CAST(beside > 9 AS INT) + CAST(beside > 29 AS INT) + beside // 100 AS tip
    FROM pl JOIN (SELECT *, coalesce(greatest(after, before), 0) AS beside FROM sd) USING (chain)"""
)


@query("graph_tips", sql=_TIPS_SQL)
def graph_tips(spark, d):
    """Chains of best edges, and those with too few reads beside a heavier one."""
    rows = R.written(_classes(spark, d))
    return graph.tips(rows, R.written(overlap.overlaps(rows)))


#: Least overlap, reads of a first node, and reads of any node in the queries on edited tries.
TRIE_LEAST = (48, 3, 2)


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = R.written(_classes(spark, d))
    ends = overlap.overlaps(rows).join(rows.select(F.col("id").alias("right_id"), "seq"), "right_id")
    each = R.written(tries.nodes(ends.select(F.col("left_id").alias("key"), F.expr("substring(seq, ol + 1)").alias("ext"), F.col("ol").alias("overlap"), F.col("copies").alias("n"))))
    pairs = R.written(tries.above(each))
    return rows, pairs, tries.counts(each, pairs, *TRIE_LEAST)


_TRIE_SQL = steps("c ol", """, oh AS MATERIALIZED (SELECT left_id AS key, substr(seq, CAST(ol AS BIGINT) + 1) AS path, CAST(max(ol) AS BIGINT) AS o, CAST(sum(ol.copies) AS BIGINT) AS n FROM ol JOIN c ON c.id = right_id GROUP BY ALL),
    tree AS MATERIALIZED (SELECT a.key, a.path, a.o, a.n, max_by(b.path, length(b.path)) AS up FROM oh a LEFT JOIN oh b ON a.key = b.key AND length(b.path) < length(a.path) AND starts_with(a.path, b.path) GROUP BY ALL),
    nd AS MATERIALIZED (SELECT *, start = 0 AND over < OVERLAP OR start > 0 AND over < OVERLAP AND count(*) OVER (PARTITION BY key, up) > 1 AS short FROM (SELECT *, coalesce(length(up), 0) AS start, o + coalesce(length(up), 0) AS over FROM tree)),
    alive(key, path, up, n) AS (SELECT key, path, up, n FROM nd WHERE up IS NULL AND NOT short UNION ALL SELECT nd.key, nd.path, nd.up, nd.n FROM alive a JOIN nd ON nd.key = a.key AND nd.up = a.path WHERE NOT short),
    way(key, path, here, s) AS (SELECT key, path, path, n FROM alive UNION ALL SELECT w.key, w.path, a.path, w.s + a.n FROM way w JOIN alive a ON a.key = w.key AND a.up = w.here),
    ct AS MATERIALIZED (SELECT nd.*, coalesce(s, 0) AS cnt FROM nd LEFT JOIN (SELECT key, path, max(s) AS s FROM way GROUP BY ALL) USING (key, path)),
    own AS MATERIALIZED (SELECT *, CASE WHEN short THEN 'short' WHEN start = 0 AND cnt < FIRST THEN 'few' WHEN cnt < ANY_ THEN 'rare' WHEN start > 0 AND cnt <= least(4, most // 100 + CAST(most > 9 AS INT)) THEN 'weak' ELSE 'kept' END AS own
        FROM (SELECT *, max(cnt) OVER (PARTITION BY key, up) AS most FROM ct)),
    kept(key, path) AS (SELECT key, path FROM own WHERE up IS NULL AND own = 'kept' UNION ALL SELECT o.key, o.path FROM kept k JOIN own o ON o.key = k.key AND o.up = k.path WHERE own = 'kept'),
    vd AS MATERIALIZED (SELECT own.key, own.path, CAST(start AS BIGINT) AS start, CAST(over AS BIGINT) AS overlap, n, CAST(cnt AS BIGINT) AS count, CASE WHEN up IS NOT NULL AND k.path IS NULL THEN 'below' ELSE own END AS verdict, up FROM own LEFT JOIN kept k ON k.key = own.key AND k.path = own.up)""").replace(
    "WITH ", "WITH RECURSIVE ", 1).replace(") , oh AS", "), oh AS", 1).replace("OVERLAP", str(TRIE_LEAST[0])).replace("FIRST", str(TRIE_LEAST[1])).replace("ANY_", str(TRIE_LEAST[2]))


@query("trie_counts", sql=_TRIE_SQL + " SELECT key, path, start, overlap, n, count, verdict FROM vd")
def trie_counts(spark, d):
    """Overhangs at each read's end, the reads of the heaviest way on from each, and which of them go."""
    return _edited(spark, d)[2]


@query("trie_culled", sql=_TRIE_SQL + """, st AS MATERIALIZED (SELECT *, start = 0 OR count(*) OVER (PARTITION BY key, up) > 1 AS first FROM vd WHERE verdict = 'kept'),
    lay(key, head, path, n) AS (SELECT key, path, path, n FROM st WHERE first UNION ALL SELECT l.key, l.head, st.path, st.n FROM lay l JOIN st ON st.key = l.key AND st.up = l.path WHERE NOT first),
    whole AS (SELECT key, head, max_by(path, length(path)) AS path, count(*) AS n_nodes, CAST(sum(n) AS BIGINT) AS n_reads FROM lay GROUP BY ALL)
    SELECT w.key, w.path, start, substr(w.path, start + 1) AS ext, overlap, n_nodes, n_reads, count, right(c.seq || left(w.path, start), overlap) || substr(w.path, start + 1) AS seq FROM whole w JOIN st ON st.key = w.key AND st.path = w.head JOIN c ON c.id = w.key""")
def trie_culled(spark, d):
    """Stretches that are left of the overhangs at each read's end, with the bases of their first read."""
    rows, pairs, judged = _edited(spark, d)
    return tries.spelled(tries.culled(judged, pairs), rows.select(F.col("id").alias("key"), F.col("seq").alias("base")))
