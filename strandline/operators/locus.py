"""Loci that grow over their ends by the reads that overlap them, until nothing is added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.reads import written


def ahead(front: DataFrame, reads: DataFrame, longest: int, least: int) -> DataFrame:
    """locus, side, ext, n: what reads that begin inside a locus' end go on with, and how many reads do.

    ``reads`` hold side, seed (hash of their first ``least`` bases), id, rs, copies. Each read counts by its longest overlap. A read that already
    stands whole in the locus does not count, so a tandem repeat ends.
    """
    sizes = F.sequence(F.lit(least), F.least(F.length("seq"), F.lit(longest - 1)))
    ends = front.filter(F.length("seq") >= least).select("locus", "side", F.explode(sizes).alias("ol"), F.expr(f"substring(seq, length(seq) - least(length(seq), {longest}) + 1)").alias("tail"))
    ends = ends.withColumn("seed", F.expr(f"xxhash64(substring(tail, length(tail) - ol + 1, {least}))"))
    held = ends.join(reads, ["side", "seed"]).filter("length(rs) > ol and right(tail, ol) = left(rs, ol)")
    each = held.groupBy("locus", "side", "id").agg(F.max("ol").alias("ol"), F.first("rs").alias("rs"), F.first("copies").alias("copies"))
    new = each.join(front.select("locus", "side", "seq"), ["locus", "side"]).filter(~F.contains("seq", "rs"))
    return new.groupBy("locus", "side", F.expr("substring(rs, ol + 1)").alias("ext")).agg(F.sum("copies").alias("n"))


def agreed(exts: DataFrame, support: int) -> DataFrame:
    """locus, side, path: the bases on which ``support`` reads agree while no other bases have as much support.

    Beginnings of overhangs are counted, never listed: a place is a fork if two of its beginnings are supported, and the path ends before it.
    """
    each = exts.select("locus", "side", "ext", "n", F.explode(F.sequence(F.lit(1), F.length("ext"))).alias("k"))
    held = each.groupBy("locus", "side", "k", F.expr("left(ext, k)").alias("path")).agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
    level = held.groupBy("locus", "side", "k").agg(F.count(F.lit(1)).alias("n_paths"), F.max("path").alias("path"))
    # one row a base of a read at most
    rows = level.groupBy("locus", "side").agg(F.min(F.when(F.col("n_paths") > 1, F.col("k"))).alias("fork"), F.collect_list(F.struct("k", "path")).alias("steps"))
    return rows.select("locus", "side", F.expr("array_max(filter(steps, x -> fork is null or x.k < fork)).path").alias("path")).filter("path is not null")


def extended(loci: DataFrame, rows: DataFrame, least: int = 50, support: int = 2) -> DataFrame:
    """locus, seq, to_left, to_right, rounds: ``loci`` (locus, seq) after extension over both ends to a fixed point.

    ``rows`` are ``overlap.classes``. In a round all ends still open meet the reads that begin in them (``least`` bases or more), and take the bases
    on which ``support`` reads agree; an end without such bases, or at a fork, is closed. The left side is the right one of reversed sequences.
    Each round closes an end or uses up reads, so it stops. State is written between rounds; a round reads the reads' table (written once,
    with hashes of first bases) and shuffles what the open ends ask for. Null or short loci stay as they are; ids of loci are unique.
    """
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.reverse("seq").alias("s")), F.struct(F.lit(1).alias("side"), F.col("seq").alias("s")))).alias("x")
    reads = written(rows.filter(F.length("seq") > least).select("id", "copies", sides).select("x.side", F.xxhash64(F.left("x.s", F.lit(least))).alias("seed"), "id", F.col("x.s").alias("rs"), "copies"))
    longest = reads.agg(F.max(F.length("rs"))).first()[0] or 0
    state = written(loci.select("locus", sides).select("locus", "x.side", F.col("x.s").alias("seq"), F.lit(True).alias("open"), F.lit(0).alias("rounds")))
    while longest and not state.filter("open").isEmpty():
        front = state.filter("open")
        path = agreed(ahead(front, reads, longest, least), support)
        on = front.join(path, ["locus", "side"], "left").select("locus", "side", F.concat("seq", F.coalesce("path", F.lit(""))).alias("seq"), F.col("path").isNotNull().alias("open"), (F.col("rounds") + F.col("path").isNotNull().cast("int")).alias("rounds"))
        state = written(state.filter("not open").unionByName(on))
    left, right = (state.filter(F.col("side") == i).select("locus", F.col("seq").alias(f"s{i}"), F.col("rounds").alias(f"r{i}")) for i in (0, 1))
    out = loci.select("locus", F.length("seq").alias("n")).join(left, "locus").join(right, "locus")
    return out.select("locus", F.concat(F.reverse(F.expr("substring(s0, n + 1)")), "s1").alias("seq"), (F.length("s0") - F.col("n")).alias("to_left"), (F.length("s1") - F.col("n")).alias("to_right"), F.greatest("r0", "r1").alias("rounds"))
