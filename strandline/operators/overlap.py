"""Joins of reads with each other: suffix-prefix overlap, containment, divergence.

All share one seed join: the first ``least`` bases of a read against every place of another, by minimizers. Equal reads are one class with
the least of their ids and their number, so copies are never paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import seeds
from strandline.sources.reads import written

#: Least overlap.
LEAST = 45


def classes(reads: DataFrame) -> DataFrame:
    """id, seq, copies of distinct sequences."""
    return reads.groupBy("seq").agg(F.min("read_id").alias("id"), F.count(F.lit(1)).alias("copies"))


def _seeded(rows: DataFrame, least: int, ahead: int = 0) -> DataFrame:
    """Pairs (l, p, r, copies, ln, rn, k, rest) where r's first bases stand at place p of l: both lengths, the bases k on which they agree from there, ``ahead`` bases of r after them.

    A window of ``least`` bases is known by its minimizer, a word at a place of its own, so a read sends some six hashes, not one for each
    window. Those that no other read begins with go; the rest are given their bases, packed, by id, and windows are compared where seeds meet.
    """
    long = written(seeds.packed(rows.filter(F.length("seq") >= least)))
    right = seeds.anchors(long, least, first=True).select(F.col("id").alias("r"), "seed", F.col("at").alias("off"), F.col("seq").alias("rs"), "copies")
    starts = right.groupBy("seed").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    places = seeds.anchors(long, least).select(F.col("id").alias("l"), "seed", "at")
    kept = written(places.join(starts, "seed").filter("low <> l or high <> l").select("l", "seed", "at"))
    based = kept.join(long.select(F.col("id").alias("l"), F.col("seq").alias("ls")), "l")
    pairs = based.join(right, "seed").filter("l <> r and at >= off").withColumn("p", F.col("at") - F.col("off") + 1)
    return seeds.agreeing(pairs, least, ahead)


def overlaps(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """left_id, right_id, ol, copies (of the right read): longest proper overlap of a read's end with another's start."""
    held = _seeded(rows, least).withColumn("ol", F.expr("ln - p + 1")).filter("p > 1 and rn > ol and k = ol")
    return held.groupBy(F.col("l").alias("left_id"), F.col("r").alias("right_id")).agg(F.max("ol").alias("ol"), F.max("copies").alias("copies"))


def overlap_counts(found: DataFrame) -> DataFrame:
    """left_id, n_reads, n_bases: reads that overlap a read's end, and the overlaps' bases."""
    return found.groupBy("left_id").agg(F.sum("copies").alias("n_reads"), F.sum(F.col("ol") * F.col("copies")).alias("n_bases"))


def contained(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """inner_id, outer_id, start: shorter reads inside longer ones."""
    held = _seeded(rows, least).filter("rn < ln and k = rn")
    return held.select(F.col("r").alias("inner_id"), F.col("l").alias("outer_id"), (F.col("p") - 1).alias("start"))


def ends_inside(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """id, target, k: longest end of a read, ``least`` bases or more, that stands anywhere in another read.

    Reversed, ends are beginnings, so the seed join serves here too.
    """
    found = _seeded(rows.withColumn("seq", F.reverse("seq")), least)
    return found.groupBy(F.col("r").alias("id"), F.col("l").alias("target")).agg(F.max("k").alias("k"))


def _diverging(rows: DataFrame, least: int, ahead: int) -> DataFrame:
    """Seeded pairs that part before either read ends, and where in the left one."""
    return _seeded(rows, least, ahead).filter("k < least(ln - p + 1, rn)").withColumn("coord", F.expr("p + k - 1"))


def divergence(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """id, coord, base, cnt: where other reads agree with a read for ``least`` bases or more and then go on with another base."""
    split = _diverging(rows, least, 1)
    return split.groupBy(F.col("l").alias("id"), "coord", F.col("rest").alias("base")).agg(F.sum("copies").alias("cnt"))


def branches_ahead(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """key, ext: for each place (``id:coord``) where other reads part from a read, what they go on with."""
    return _diverging(rows, least, seeds.MOST).select(F.concat_ws(":", "l", "coord").alias("key"), F.col("rest").alias("ext"))


def best_branch(branches: DataFrame) -> DataFrame:
    """id, coord, n_branches, best: branches of a place, and the base of the largest if no other is as large."""
    most = F.max("cnt").over(Window.partitionBy("id", "coord"))
    rows = branches.withColumn("top", F.col("cnt") == most)
    return rows.groupBy("id", "coord").agg(F.count(F.lit(1)).alias("n_branches"), F.when(F.count_if("top") == 1, F.max(F.when(F.col("top"), F.col("base")))).alias("best"))
