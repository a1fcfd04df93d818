"""Libraries of reads: mates by id, membership by range of ids, and derived distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.seq import mate_id

#: Fixed value: most libraries; their table is small by that bound and may be sent to every task.
MOST = 255


def mates(reads: DataFrame, forward: bool = False) -> DataFrame:
    """read_id, mate: pairs of oriented reads that are both there."""
    asked = reads.select("read_id", mate_id(F.col("read_id"), F.lit(forward)).alias("mate"))
    return asked.join(reads.select(F.col("read_id").alias("mate")), "mate", "left_semi").select("read_id", "mate")


def libraries(sizes: DataFrame) -> DataFrame:
    """lib_id, size, end_count, min_dist, max_dist from (lib_id, size, n): ids below end_count belong to the first such library."""
    ends = F.sum("n").over(Window.orderBy("lib_id"))
    near = F.greatest(F.floor(F.col("size") / 5) - 100, F.lit(1)).cast("long")
    return sizes.select("lib_id", "size", ends.alias("end_count"), near.alias("min_dist"), F.floor(F.col("size") * 1.2 + 200).cast("long").alias("max_dist"))


def library_of(ids: DataFrame, libs: DataFrame) -> DataFrame:
    """id, lib_id by range join; ids beyond the last library have none. More than ``MOST`` libraries are an error."""
    if libs.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} libraries")
    ranges = libs.select("lib_id", "end_count", F.lag("end_count", 1, 0).over(Window.orderBy("lib_id")).alias("begin"))
    return ids.join(F.broadcast(ranges), (F.col("id") >= F.col("begin")) & (F.col("id") < F.col("end_count")), "left").select("id", "lib_id")


#: How the mates of a library face.
UNKNOWN, SAME, FACING, APART = range(4)


def direction(read_id: Column, orientation: Column) -> Column:
    """Side on which a read's mate lies: 0 or 1 by strand, turned round for mates that face apart; 2 if unknown."""
    strand = read_id.bitwiseAND(F.lit(1).cast("long"))
    return F.when(orientation == UNKNOWN, 2).when(orientation == APART, 1 - strand).otherwise(strand)


def marks_mate(reverse: Column, side: Column, orientation: Column) -> Column:
    """Whether a read (its strand) gives a mark for its mate on a side: always if unknown, never for mates of one direction."""
    return F.when(orientation == UNKNOWN, True).when(orientation == FACING, reverse == side).when(orientation == APART, reverse != side).otherwise(False)
