"""Scalar functions on sequences as Spark columns; all stay inside generated code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of symbols: the end of a read sorts before all bases.
END = "$"


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than the bases become N, case is kept."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def symbol_code(base: Column) -> Column:
    """A, C, G, T as 0 to 3 in either case, N as 5, all else 6."""
    return F.coalesce(F.nullif(F.instr(F.lit("ACGT"), F.upper(base)), F.lit(0)) - 1, F.when(F.upper(base) == "N", 5).otherwise(6)).cast("int")


def is_sequence(seq: Column) -> Column:
    """Holds upper-case bases and N only."""
    return seq.rlike("^[ACGTN]*$")


def mask_low_quality(seq: Column, quality: Column, least: int) -> Column:
    """Bases whose quality character is below ``least`` (as a code point) become N."""
    pairs = F.zip_with(F.split(seq, ""), F.split(quality, ""), lambda s, q: F.when(F.ascii(q) < least, F.lit("N")).otherwise(s))
    return F.when(seq == "", seq).otherwise(F.array_join(pairs, ""))


def longest_known(seq: Column) -> Column:
    """Longest stretch without N; the first of several."""
    parts = F.split(seq, "[Nn]")
    return F.aggregate(parts, F.lit(""), lambda best, part: F.when(F.length(part) > F.length(best), part).otherwise(best))


def end_run(seq: Column) -> Column:
    """Length of the run of one base at the end."""
    return (F.length(seq) - F.length(F.rtrim(seq, F.right(seq, F.lit(1))))).cast("int")


def run_score(seq: Column) -> Column:
    """Sum of (run - 2) over runs of one base longer than 2."""
    runs = F.regexp_extract_all(seq, F.lit("(.)\\1{2,}"), F.lit(0))
    return F.aggregate(runs, F.lit(0), lambda total, run: total + F.length(run) - 2).cast("int")


def overlap_length(left: Column, right: Column, least: int) -> Column:
    """Largest k >= ``least`` for which the last k of ``left`` are the first k of ``right``; 0 if there is none."""
    most = F.least(F.length(left), F.length(right))
    sizes = F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(sizes, lambda k: F.right(left, k) == F.left(right, k))), F.lit(0))


def hamming(left: Column, right: Column) -> Column:
    """Places in which two sequences of one length differ."""
    places = F.sequence(F.lit(1), F.greatest(F.length(left), F.lit(1)))
    return F.size(F.filter(places, lambda i: F.substring(left, i, F.lit(1)) != F.substring(right, i, F.lit(1))))


def branch_cull(count: Column, largest: Column) -> Column:
    """A branch's count, or 0 if it is too low beside the largest: below 1, 2 from 20 on, and one more per 40, 20 at most."""
    floor = F.least(F.lit(20), 1 + (largest > 19).cast("int") + F.floor(largest / 40))
    return F.when(count < floor, F.lit(0)).otherwise(count)


def mate_id(read_id: Column, forward: Column) -> Column:
    """The mate's oriented id: 0-3 and 1-2 in a group of four for facing mates, 0-2 and 1-3 for mates of one direction."""
    return read_id.bitwiseXOR(F.when(forward, F.lit(2)).otherwise(F.lit(3)).cast("long"))


def common_prefix(left: Column, right: Column) -> Column:
    """Bases that two sequences share from their start."""
    most = F.least(F.length(left), F.length(right))
    places = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    first = F.array_min(F.filter(places, lambda i: F.substring(left, i, F.lit(1)) != F.substring(right, i, F.lit(1))))
    return F.coalesce(first - 1, most)


def congruent(left: Column, right: Column, offset: int) -> Column:
    """Whether ``right``, laid ``offset`` bases along ``left``, agrees with it in all places of both; without such places it does not."""
    size = F.least(F.length(left) - offset, F.length(right))
    return (size > 0) & (F.substring(left, F.lit(offset + 1), size) == F.left(right, size))


def congruence(left: Column, right: Column, least: int) -> Column:
    """Bases over which the end of ``left`` and the start of ``right`` agree, 0 if they do not.

    The shorter read's ``least`` outer bases are sought in the other, at their first place only; from there both must agree as far as
    both go.
    """
    at = F.instr(left, F.left(right, F.lit(least)))
    size = F.least(F.length(left) - at + 1, F.length(right))
    on = F.when((at > 0) & (F.substring(left, at, size) == F.left(right, size)), size)
    back = F.instr(right, F.right(left, F.lit(least)))
    more = F.least(F.length(left) - least, back - 1)
    off = F.when((back > 0) & (F.substring(right, back - more, more + least) == F.right(left, more + least)), more + least)
    held = F.when(F.length(left) < F.length(right), off).otherwise(on)
    return F.when(F.least(F.length(left), F.length(right)) >= least, F.coalesce(held, F.lit(0))).otherwise(0)


#: The first bases of an adapter after a read's insert, and what stands before the insert, read backwards.
AFTER, BEFORE = "CTG", "GAC"


def starts_adapter(rest: Column, adapter: str = AFTER) -> Column:
    """Whether what is left of a read begins like the adapter, as far as either goes; nothing left is no adapter."""
    size = F.least(F.length(rest), F.lit(len(adapter)))
    return (size > 0) & (F.left(rest, size) == F.left(F.lit(adapter), size))
