"""Placing reads on query sequences: exact, within a number of mismatches, classified, and competing between queries.

Candidates come from equi-joins on seeds, and are then verified; no pair is formed that does not share a seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.seq import AFTER, BEFORE, common_prefix, hamming, starts_adapter
from strandline.sources.reads import written

#: Bases of an exact seed. Reads are at least 45 long.
SEED = 24


#: Seeds of queries, or pairs, up to which they are counted and then broadcast; of more, reads are shuffled.
FEW = 1_000_000


def sifted(rows: DataFrame, seeds: DataFrame, *key: str) -> DataFrame:
    """``rows`` whose ``key`` may be among ``seeds``, by hashes, before anything of them is shuffled; all of them if seeds are many."""
    h = F.xxhash64(*key).alias("_h")
    held = written(seeds.select(h).distinct())
    return rows.withColumn("_h", h).join(F.broadcast(held), "_h", "left_semi").drop("_h") if held.count() <= FEW else rows


def based(pairs: DataFrame, queries: DataFrame, reads: DataFrame) -> DataFrame:
    """``pairs`` (query, read_id and others) with q and seq; few pairs go to the reads, not the reads to them."""
    held = written(pairs)
    if held.count() > FEW:
        return held.join(queries.select("query", "q"), "query").join(reads.select("read_id", "seq"), "read_id")
    return reads.select("read_id", "seq").join(F.broadcast(held), "read_id").join(queries.select("query", "q"), "query")


def exact(queries: DataFrame, reads: DataFrame) -> DataFrame:
    """query, read_id, q_start, q_end: every place where a whole read stands in a query (columns query, q)."""
    seeds = queries.filter(F.length("q") >= SEED).select("query", "q", F.explode(F.sequence(F.lit(1), F.length("q") - SEED + 1)).alias("p"))
    seeds = seeds.withColumn("seed", F.expr(f"substring(q, p, {SEED})"))
    keyed = reads.select("read_id", "seq", F.substring("seq", 1, SEED).alias("seed"))
    held = seeds.join(keyed, "seed").filter("substring(q, p, length(seq)) = seq")
    return held.select("query", "read_id", (F.col("p") - 1).alias("q_start"), (F.col("p") - 1 + F.length("seq")).alias("q_end"))


def within(queries: DataFrame, reads: DataFrame, mismatches: int = 2) -> DataFrame:
    """query, read_id, q_start, q_end, mismatches of every place where a read differs from a query in few bases.

    A read is cut into one block more than mismatches are allowed; one of the blocks must stand unchanged (pigeonhole).
    """
    blocks = mismatches + 1
    size = F.floor(F.length("seq") / blocks).cast("int")
    cut = reads.select("read_id", "seq", size.alias("size"), F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("i"))
    cut = cut.withColumn("off", F.col("i") * F.col("size")).withColumn("seed", F.expr("substring(seq, off + 1, size)"))
    sizes = reads.select(size.alias("size")).distinct().filter("size > 0").agg(F.collect_set("size").alias("sizes"))  # at most 255 / blocks
    each = queries.join(F.broadcast(sizes)).select("query", "q", F.explode("sizes").alias("size")).filter("length(q) >= size")
    seeds = each.select("query", "q", "size", F.explode(F.sequence(F.lit(1), F.length("q") - F.col("size") + 1)).alias("p")).withColumn("seed", F.expr("substring(q, p, size)"))
    held = seeds.join(sifted(cut, seeds, "size", "seed"), ["size", "seed"]).withColumn("at", F.col("p") - F.col("off"))
    fits = held.filter("at >= 1 and at - 1 + length(seq) <= length(q)").select("query", "q", "read_id", "seq", "at").distinct()
    scored = fits.withColumn("mismatches", hamming(F.expr("substring(q, at, length(seq))"), F.col("seq"))).filter(F.col("mismatches") <= mismatches)
    return scored.select("query", "read_id", (F.col("at") - 1).alias("q_start"), (F.col("at") - 1 + F.length("seq")).alias("q_end"), "mismatches")



def within_rate(queries: DataFrame, reads: DataFrame, per: int) -> DataFrame:
    """query, read_id, q_start, q_end, mismatches of every place where a read differs from a query in one base of each ``per`` at most.

    The number of blocks grows with the read: length / per mismatches are allowed and one block more is cut. Hashed seeds, ids and places are shuffled;
    bases are fetched by id for distinct candidates only.
    """
    size = F.expr(f"int(length(seq) div (length(seq) div {per} + 1))")
    cut = reads.select("read_id", size.alias("size"), "seq", F.explode(F.sequence(F.lit(0), F.expr(f"int(length(seq) div {per})"))).alias("i")).filter("size > 0")
    cut = cut.select("read_id", (F.col("i") * F.col("size")).alias("off"), F.length("seq").alias("n"), F.xxhash64("size", F.expr("substring(seq, i * size + 1, size)")).alias("h"))
    sizes = reads.select(size.alias("size")).distinct().filter("size > 0").agg(F.collect_set("size").alias("sizes"))  # at most ``per`` + 1
    each = queries.join(F.broadcast(sizes)).select("query", "q", F.explode("sizes").alias("size")).filter("length(q) >= size")
    seeds = each.select("query", F.length("q").alias("m"), "q", "size", F.explode(F.sequence(F.lit(1), F.length("q") - F.col("size") + 1)).alias("p")).select("query", "m", "p", F.xxhash64("size", F.expr("substring(q, p, size)")).alias("h"))
    held = seeds.join(sifted(cut, seeds, "h"), "h").withColumn("at", F.col("p") - F.col("off")).filter("at >= 1 and at - 1 + n <= m").select("query", "read_id", "at").distinct()
    scored = based(held, queries, reads).withColumn("mismatches", hamming(F.expr("substring(q, at, length(seq))"), F.col("seq"))).filter(F.col("mismatches") <= F.expr(f"length(seq) div {per}"))
    return scored.select("query", "read_id", (F.col("at") - 1).alias("q_start"), (F.col("at") - 1 + F.length("seq")).alias("q_end"), "mismatches")


def union_of_intervals(hits: DataFrame) -> DataFrame:
    """query, s, e: places of a query merged where they touch or overlap."""
    order = Window.partitionBy("query").orderBy("q_start", "q_end")
    before = F.max("q_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.select("query", "q_start", "q_end").distinct().withColumn("new", F.when(before >= F.col("q_start"), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(order))
    return islands.groupBy("query", "island").agg(F.min("q_start").alias("s"), F.max("q_end").alias("e")).drop("island")


#: Fixed value: bases of the shortest exact stretch that counts as aligned.
ALIGNED = 10


def seeded(queries: DataFrame, reads: DataFrame, mismatches: int = 2) -> DataFrame:
    """query, read_id of the pairs to classify; only ids and seeds are shuffled.

    A read's first or last ``SEED`` bases stand in the query (reads inside it or over one of its ends), or it is placed with few
    mismatches, or the beginning of a query no longer than the longest read stands in the read (reads around the query).
    """
    places = queries.filter(F.length("q") >= SEED).select("query", "q", F.explode(F.sequence(F.lit(1), F.length("q") - SEED + 1)).alias("p"))
    seeds = places.select("query", F.expr(f"substring(q, p, {SEED})").alias("seed")).distinct()
    ends = reads.select("read_id", F.explode(F.array_distinct(F.array(F.left("seq", F.lit(SEED)), F.right("seq", F.lit(SEED))))).alias("seed"))
    found = seeds.join(sifted(ends, seeds, "seed"), "seed").select("query", "read_id").unionByName(within(queries, reads, mismatches).select("query", "read_id"))
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    short = queries.filter(F.length("q").between(1, longest)).select("query", F.left("q", F.lit(SEED)).alias("seed"), F.least(F.length("q"), F.lit(SEED)).alias("size"))
    sizes = [r[0] for r in short.select("size").distinct().collect()]  # at most SEED
    if sizes:
        each = reads.select("read_id", "seq", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")).filter("length(seq) >= size")
        words = each.select("read_id", "seq", "size", F.explode(F.expr("sequence(1, length(seq) - size + 1)")).alias("p")).select("read_id", F.expr("substring(seq, p, size)").alias("seed"))
        found = found.unionByName(sifted(words, short, "seed").join(short, "seed").select("query", "read_id"))
    return found.distinct()


def longest_matches(pairs: DataFrame, least: int = ALIGNED) -> DataFrame:
    """query, read_id, q, seq, qs, qe, rs, re of pairs (query, q, read_id, seq): their longest exact stretch of ``least`` bases or more.

    Of several the first in the query, then in the read; null where there is none. Words of ``least`` bases are numbers, equal ones are found by search in
    the query's sorted words, and neighbours on a diagonal are one stretch: numpy over a pair's places.
    """

    def words(seq: str) -> np.ndarray:
        codes = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8).astype(np.int64)
        if len(codes) < least:
            return np.zeros(0, np.int64)
        known = np.full(256, 4)
        known[np.frombuffer(b"ACGT", np.uint8)] = range(4)
        return np.lib.stride_tricks.sliding_window_view(known[codes], least) @ (5 ** np.arange(least))

    def best(q: np.ndarray, order: np.ndarray, r: np.ndarray) -> tuple | None:
        low, high = np.searchsorted(q, r, "left", order), np.searchsorted(q, r, "right", order)
        n = high - low
        if not n.sum():
            return None
        j = np.repeat(np.arange(len(r)), n)
        i = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        by = np.lexsort((i, i - j))
        i, j = i[by], j[by]
        first = np.flatnonzero(np.r_[True, (np.diff(i - j) != 0) | (np.diff(i) != 1)])
        size = np.diff(np.r_[first, len(i)])
        at = min(range(len(first)), key=lambda k: (-size[k], i[first[k]], j[first[k]]))
        qs, rs, length = int(i[first[at]]), int(j[first[at]]), int(size[at]) + least - 1
        return qs, qs + length, rs, rs + length

    def each(batches):
        for batch in batches:
            held: dict = {}
            rows = []
            for query, q, seq in zip(batch["query"], batch["q"], batch["seq"]):
                if query not in held:
                    held = {query: (w := words(q), np.argsort(w, kind="stable"))}  # pairs of a query mostly follow each other
                rows.append(best(*held[query], words(seq)) or (None,) * 4)
            found = pd.DataFrame(rows, columns=["qs", "qe", "rs", "re"], index=batch.index).astype("Int32")
            yield pd.concat([batch, found], axis=1)

    return pairs.select("query", "q", "read_id", "seq").mapInPandas(each, "query long, q string, read_id long, seq string, qs int, qe int, rs int, re int")


def classified(queries: DataFrame, reads: DataFrame, mismatches: int = 2) -> DataFrame:
    """query, read_id, class, how, q_start, q_end, r_start, r_end, len of all candidate pairs: how each read lies on a query.

    ``exact`` is a read inside the query or around it, or one whose longest exact stretch begins with the read or the query and goes on
    with the adapter (``after``; ``left`` if the read ends there), or ends with one of them after the adapter (``before``; ``right`` if the read begins
    there). q_start and q_end are the stretch of the query, r_start and r_end what is left of the read. Other pairs with a stretch of ``ALIGNED`` bases are
    ``inexact``, the rest is ``unmatched``. ``len`` is the aligned length (0: none). A read around a query starts before it, below zero.
    """
    rows = longest_matches(based(seeded(queries, reads, mismatches), queries, reads))
    q, r = F.length("q"), F.length("seq")
    at, around = F.instr("q", F.col("seq")) - 1, F.instr("seq", F.col("q")) - 1
    gone = F.col("qs").isNull()
    tail, head = F.expr("substring(seq, re + 1, 3)"), F.reverse(F.expr("left(seq, rs)"))
    cut_after = ((F.col("rs") == 0) | (F.col("qs") == 0)) & (F.col("qe") < q) & F.startswith(F.lit(AFTER), tail)
    cut_before = ((F.col("re") == r) | (F.col("qe") == q)) & (F.col("qs") > 0) & F.startswith(F.lit(BEFORE), F.left(head, F.lit(len(BEFORE))))

    def row(kind: str, how, q_start, q_end, r_start, r_end, size):
        values = {"class": F.lit(kind), "how": how if isinstance(how, Column) else F.lit(how), "q_start": q_start, "q_end": q_end, "r_start": r_start, "r_end": r_end, "len": size}
        return F.struct(*[(v if k in ("class", "how") else v.cast("int")).alias(k) for k, v in values.items()])

    none, zero, aligned = F.lit(None), F.lit(0), F.col("qe") - F.col("qs")
    place = [F.col(c) for c in ("qs", "qe", "rs", "re")]
    kind = (
        F.when(at >= 0, row("exact", "inside", at, at + r, zero, r, r))
        .when(around >= 0, row("exact", "around", -around, r - around, zero, r, q))
        .when(gone, row("unmatched", "", none, none, none, none, zero))
        .when(cut_after, row("exact", F.when(F.col("re") == r, "left").otherwise("after"), F.col("qs"), F.col("qe"), zero, F.col("re"), aligned))
        .when(cut_before, row("exact", F.when(F.col("rs") == 0, "right").otherwise("before"), F.col("qs"), F.col("qe"), F.col("rs"), r, aligned))
        .otherwise(row("inexact", "", *place, aligned))
    )
    return rows.select("query", "read_id", kind.alias("x")).select("query", "read_id", "x.*")


def without_adapters(queries: DataFrame, reads: DataFrame) -> DataFrame:
    """query, read_id, side, q_start, q_end: reads that leave a query in its midst with an adapter; the stretch before is exact.

    Side 1 is a read whose beginning stands in the query and whose rest begins like the adapter, side 0 its mirror image: an
    end that stands in the query with the adapter before it. Of several places of a read the longest counts, the first of those.
    """

    def placed(side: int, q: Column, seq: Column, adapter: str) -> DataFrame:
        turned = queries.select("query", q.alias("q")).filter(F.length("q") >= SEED)
        seeds = turned.select("query", "q", F.explode(F.sequence(F.lit(1), F.length("q") - SEED + 1)).alias("p")).withColumn("seed", F.expr(f"substring(q, p, {SEED})"))
        keyed = reads.select("read_id", seq.alias("seq")).withColumn("seed", F.substring("seq", 1, SEED))
        found = seeds.join(keyed, "seed").withColumn("k", common_prefix(F.expr("substring(q, p)"), F.col("seq")))
        cut = found.filter("p - 1 + k < length(q)").filter(starts_adapter(F.expr("substring(seq, k + 1)"), adapter))
        start = F.col("p") - 1 if side else F.length("q") - F.col("p") + 1 - F.col("k")
        return cut.select("query", "read_id", F.lit(side).alias("side"), start.alias("q_start"), (start + F.col("k")).alias("q_end"))

    both = placed(1, F.col("q"), F.col("seq"), AFTER).unionByName(placed(0, F.reverse("q"), F.reverse("seq"), BEFORE))
    best = F.max_by(F.struct("q_start", "q_end"), F.struct(F.col("q_end") - F.col("q_start"), -F.col("q_start")))
    return both.groupBy("query", "read_id", "side").agg(best.alias("x")).select("query", "read_id", "side", "x.q_start", "x.q_end")


def compete(classes: DataFrame) -> DataFrame:
    """Classified pairs, without those of reads that are exact elsewhere, or unmatched here and inexact elsewhere; of a read's inexact ones those of the longest aligned stretch."""
    elsewhere = classes.filter("class = 'exact'").select("read_id").distinct()
    rest = classes.filter("class <> 'exact'").join(elsewhere, "read_id", "left_anti")
    # sums by read rather than windows, so that a read on many queries is never gathered
    best = rest.filter("class = 'inexact'").groupBy("read_id").agg(F.max("len").alias("best"))
    kept = rest.join(best, "read_id", "left").filter("class = 'unmatched' and best is null or class = 'inexact' and len = best").drop("best")
    return classes.filter("class = 'exact'").unionByName(kept)


def rendered(queries: DataFrame, reads: DataFrame, hits: DataFrame) -> DataFrame:
    """query, line_no, line: the query and its placed reads as lines padded with '-', by start and then id."""
    placed = hits.join(reads.select("read_id", "seq"), "read_id").join(queries, "query")
    line = F.concat(F.expr("repeat('-', q_start)"), F.col("seq"), F.expr("repeat('-', length(q) - q_end)"))
    number = F.row_number().over(Window.partitionBy("query").orderBy("q_start", "read_id"))
    rows = placed.select("query", number.alias("line_no"), line.alias("line"))
    return queries.select("query", F.lit(0).alias("line_no"), F.col("q").alias("line")).unionByName(rows)


def ids_beyond(hits: DataFrame, coord: int, end: bool = False, after: bool = True) -> DataFrame:
    """query, read_id of reads whose start (``end``: end) lies after (else before) a place of the query."""
    at = F.col("q_end" if end else "q_start")
    return hits.filter(at > coord if after else at < coord).select("query", "read_id").distinct()


def astray(queries: DataFrame, reads: DataFrame, hits: DataFrame) -> DataFrame:
    """query, n, n_outside: placed reads, and those that do not stand in the query base by base."""
    placed = hits.select("query", "read_id").distinct().join(reads.select("read_id", "seq"), "read_id").join(queries, "query")
    return placed.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.contains("q", "seq")).alias("n_outside"))
