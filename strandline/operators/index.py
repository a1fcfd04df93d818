"""Suffixes, Burrows-Wheeler transform and rank tables as DataFrames.

Global ranks never meet in one task: suffixes are ranked inside buckets of a common prefix, and a bucket's offset is a
running sum over the bucket counts, of which there are at most 5 ** PREFIX. Suffixes shorter than a prefix are told apart by what
breaks their ties, so that the ends of all reads do not share a bucket. Running sums over blocks have two levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.seq import END
from strandline.operators import seeds
from strandline.operators import transform as packed
from strandline.sources.reads import written

#: Symbols of a bucket's prefix, and ranks between two checkpoints.
PREFIX, STEP = 7, 1024
#: Blocks whose sums run in one task.
SUPER = 65_536
SYMBOLS = (END, "A", "C", "G", "T")


def suffixes(reads: DataFrame) -> DataFrame:
    """read_id, pos, suffix (with the end symbol), sym (the symbol before it, the end symbol for a whole read), order."""
    each = reads.select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq"))).alias("pos"))
    return each.select("read_id", "pos", F.concat(F.expr("substring(seq, pos + 1)"), F.lit(END)).alias("suffix"), F.when(F.col("pos") == 0, F.lit(END)).otherwise(F.expr("substring(seq, pos, 1)")).alias("sym"), F.reverse("seq").alias("order"))


def ranked(rows: DataFrame, key: Column, order: list, name: str = "rk") -> DataFrame:
    """``rows`` with their global rank from 0 by ``key`` (a string) and then ``order``, without a global window."""
    # the end sorts first and ends a key, so a key and what breaks its ties sort as one string
    keyed = rows.withColumn("_bucket", F.rpad(F.substring(F.concat(key, F.col(order[0])), 1, PREFIX), PREFIX, END))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_start"))
    inside = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *order)))
    return inside.join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_start", "_rank")


def bwt(reads: DataFrame) -> DataFrame:
    """rk, read_id, pos, sym of every suffix; equal suffixes by reversed read, then id."""
    return ranked(suffixes(reads), F.col("suffix"), ["order", "read_id"]).select("rk", "read_id", "pos", "sym")


def blocks(transform: DataFrame, step: int = STEP) -> DataFrame:
    """block, symbols: the transform as strings of ``step`` symbols."""
    packed = transform.groupBy(F.expr(f"rk div {step}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("rk", "sym"))).alias("s"))
    return packed.select("block", F.array_join(F.col("s.sym"), "").alias("symbols"))


def symbol_blocks(reads: DataFrame, step: int = STEP) -> DataFrame:
    """block, symbols: what ``blocks`` gives of ``bwt``, from packed suffixes in passes; other letters and very short or long reads take the way through ``bwt``."""
    out = packed.blocks(reads, step)
    return blocks(written(bwt(reads).select("rk", "sym")), step) if out is None else out


def sums_before(rows: DataFrame, block: str, order: list[str], names: list[str]) -> DataFrame:
    """``rows`` with each of ``names`` summed over all rows before; sums run inside ``SUPER`` blocks and over their totals."""
    keyed = rows.withColumn("_super", F.expr(f"{block} div {SUPER}"))
    totals = keyed.groupBy("_super").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    before = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SUPER blocks
    offsets = totals.select("_super", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names])
    inside = Window.partitionBy("_super").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}).join(offsets, "_super")
    return summed.withColumns({n: F.col(n) + F.col(f"_{n}") for n in names}).drop("_super", *[f"_{n}" for n in names])


def checkpoints(transform: DataFrame, step: int = STEP) -> DataFrame:
    """block, occ_end, occ_a, occ_c, occ_g, occ_t: symbols before each block; a running sum over blocks, not suffixes."""
    names = dict(zip(SYMBOLS, ("occ_end", "occ_a", "occ_c", "occ_g", "occ_t")))
    counts = transform.groupBy(F.expr(f"rk div {step}").alias("block")).agg(*[F.count_if(F.col("sym") == s).alias(n) for s, n in names.items()])
    return sums_before(counts, "block", ["block"], list(names.values())).select("block", *names.values())


def block_checkpoints(table: DataFrame) -> DataFrame:
    """``checkpoints`` from blocks of symbols (block, symbols)."""
    names = dict(zip(SYMBOLS, ("occ_end", "occ_a", "occ_c", "occ_g", "occ_t")))
    counts = table.select("block", *[(F.length("symbols") - F.length(F.replace("symbols", F.lit(s), F.lit("")))).cast("long").alias(n) for s, n in names.items()])
    return sums_before(counts, "block", ["block"], list(names.values())).select("block", *names.values())


def block_runs(table: DataFrame, step: int = STEP) -> DataFrame:
    """``runs`` from blocks of symbols (block, symbols). Only a block's first and last run are written; those between are whole."""

    def parts(edges: bool):
        def each(batches):
            for b in batches:
                data, starts, sizes = seeds.ragged(b.column("symbols"))
                held = starts[sizes > 0]
                first = np.zeros(len(data), bool)
                first[1:] = data[1:] != data[:-1]
                first[held] = True
                at = np.flatnonzero(first)
                n = np.diff(at, append=len(data))
                row = np.searchsorted(starts, at, "right") - 1
                begin = np.searchsorted(at, starts[row])
                last = np.searchsorted(at, starts[row] + sizes[row]) - 1
                place = np.arange(len(at))
                kept = ((place == begin) | (place == last)) == edges
                at, n, row, begin, last, place = (x[kept] for x in (at, n, row, begin, last, place))
                block = b.column("block").to_numpy(zero_copy_only=False)[row]
                sym = seeds.column(data[at], np.ones(len(at), np.int64), pa.string())
                out = {"sym": sym, "start_rk": pa.array(block * step + at - starts[row]), "n": pa.array(n)}
                yield pa.RecordBatch.from_pydict(out | ({"block": pa.array(block), "island": pa.array(place - begin + 1), "parts": pa.array(last - begin + 1)} if edges else {}))

        return table.select("block", "symbols").mapInArrow(each, "sym string, start_rk long, n long" + (", block long, island long, parts long" if edges else ""))

    whole = parts(False).select("sym", "start_rk", F.col("n").alias("run_len"))
    return whole.unionByName(_joined_runs(written(parts(True))))


def runs(transform: DataFrame, step: int = STEP) -> DataFrame:
    """sym, start_rk, run_len: maximal runs of a symbol.

    Runs are found inside blocks of ranks and those that meet at a block's edge are joined, so no window spans the table.
    """
    inside = Window.partitionBy("block").orderBy("rk")
    marked = transform.select("rk", "sym", F.expr(f"rk div {step}").alias("block")).withColumn("new", F.coalesce(F.col("sym") != F.lag("sym").over(inside), F.lit(True)).cast("int"))
    part = marked.withColumn("island", F.sum("new").over(inside)).groupBy("block", "island").agg(F.first("sym").alias("sym"), F.min("rk").alias("start_rk"), F.count(F.lit(1)).alias("n"))
    size = F.count(F.lit(1)).over(Window.partitionBy("block"))
    part = written(part.withColumn("parts", size))
    whole = part.filter("island > 1 and island < parts").select("sym", "start_rk", F.col("n").alias("run_len"))
    return whole.unionByName(_joined_runs(part.filter("island = 1 or island = parts")))


def _joined_runs(edge: DataFrame) -> DataFrame:
    """Runs of blocks' first and last parts (block, island, parts, sym, start_rk, n)."""
    # the first part of a block goes on with the last part of the block before; numbers of runs are sums in two levels
    last = edge.filter("island = parts").select((F.col("block") + 1).alias("block"), F.lit(1).cast("long").alias("island"), F.col("sym").alias("_sym"))
    marked = edge.join(last, ["block", "island"], "left").withColumn("own", F.when(F.col("sym") == F.col("_sym"), 0).otherwise(1).cast("long")).drop("_sym")
    joined = sums_before(marked.withColumn("run", F.col("own")), "block", ["start_rk"], ["run"]).withColumn("run", F.col("run") + F.col("own"))
    return joined.groupBy("run").agg(F.first("sym").alias("sym"), F.min("start_rk").alias("start_rk"), F.sum("n").alias("run_len")).drop("run")


def sorted_reads(reads: DataFrame) -> DataFrame:
    """ids_rank, read_id: reads in the order of their whole-read suffixes; reads of one suffix are equal, so ids alone break ties."""
    return ranked(reads.select("read_id", F.concat("seq", F.lit(END)).alias("key"), F.lit("").alias("order")), F.col("key"), ["order", "read_id"], "ids_rank").select("ids_rank", "read_id")


def symbol_totals(reads: DataFrame) -> DataFrame:
    """sym, cnt over the whole transform: every base stands before one suffix, and every read's start before one."""
    each = [F.struct(F.lit(s).alias("sym"), (F.lit(1) if s == END else F.length("seq") - F.length(F.replace("seq", F.lit(s), F.lit("")))).cast("long").alias("n")) for s in SYMBOLS]
    return reads.select(F.explode(F.array(*each)).alias("x")).groupBy("x.sym").agg(F.sum("x.n").alias("cnt"))


def c_array(reads: DataFrame) -> DataFrame:
    """sym, start_rk: where the suffixes that begin with a symbol start."""
    totals = symbol_totals(reads)
    return totals.select("sym", (F.sum("cnt").over(Window.orderBy("sym")) - F.col("cnt")).alias("start_rk"))


#: Longest word whose counts a task holds as an array of 4 ** k numbers.
WORD = 12


def _codes(data: np.ndarray, k: int) -> np.ndarray:
    """The word of ``k`` bases from each place on as a number; those that cross a read's end mean nothing."""
    out = np.zeros(max(0, len(data) - k + 1), np.int32)
    for i in range(k if len(out) else 0):
        out = out << 2 | data[i : i + len(out)]
    return out


def _spelled(codes: np.ndarray, k: int) -> pa.Array:
    letters = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> (2 * np.arange(k)[::-1])) & 3]
    return seeds.column(letters.ravel(), np.full(len(codes), k), pa.string())


def _word_counts(reads: DataFrame, sizes: tuple[int, ...], by_symbol: bool = False) -> DataFrame:
    """k, kmer, sym, cnt, edge: places of each word of each of ``sizes`` (up to ``WORD``), those that end a read, and the symbol before (by_symbol; else null).

    One scan; a task counts in arrays and sends a row for each word that it has met. Reads with other letters are counted word by word.
    """
    kinds = 5 if by_symbol else 1

    def each(batches):
        held = {k: np.zeros((2, 4**k * kinds), np.int64) for k in sizes}
        odd: dict = {}
        for b in seeds.slices(batches, "seq"):
            data, starts, n = seeds.ragged(b.column("seq"))
            code = seeds._CODE[data]
            known = np.ones(len(n), bool)
            if (code > 3).any():
                bad = np.unique(np.searchsorted(starts, np.flatnonzero(code > 3), "right") - 1)
                known[bad] = False
                for x in b.column("seq").take(pa.array(bad)).to_pylist():
                    for k in sizes:
                        for p in range(len(x) - k + 1):
                            at = odd.setdefault((k, x[p : p + k], (x[p - 1] if p else END) if by_symbol else None), [0, 0])
                            at[0] += 1
                            at[1] += p + k == len(x)
            before = np.concatenate([[0], code[:-1] + 1]) if len(code) else code
            for k in sizes:
                own = known & (n >= k)
                if not own.any():
                    continue
                words = _codes(code, k)
                at, last = seeds.places(starts[own], n[own] - k + 1)[1], starts[own] + n[own] - k
                first = starts[own]
                for i, where in enumerate((at, last)):
                    found = words[where].astype(np.int64)
                    if by_symbol:
                        sym = before.copy()
                        sym[first] = 0
                        found = found * kinds + sym[where]
                    held[k][i] += np.bincount(found, minlength=held[k].shape[1])
        names = ["k", "kmer", "sym", "cnt", "edge"]
        for k, counts in held.items():
            at = np.flatnonzero(counts[0])
            sym = pa.array([SYMBOLS[i] for i in at % kinds] if by_symbol else [None] * len(at), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), _spelled(at // kinds, k), sym, pa.array(counts[0][at]), pa.array(counts[1][at])], names)
        if odd:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(*key, *v) for key, v in odd.items()]), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names)

    rows = reads.filter("seq is not null").select("seq").mapInArrow(each, "k int, kmer string, sym string, cnt long, edge long")
    return rows.groupBy("k", "kmer", "sym").agg(F.sum("cnt").alias("cnt"), F.sum("edge").alias("edge"))


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """kmer, cnt, edge: places of each word of k bases, and those that end a read."""
    if k <= WORD:
        return _word_counts(reads, (k,)).select("kmer", "cnt", "edge")
    places = reads.filter(F.length("seq") >= k).select("seq", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("p"))
    return places.select(F.expr(f"substring(seq, p, {k})").alias("kmer"), (F.col("p") == F.length("seq") - k + 1).cast("int").alias("e")).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"), F.sum("e").alias("edge"))


def onward(reads: DataFrame, k: int) -> DataFrame:
    """kmer, cnt, edge, onward, holds: whether a word's places are those that go on by one base and those that end a read."""
    if k < WORD:
        both = written(_word_counts(reads, (k, k + 1)))
        short, long = (both.filter(F.col("k") == n).select("kmer", "cnt", "edge") for n in (k, k + 1))
    else:
        short, long = kmers(reads, k), kmers(reads, k + 1)
    longer = long.groupBy(F.expr(f"left(kmer, {k})").alias("kmer")).agg(F.sum("cnt").alias("onward"))
    each = short.join(longer, "kmer", "left").withColumn("onward", F.coalesce("onward", F.lit(0).cast("long")))
    return each.withColumn("holds", F.expr("cnt = edge + onward"))


def end_offsets(reads: DataFrame) -> DataFrame:
    """tail, cnt, start: reads by their last two bases, and the place of each tail's first read in that order."""
    counts = reads.groupBy(F.right("seq", F.lit(2)).alias("tail")).agg(F.count(F.lit(1)).alias("cnt"))
    # one row for each pair of letters
    return counts.withColumn("start", F.sum("cnt").over(Window.orderBy("tail")) - F.col("cnt"))


def heads(reads: DataFrame, k: int) -> DataFrame:
    """pattern, sym, edge, start: the first ``k`` symbols of every suffix and the symbol before it, without building the suffixes."""
    ended = reads.select(F.concat("seq", F.lit(END)).alias("s"), F.length("seq").alias("n"))
    each = ended.select("s", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("pos"))
    sym = F.when(F.col("pos") == 0, F.lit(END)).otherwise(F.expr("substring(s, pos, 1)"))
    return each.select(F.expr(f"substring(s, pos + 1, {k})").alias("pattern"), sym.alias("sym"), (F.col("pos") + k == F.col("n")).cast("int").alias("edge"), (F.col("pos") == 0).cast("int").alias("start"))


def intervals(reads: DataFrame, k: int) -> DataFrame:
    """pattern, lo, width, n_start: the ranks of suffixes that begin with each word of k bases, and the reads that do.

    The rank of the first is a running sum over words of up to k symbols, shorter ones being those that meet a read's end.
    """
    counts = heads(reads, k).groupBy("pattern").agg(F.count(F.lit(1)).alias("width"), F.sum("start").alias("n_start"))
    placed = counts.withColumn("lo", F.sum("width").over(Window.orderBy("pattern")) - F.col("width"))  # 5 ** k rows at most
    return placed.filter(~F.contains("pattern", F.lit(END))).select("pattern", "lo", "width", "n_start")


def interval_symbols(reads: DataFrame, k: int) -> DataFrame:
    """pattern, sym, n, n_edge: symbols before the places of each word of k bases, and how many of these places end a read."""
    if k <= WORD - 2:  # five numbers a word
        return _word_counts(reads, (k,), by_symbol=True).select(F.col("kmer").alias("pattern"), "sym", F.col("cnt").alias("n"), F.col("edge").alias("n_edge"))
    counts = heads(reads, k).filter(~F.contains("pattern", F.lit(END))).groupBy("pattern", "sym")
    return counts.agg(F.count(F.lit(1)).alias("n"), F.sum("edge").alias("n_edge"))


#: Steps of a backward search between two written tables, ranks of a bucket of the range join, and patterns up to which they are broadcast, not the index shuffled.
WRITE, BUCKET, FEW = 4, 4096, 50_000


def stored(reads: DataFrame, step: int = STEP) -> DataFrame:
    """block, symbols, occ_end, occ_a, occ_c, occ_g, occ_t: the index as a written table, a row for each ``step`` ranks."""
    table = symbol_blocks(reads, step)
    return written(table.join(block_checkpoints(table), "block"))


def _ranks(asked: DataFrame, table: DataFrame, totals: dict[str, int], step: int, few: bool) -> DataFrame:
    """``asked`` (rk, sym and others) with ``occ``: how often ``sym`` stands before rank ``rk``, by a join on its block."""
    total = sum(totals.values())
    inner = asked.filter(f"rk < {total}").withColumn("block", F.expr(f"rk div {step}"))
    held = table.join(F.broadcast(inner), "block") if few else inner.join(table, "block")
    before = F.expr(f"substring(symbols, 1, cast(rk % {step} as int))")
    inside = F.length(before) - F.length(F.replace(before, F.col("sym"), F.lit("")))
    names = dict(zip(SYMBOLS, ("occ_end", "occ_a", "occ_c", "occ_g", "occ_t")))
    occ, most = F.lit(None).cast("long"), F.lit(None).cast("long")
    # all symbols stand before the rank after the last one
    for s, n in names.items():
        occ = F.when(F.col("sym") == s, F.col(n)).otherwise(occ)
        most = F.when(F.col("sym") == s, F.lit(totals[s])).otherwise(most)
    found = held.withColumn("occ", occ + inside).drop("block", "symbols", *names.values())
    return found.unionByName(asked.filter(f"rk >= {total}").withColumn("occ", most))


def search(table: DataFrame, patterns: DataFrame, totals: dict[str, int], step: int = STEP) -> DataFrame:
    """pattern, lo, hi, first, n_start of the distinct ``patterns`` (column pattern, bases and perhaps the end symbol after them) that occur.

    ``lo`` to ``hi`` are the ranks of the suffixes that begin with the pattern; ``first`` and ``n_start`` the places, in read order, of the reads that do.
    ``table`` is ``stored``, ``totals`` the number of each symbol. All patterns are extended together by one symbol before, from their last: the new ends of
    their intervals are ranks of that symbol at the old ones, two rows a pattern joined with the blocks. What is empty goes at once. Patterns of other letters don't occur.
    """
    starts, total = {}, 0
    for s in SYMBOLS:
        starts[s], total = total, total + totals[s]
    base = lambda c: F.expr("case " + " ".join(f"when {c} = '{s}' then {starts[s]}L" for s in SYMBOLS) + " end")
    size = lambda c: F.expr("case " + " ".join(f"when {c} = '{s}' then {totals[s]}L" for s in SYMBOLS) + " end")
    sound = patterns.select("pattern").distinct().filter(F.col("pattern").rlike(r"^[ACGT]+\$?$"))
    rows = written(sound.withColumn("sym", F.right("pattern", F.lit(1))).withColumn("lo", base("sym")).withColumn("hi", base("sym") + size("sym")).filter("lo < hi").select("pattern", "lo", "hi"))
    longest, held = rows.agg(F.max(F.length("pattern")), F.count(F.lit(1))).first()
    few = held <= FEW

    def both(rows: DataFrame, sym) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("rk")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("rk")))).alias("x")
        found = _ranks(rows.select("pattern", "lo", "hi", sym.alias("sym"), ends).select("pattern", "lo", "hi", "sym", "x.end", "x.rk"), table, totals, step, few)
        return found.groupBy("pattern", "lo", "hi", "sym").agg(F.max(F.when(F.col("end") == 0, F.col("occ"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("occ"))).alias("b"))

    for k in range(1, longest or 0):
        going = rows.filter(F.length("pattern") > k)
        ready = rows.filter(F.length("pattern") <= k)
        moved = both(going, F.expr(f"substring(pattern, length(pattern) - {k}, 1)")).select("pattern", (base("sym") + F.col("a")).alias("lo"), (base("sym") + F.col("b")).alias("hi")).filter("lo < hi")
        rows = ready.unionByName(moved)
        if k % WRITE == 0:
            rows = written(rows)
    done = written(rows)
    return both(done, F.lit(END)).select("pattern", "lo", "hi", F.col("a").alias("first"), (F.col("b") - F.col("a")).alias("n_start"))


def counted(reads: DataFrame) -> dict[str, int]:
    """The number of each symbol, on the driver: five rows."""
    return dict.fromkeys(SYMBOLS, 0) | {r["sym"]: r["cnt"] for r in symbol_totals(reads).collect()}


def ids_of(intervals_: DataFrame, order: DataFrame) -> DataFrame:
    """pattern, ids_rank, read_id of intervals (pattern, first, n_start) in read order: a range join by buckets of ranks."""
    spans = intervals_.filter("n_start > 0").select("pattern", "first", "n_start", F.explode(F.expr(f"sequence(first div {BUCKET}, (first + n_start - 1) div {BUCKET})")).alias("bucket"))
    placed = order.withColumn("bucket", F.expr(f"ids_rank div {BUCKET}"))
    return placed.join(spans, "bucket").filter("ids_rank >= first and ids_rank < first + n_start").select("pattern", "ids_rank", "read_id")


def interval_reads(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, ids_rank, read_id: the reads that begin with each of ``patterns``, by the intervals that a backward search gives."""
    found = search(stored(reads), patterns, counted(reads))
    return ids_of(found, sorted_reads(reads))


def lookups(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, width, n_start, n_edge of patterns that occur: their places, the reads that begin and those that end with them."""
    asked = patterns.select("pattern").distinct()
    ends = asked.select(F.concat("pattern", F.lit(END)).alias("pattern"))
    found = written(search(stored(reads), asked.unionByName(ends), counted(reads)))
    edge = found.filter(F.col("pattern").endswith(END)).select(F.expr("left(pattern, length(pattern) - 1)").alias("pattern"), (F.col("hi") - F.col("lo")).alias("n_edge"))
    whole = found.filter(~F.col("pattern").endswith(END)).select("pattern", (F.col("hi") - F.col("lo")).alias("width"), "n_start")
    return whole.join(edge, "pattern", "left").na.fill(0, ["n_edge"])


def rank_before(transform: DataFrame, table: DataFrame, positions: DataFrame, step: int = STEP) -> DataFrame:
    """positions (rk) with the symbols before each: the checkpoint of its block and a running sum inside the block."""
    rows = transform.select("rk", "sym", F.lit(1).alias("held")).unionByName(positions.select("rk", F.lit(None).cast("string").alias("sym"), F.lit(0).alias("held")))
    before = Window.partitionBy("block").orderBy("rk", "held").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("block", F.expr(f"rk div {step}")).withColumns({f"in_{i}": F.coalesce(F.sum((F.col("sym") == s).cast("int")).over(before), F.lit(0)) for i, s in enumerate(SYMBOLS)})
    names = ("occ_end", "occ_a", "occ_c", "occ_g", "occ_t")
    return inside.filter("held = 0").join(table, "block").select("rk", *[(F.col(n) + F.col(f"in_{i}")).alias(n) for i, n in enumerate(names)])


def ranks_of(table: DataFrame, sums: DataFrame, symbol: str, step: int = STEP) -> DataFrame:
    """rk, occ_end, occ_a, occ_c, occ_g, occ_t: the symbols before each rank that holds ``symbol``, from blocks (block, symbols) and their checkpoints."""

    def each(batches):
        for b in batches:
            data, starts, sizes = seeds.ragged(b.column("symbols"))
            at = np.flatnonzero(data == ord(symbol))
            row = np.searchsorted(starts, at, "right") - 1
            block = b.column("block").to_numpy(zero_copy_only=False)[row]
            out = {"block": pa.array(block), "rk": pa.array(block * step + at - starts[row])}
            for i, s in enumerate(SYMBOLS):
                before = np.concatenate([[0], np.cumsum(data == ord(s))])
                out[f"in_{i}"] = pa.array((before[at] - before[starts[row]]).astype(np.int32))
            yield pa.RecordBatch.from_pydict(out)

    places = table.select("block", "symbols").mapInArrow(each, "block long, rk long, " + ", ".join(f"in_{i} int" for i in range(len(SYMBOLS))))
    names = ("occ_end", "occ_a", "occ_c", "occ_g", "occ_t")
    return places.join(sums, "block").select("rk", *[(F.col(n) + F.col(f"in_{i}")).alias(n) for i, n in enumerate(names)])
