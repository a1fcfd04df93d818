"""The transform as a table of blocks of symbols, sorted from packed reads in few passes.

Equal suffixes are ordered by what stands before them, read backwards, and then by id; so the symbols before equal suffixes are in order themselves, and
neither whole reads nor ids have to travel. Suffixes of ``SHORT`` bases or fewer are only counted. A first scan counts the others by their first ``HEAD``
bases, whose numbers (4 ** HEAD, on the driver) are cut into buckets of suffixes that follow each other. Each pass sends the suffixes of some buckets, packed, sorts
each bucket and writes its symbols at their ranks, so what is shuffled at once is a share of all suffixes. Padding is A; of equal padded suffixes the shorter comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import seeds
from strandline.sources.reads import written

#: Bases of a suffix that is only counted, and of a bucket's prefix.
SHORT, HEAD = 8, 10
#: Suffixes of a bucket and of a pass, the most passes, and reads that are taken together.
BUCKET, PASS, MOST_PASSES, TOGETHER = 1_500_000, 24_000_000, 32, 50_000
#: Suffixes that a task sends at once.
SENT = 300_000
#: Numbers of a piece of the counts.
PIECE = 1 << 16
SYMBOLS = np.frombuffer(b"$ACGT", np.uint8)
#: Where the counts of short suffixes of each length begin: length, bases, symbol before.
_SHORT_AT = np.cumsum([0] + [5 * 4**m for m in range(SHORT + 1)])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed bases as rows of 64-bit words (one row a word, zeros behind) and sizes, ``TOGETHER`` reads at once."""
    held: list = []

    def joined():
        data, starts, sizes = seeds.ragged(pa.chunked_array(held).combine_chunks())
        width = -(-int(sizes.max() - 1) // 8) * 8 + 8
        rows = seeds.matrix(data, starts + 1, sizes - 1, width)
        held.clear()
        return np.ascontiguousarray(rows.view(">u8").astype(np.uint64).T), 4 * (sizes - 1) - data[starts]

    for b in batches:
        for part in seeds.slices([b], "seq", 4):
            held.append(part.column("seq"))
            if sum(map(len, held)) >= TOGETHER:
                yield joined()
    if held:
        yield joined()


def _from(words: np.ndarray, j: int, p: int) -> np.ndarray:
    """The 32 bases from place ``p`` + 32 * ``j`` on of each read."""
    q, s = divmod(p, 32)
    q += j
    if q >= len(words):
        return np.zeros(words.shape[1], np.uint64)
    if not s:
        return words[q]
    out = words[q] << np.uint64(2 * s)
    return out | words[q + 1] >> np.uint64(64 - 2 * s) if q + 1 < len(words) else out


def _before(words: np.ndarray, p: int) -> np.ndarray:
    """Number of the symbol before place ``p``."""
    if not p:
        return np.zeros(words.shape[1], np.uint8)
    q, s = divmod(p - 1, 32)
    return ((words[q] >> np.uint64(62 - 2 * s)) & np.uint64(3)).astype(np.uint8) + np.uint8(1)


def _counts(packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes longer than ``SHORT`` by their first bases, and shorter ones by length, bases and symbol before."""

    def each(batches):
        longer, short = np.zeros(4**HEAD, np.int64), np.zeros(_SHORT_AT[-1], np.int64)
        for words, sizes in _words(batches):
            held, most = [], int(sizes.max())
            for p in range(most + 1):
                left, code = sizes - p, _from(words, 0, p)
                held.append((code[left > SHORT] >> np.uint64(64 - 2 * HEAD)).astype(np.int32))
                if p == most or sum(map(len, held)) > 2_000_000:
                    longer += np.bincount(np.concatenate(held), minlength=len(longer))
                    held.clear()
                at = np.flatnonzero((left >= 0) & (left <= SHORT))
                if len(at):
                    m = left[at]
                    head = (code[at] >> np.uint64(64 - 2 * SHORT)).astype(np.int64) >> 2 * (SHORT - m)
                    short += np.bincount(_SHORT_AT[m] + head * 5 + _before(words, p)[at], minlength=len(short))
        every = np.concatenate([longer, short])
        pieces = [(i, every[i : i + PIECE]) for i in range(0, len(every), PIECE)]
        rows = [(i, zlib.compress(x.tobytes(), 1)) for i, x in pieces if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["at", "counts"])

    def add(table):
        sums = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist())
        return pa.table([pa.array([table.column("at")[0].as_py()], pa.int32()), pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], ["at", "counts"])

    out = np.zeros(4**HEAD + _SHORT_AT[-1], np.int64)
    for r in packed.mapInArrow(each, "at int, counts binary").groupBy("at").applyInArrow(add, "at int, counts binary").collect():
        x = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["at"] : r["at"] + len(x)] = x
    return out[: 4**HEAD], out[4**HEAD :]


def order_of(words: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """The order of rows by ``words``, then by ``last`` (16 bits): the first word is sorted, then what is tied by as many more bits as its group's number leaves."""
    order = np.argsort(words[0])
    first = words[0][order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    place, at, end = np.arange(len(order)), 64, 64 * len(words)
    while True:
        # of the places in question those that share their group
        single = new & np.concatenate([new[1:], [True]])
        place, new = place[~single], new[~single]
        if not len(place):
            return order
        group = (np.cumsum(new) - 1).astype(np.uint64)
        bits = max(1, int(group[-1]).bit_length())
        rows = order[place]
        if at >= end:
            order[place] = rows[np.argsort(group << np.uint64(16) | last[rows].astype(np.uint64))]
            return order
        q, s = divmod(at, 64)
        more = words[q][rows] << np.uint64(s)
        if s and q + 1 < len(words):
            more |= words[q + 1][rows] >> np.uint64(64 - s)
        key = group << np.uint64(64 - bits) | more >> np.uint64(bits)
        by = np.argsort(key)
        order[place], key = rows[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at += 64 - bits


def _pass(packed: DataFrame, bounds: np.ndarray, starts: np.ndarray, short: tuple[np.ndarray, ...], step: int) -> DataFrame:
    """block, at, symbols, edge of the buckets between ``bounds``, which begin at the ranks ``starts``; short: first bases, symbol and number of short suffixes in order."""
    low, high = int(bounds[0]), int(bounds[-1])
    bucket = (np.searchsorted(bounds, np.arange(low, high), "right") - 1).astype(np.int32)
    own = slice(*np.searchsorted(short[0], [low, high]))
    heads, syms, weights = (x[own] for x in short)

    def sent(found):
        place, size, sym, keys = (np.concatenate(x, axis=-1) for x in zip(*found))
        units = (size.astype(np.int64) + 15) // 16
        kind = place * 32 + units
        by = np.argsort(kind.astype(np.uint16) if kind.max() < 1 << 16 else kind, kind="stable")
        ends = np.flatnonzero(np.diff(kind[by], append=-1)) + 1
        halves = np.ascontiguousarray(keys.T[by]).astype(">u8").view(">u4")
        rest = np.stack([size[by], sym[by]], axis=1)
        rows = []
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
            n = int(units[by[a]])
            rows.append((int(place[by[a]]), n, np.ascontiguousarray(halves[a:b, :n]).tobytes(), rest[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "units", "keys", "rest"])

    def each(batches):
        for words, sizes in _words(batches):
            found, n = [], 0
            for p in range(int(sizes.max()) + 1):
                head = (_from(words, 0, p) >> np.uint64(64 - 2 * HEAD)).astype(np.int32)
                at = np.flatnonzero((head >= low) & (head < high) & (sizes - p > SHORT))
                if len(at):
                    cut = words[p // 32 :, at]
                    found.append((bucket[head[at] - low], (sizes[at] - p).astype(np.uint8), _before(words, p)[at], np.vstack([_from(cut, j, p % 32) for j in range(len(words))])))
                    n += len(at)
                if n > SENT:
                    yield sent(found)
                    found, n = [], 0
            if found:
                yield sent(found)

    def sort(table):
        at = table.column("bucket")[0].as_py()
        units, keys, rest = (table.column(c).to_pylist() for c in ("units", "keys", "rest"))
        last = np.frombuffer(b"".join(rest), np.uint8).reshape(-1, 2)
        full = np.zeros((len(last), -(-max(units) // 2) * 2), ">u4")
        begin = 0
        for n, x in zip(units, keys):
            part = np.frombuffer(x, ">u4").reshape(-1, n)
            full[begin : begin + len(part), :n] = part
            begin += len(part)
        words = list(np.ascontiguousarray(full.view(">u8").astype(np.uint64).T))
        order = order_of(words, last[:, 0].astype(np.uint16) << 8 | last[:, 1])
        return laid(at, last[order, 1], words[0][order])

    def laid(at, symbols, first):
        own = slice(*np.searchsorted(heads, bounds[at : at + 2]))
        before = np.searchsorted(first, heads[own].astype(np.uint64) << np.uint64(64 - 2 * HEAD))
        data = SYMBOLS[np.repeat(np.insert(symbols, before, syms[own]), np.insert(np.ones(len(symbols), np.int64), before, weights[own]))]
        block, off = divmod(int(starts[at]), step)
        edges = np.unique(np.concatenate([[0], np.arange(step - off, len(data), step), [len(data)]]))
        sizes = np.diff(edges)
        places = np.concatenate([[off], np.zeros(max(0, len(sizes) - 1), np.int64)])[: len(sizes)]
        return pa.table([pa.array(block + np.arange(len(sizes))), pa.array(places.astype(np.int32)), seeds.column(data, sizes, pa.string()), pa.array(sizes != step)], ["block", "at", "symbols", "edge"])

    out = packed.mapInArrow(each, "bucket int, units int, keys binary, rest binary").groupBy("bucket")
    return out.applyInArrow(sort, "block long, at int, symbols string, edge boolean")


def blocks(reads: DataFrame, step: int) -> DataFrame | None:
    """block, symbols of the transform of ``reads``, ``step`` symbols a block, as written tables; None if a read holds other letters than bases or has more than
    255 of them, or none has more than ``SHORT``."""

    def each(batches):
        for b in seeds.slices(batches, "seq"):
            yield pa.RecordBatch.from_arrays([seeds.pack(b.column("seq"))], ["seq"])

    packed = written(reads.filter("seq is not null").select("seq").mapInArrow(each, "seq binary"))
    if not packed.filter("substring(seq, 1, 1) = x'ff' or length(seq) > 65 or length(seq) = 65 and substring(seq, 1, 1) = x'00'").isEmpty():
        return None
    longer, short = _counts(packed)
    total = int(longer.sum())
    if not total:
        return None
    held = np.flatnonzero(short)
    size = np.searchsorted(_SHORT_AT, held, "right") - 1
    head, sym = np.divmod(held - _SHORT_AT[size], 5)
    head = head << 2 * (HEAD - size)
    by = np.lexsort((sym, size, head))
    flat = (head[by], sym[by].astype(np.uint8), short[held][by])
    every = longer + np.bincount(flat[0], flat[2], len(longer)).astype(np.int64)
    passes = min(MOST_PASSES, max(1, -(-total // PASS)))
    # a bucket ends with the number that fills it
    full = np.cumsum(longer) - longer
    cuts = np.flatnonzero(np.diff(full // BUCKET)) + 1
    cuts = cuts[full[cuts] < total]
    bounds = np.concatenate([[0], cuts, [len(longer)]])
    starts = np.concatenate([[0], np.cumsum(every)])[bounds]
    share = np.linspace(0, len(bounds) - 1, min(passes, len(bounds) - 1) + 1).astype(int)
    parts = None
    for a, b in zip(share[:-1], share[1:]):
        part = written(_pass(packed, bounds[a : b + 1], starts[a : b + 1], flat, step))
        parts = part if parts is None else parts.unionByName(part)
    whole = parts.filter("not edge").select("block", "symbols")
    # what buckets share are two blocks each
    shared = parts.filter("edge").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "symbols"))).alias("s"))
    return whole.unionByName(shared.select("block", F.array_join(F.col("s.symbols"), "").alias("symbols")))
