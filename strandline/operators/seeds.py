"""Reads in Arrow batches as numbers: packed bases, minimizers and common prefixes.

A batch of reads is one array of bytes with each read's start and size; all work is numpy over that array. Packed reads have four bases a byte behind a
byte that says how many of the last four are padding; reads with other letters stay as they are behind ``RAW``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First byte of a read that is not packed.
RAW = 255
#: Bytes of a batch whose places fit into ``PLACE`` bits beside a hash.
PLACE, MOST = 24, 1 << 23

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_FOUR = np.frombuffer(b"ACGT", np.uint8)[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_LETTER = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64)


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and sizes of a column of strings or binaries without nulls."""
    held = column.cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2], np.uint8) if held.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def column(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The bytes of rows that follow each other as a column."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def places(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of all bytes of rows that begin at ``starts``."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """A row for each read, zeros after its end."""
    out = np.zeros((len(sizes), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = data[places(starts, sizes)[1]]
    return out


def pack(reads: pa.Array) -> pa.Array:
    data, starts, sizes = ragged(reads)
    code = _CODE[data]
    if (code > 3).any():
        return pa.array([bytes([RAW]) + x.encode() if set(x) - set("ACGT") else pack(pa.array([x]))[0].as_py() for x in reads.to_pylist()], pa.binary())
    most = -(-int(sizes.max(initial=0)) // 4)
    codes = matrix(code, starts, sizes, 4 * most).reshape(len(sizes), most, 4)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    full, size = np.hstack([(-sizes % 4).astype(np.uint8)[:, None], packed]), -(-sizes // 4) + 1
    return column(full[np.arange(most + 1) < size[:, None]], size, pa.binary())


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and sizes of packed reads."""
    data, starts, sizes = ragged(packed)
    head = data[starts]
    if (head == RAW).any():
        one = lambda bases, _, sizes: bases[: sizes[0]].tobytes()
        return ragged(pa.array([x[1:] if x[0] == RAW else one(*unpack(pa.array([x], pa.binary()))) for x in packed.to_pylist()], pa.binary()))
    body = np.ones(len(data), bool)
    body[starts] = False
    bases, room = _FOUR[data[body]].ravel(), 4 * (sizes - 1)
    # a read's bases begin on a byte; padding stays behind them
    return bases, np.cumsum(room) - room, room - head


def words(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place on; those that cross a read's end mean nothing."""
    h, n, room = _LETTER[data], 1, max(0, len(data) - k + 1)
    while 2 * n <= k:
        h = h[:-n] * (_MIX[0] + np.uint64(2 * n)) + h[n:]
        n *= 2
    if n < k:
        h = h[: len(h) - (k - n)] * _MIX[1] + h[k - n :]
    h = h[:room]
    h = (h ^ (h >> np.uint64(32))) * _MIX[2]
    return h ^ (h >> np.uint64(29))


def minimizers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and place in its read of each word that is the least of some window of ``least`` bases (``first``: of the read's first window).

    A word has two thirds of a window's bases, and of equal ones the first counts, so equal windows have one word at one place. Reads hold ``least`` bases or more.
    """
    word = max(1, 2 * least // 3)
    h = words(data, word)
    # a window's least word and its place are one number
    low = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    n, span = 1, least - word + 1
    while 2 * n <= span:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < span:
        low = np.minimum(low[: len(low) - (span - n)], low[span - n :])
    row, at = places(starts, np.ones_like(sizes) if first else sizes - least + 1)
    at = (low[at] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    if not first and len(at):
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        row, at = row[new], at[new]
    return row, h[at].view(np.int64), at - starts[row]


def common(left: tuple, right: tuple, at: np.ndarray) -> np.ndarray:
    """Bases on which each left read from place ``at`` on agrees with the right read."""
    size = np.minimum(left[2] - at, right[2])
    width = int(size.max(initial=0))
    inside = np.arange(width) < size[:, None]

    def cut(data, starts):
        index = starts[:, None] + np.arange(width)
        return np.take(data, index, mode="clip")

    differs = (cut(left[0], left[1] + at) != cut(right[0], right[1])) & inside
    if not width:
        return size
    return np.where(differs.any(axis=1), differs.argmax(axis=1), size)


def slices(batches: Iterator[pa.RecordBatch], name: str, per_byte: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of ``MOST`` bytes at most; a byte of the column stands for ``per_byte``."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.column(name).nbytes * per_byte > MOST:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (id, seq, copies) with packed bases."""

    def each(batches):
        for b in slices(batches, "seq"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pack(b.column("seq")), b.column("copies")], ["id", "seq", "copies"])

    return rows.select(F.col("id").cast("long"), "seq", F.col("copies").cast("long")).mapInArrow(each, "id long, seq binary, copies long")


def anchors(rows: DataFrame, least: int, first: bool = False) -> DataFrame:
    """id, seed, at of the minimizers of packed ``rows``; of first windows with the reads' packed bases and copies."""

    def each(batches):
        for b in slices(batches, "seq", 4):
            row, seed, at = minimizers(*unpack(b.column("seq")), least, first)
            out = [b.column("id").take(pa.array(row)), pa.array(seed), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out + ([b.column("seq"), b.column("copies")] if first else []), ["id", "seed", "at", "seq", "copies"][: 5 if first else 3])

    return rows.mapInArrow(each, "id long, seed long, at int" + (", seq binary, copies long" if first else ""))


def agreeing(pairs: DataFrame, least: int, ahead: int) -> DataFrame:
    """l, p, r, copies, ln, rn, k, rest of pairs (l, ls, p, r, rs, copies; packed bases, places from 1): both lengths, the bases on which r agrees with l from p on,
    ``least`` or more, and the ``ahead`` bases of r after those."""

    def each(batches):
        for b in slices(batches, "ls", 4):
            left, right, at = unpack(b.column("ls")), unpack(b.column("rs")), b.column("p").to_numpy(zero_copy_only=False).astype(np.int64) - 1
            fits = np.flatnonzero((at >= 0) & (at + least <= left[2]))
            if not len(fits):
                continue
            k = common((left[0], left[1][fits], left[2][fits]), (right[0], right[1][fits], right[2][fits]), at[fits])
            good = k >= least
            kept, k = fits[good], k[good]
            more = np.minimum(right[2][kept] - k, ahead)
            rest = column(right[0][places(right[1][kept] + k, more)[1]], more, pa.string())
            index = pa.array(kept)
            own = [b.column(c).take(index) for c in ("l", "p", "r", "copies")]
            sizes = [pa.array(x.astype(np.int32)) for x in (left[2][kept], right[2][kept], k)]
            yield pa.RecordBatch.from_arrays([*own, *sizes, rest], ["l", "p", "r", "copies", "ln", "rn", "k", "rest"])

    return pairs.select("l", "ls", "p", "r", "rs", "copies").mapInArrow(each, "l long, p int, r long, copies long, ln int, rn int, k int, rest string")
