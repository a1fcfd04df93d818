"""Bounded-space online packing of token ids into training windows.

Every partition holds a fixed number of open windows. A piece goes to the open window that it fills best; when
none has room and no more may be opened, the fullest is emitted (its gap first filled with the head of the
piece, if the gap is worth a cut). The windows left open at the end of the partitions are dealt evenly to as many groups as
there are some hundred of them, merged there by the same rule, and then laid end to end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import rows_of, scratch_table, text_or_empty
from strandline.llm.tokens import encoder

#: Bits of a sequence id below the partition number.
LOCAL_BITS = 36


class Windows:
    """Best-fit placing of (doc_id, start, ids, doc_tokens) pieces into at most ``most`` open windows."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.open: list[list] = []  # [tokens so far, pieces]

    def place(self, piece: tuple) -> Iterator[list]:
        """Yields the windows that this piece closes, as lists of pieces."""
        doc, start, ids, total = piece
        while len(ids) >= self.size:
            yield [(doc, start, ids[: self.size], total)]
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        fits = [w for w in self.open if self.size - w[0] >= len(ids)]
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            if len(self.open) >= self.most:
                fullest = max(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                gap = self.size - fullest[0]
                if gap >= self.least_cut:
                    fullest[1].append((doc, start, ids[:gap], total))
                    start, ids = start + gap, ids[gap:]
                yield fullest[1]
            best = [0, []]
            self.open.append(best)
        best[0] += len(ids)
        best[1].append((doc, start, ids, total))
        if best[0] == self.size:
            self.open.remove(best)
            yield best[1]

    def flush(self) -> Iterator[list]:
        """The rest laid end to end, fullest first."""
        pieces: list = []
        used = 0
        for _, held in sorted(self.open, key=lambda w: -w[0]):
            for doc, start, ids, total in held:
                while used + len(ids) >= self.size:
                    room = self.size - used
                    pieces.append((doc, start, ids[:room], total))
                    yield pieces
                    pieces, used, start, ids = [], 0, start + room, ids[room:]
                if len(ids):
                    pieces.append((doc, start, ids, total))
                    used += len(ids)
        if pieces:
            yield pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"


def _rows(windows: Iterator[list], first: int, with_ids: bool, still_open: bool = False) -> Iterator[dict]:
    for n, pieces in enumerate(windows, first):
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            yield {"doc_id": doc, "start": start, "length": len(ids), "ids_crc32": zlib.crc32(raw), "doc_tokens": total, "sequence_id": n, "offset": offset, "ids": raw if with_ids or still_open else None, "open": still_open}
            offset += len(ids)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, open_windows: int = 32, least_cut: int = 32, merge_windows: int = 128, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    A document is its ids, by the library's encoding of the whole text, and ``end_id``; each id lies in exactly
    one piece. Null and empty texts are one end id. A null doc_id stays null. Repeated rows are packed
    each on its own. Further columns of ``docs`` are ignored; an empty table gives no rows. ``ids`` are
    little-endian unsigned 32-bit integers.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokens, windows = encoder(vocabulary, joined=False), Windows(size, open_windows, least_cut)
        first = part << LOCAL_BITS
        end = np.array([end_id], np.uint32)
        for doc_ids, texts in rows_of(batches):
            closed = []
            for doc, ids in zip(doc_ids, tokens.encode(texts)):
                ids = np.concatenate([ids, end])
                closed += windows.place((doc, 0, ids, len(ids)))
            if closed:
                yield pa.RecordBatch.from_pylist(list(_rows(closed, first, with_ids)), schema)
                first += len(closed)
        left = [held for _, held in windows.open]
        if left:
            yield pa.RecordBatch.from_pylist(list(_rows(left, first, True, True)), schema)

    def merge(group: pa.Table) -> pa.Table:  # Arrow, as pandas would turn ids beside nulls into doubles
        rows = group.to_pylist()
        windows = Windows(size, len(rows) + 1, least_cut)
        closed = []
        for r in sorted(rows, key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
            closed += windows.place((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        closed += windows.flush()
        return pa.Table.from_pylist(list(_rows(closed, (1 << 62) | (rows[0]["dealt"] << LOCAL_BITS), with_ids)), schema)

    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.bool_() if t == "boolean" else pa.int64()) for n, t in (f.split() for f in SCHEMA.split(", "))])
    placed = scratch_table(text_or_empty(docs).mapInArrow(place, SCHEMA), "packed")
    left = placed.filter("open")
    groups = max(1, left.filter("offset = 0").count() // merge_windows)
    merged = left.withColumn("dealt", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("dealt").applyInArrow(merge, SCHEMA)
    out = placed.filter("not open").unionByName(merged).drop("open")
    return out if with_ids else out.drop("ids")


def op3_packing(spark, sf_dir):
    """Every document packed into sequences of 2048 ids."""
    from strandline.llm.common import table
    from strandline.llm.tokens import vocabulary_path

    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), with_ids=False)
