"""Token ids in patched frame-of-reference blocks.

A file holds whole documents in order. Its ids are cut into blocks of 256; a block stores its minimum, a width
that a given share of its differences fits, the differences packed at that width, and the few wider ones as
(position, value) exceptions. The starts of all blocks are indexed in the header, so that any run of ids can be
read alone. Files are rows of a table in the shared folder: Spark commits them, and a lost task writes its own again.

Layout, little-endian: magic "PFR1", block size, ids, documents, blocks (u4 each); document ids (i8), their
lengths (u4), and whether an id is null (u1); per block: minimum (u4), start of its words in the packed area (u4), first exception (u4), width (u1);
then the packed area (u4 words) and the exceptions: position in block (u2) and difference (u4).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import rows_of, scratch_table, table, text_or_empty
from strandline.llm.tokens import encoder, vocabulary_path

MAGIC = b"PFR1"
#: Ids of a block, and ids that are packed together into ``width`` words.
BLOCK, RUN = 256, 32
#: Characters that are encoded at once; all that is held is hashed again for each such slice.
SLICE = 8_000_000


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(runs, 32) values below 2**width to (runs, width) words."""
    out = np.zeros((width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(RUN):
        word, shift = divmod(i * width, 32)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 32:
            out[word + 1] |= columns[i] >> np.uint64(32 - shift)
    return np.ascontiguousarray(out.T.astype(np.uint32))


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(runs, width) words to (runs, 32) values."""
    rows = np.ascontiguousarray(words.T).astype(np.uint64)
    out = np.empty((RUN, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(RUN):
        word, shift = divmod(i * width, 32)
        got = rows[word] >> np.uint64(shift)
        if shift + width > 32:
            got = got | (rows[word + 1] << np.uint64(32 - shift))
        out[i] = got & mask
    return out.T.astype(np.uint32)


def write_file(doc_ids: list, ids: list[np.ndarray], percentile: float = 90.0) -> bytes:
    """The bytes of a file; ``ids`` has one array per document."""
    lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32)
    blocks = -(-len(flat) // BLOCK)
    fill = blocks * BLOCK - len(flat)
    values = np.concatenate([flat, np.repeat(flat[-1:], fill)]).reshape(blocks, BLOCK)
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    over = values - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    chosen = np.partition(over, rank, axis=1)[:, rank] if blocks else low
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    wide = over >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    at, position = np.nonzero(wide)
    first = np.searchsorted(at, np.arange(blocks)).astype(np.uint32)
    beyond = over[at, position].astype(np.uint32)
    over = np.where(wide, 0, over)
    words = width.astype(np.int64) * (BLOCK // RUN)
    start = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()), np.uint32)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        got = _pack(over[which].reshape(-1, RUN), int(w)).reshape(len(which), -1)
        packed[start[which][:, None] + np.arange(got.shape[1])] = got
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], "u1")
    head = np.array([BLOCK, len(flat), len(ids), blocks], "<u4")
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), lengths.astype("<u4").tobytes(), none.tobytes(), low.astype("<u4").tobytes(), start.astype("<u4").tobytes(), first.tobytes(), width.tobytes(), packed.astype("<u4").tobytes(), position.astype("<u2").tobytes(), beyond.astype("<u4").tobytes()])


def read_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, all ids) of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    place = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal place
        got = np.frombuffer(content, kind, n, place)
        place += got.nbytes
        return got

    block, total, documents, blocks = (int(x) for x in take("<u4", 4))
    keys, lengths, none = take("<i8", documents), take("<u4", documents), take("u1", documents)
    low, start, first, width = take("<u4", blocks), take("<u4", blocks).astype(np.int64), take("<u4", blocks), take("u1", blocks)
    packed = take("<u4", int(width.astype(np.int64).sum()) * (block // RUN))
    wide = (len(content) - place) // 6
    position, beyond = take("<u2", wide), take("<u4", wide)
    values = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        words = packed[start[which][:, None] + np.arange(int(w) * (block // RUN))]
        values[which] = _unpack(words.reshape(-1, int(w)), int(w)).reshape(len(which), block)
    if wide:
        owner = np.repeat(np.arange(blocks), np.diff(np.append(first, wide).astype(np.int64)))
        values[owner, position] = beyond
    values += low[:, None]
    return [None if n else int(k) for k, n in zip(keys, none)], lengths, values.reshape(-1)[:total]


FILES = "part int, file int, n_ids long, content binary"
READ = "doc_id long, part int, file int, at long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, file_ids: int = 1_000_000) -> DataFrame:
    """A table of files (part, file, n_ids, content), documents in ascending doc_id order over (part, file).

    Null ids come first; equal ids by text, repeated rows each on their own; null texts are empty and hold the
    end id alone; further columns are ignored. A file closes at ``file_ids`` ids, so a task holds one file's ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, end = TaskContext.get().partitionId(), encoder(vocabulary, joined=True), np.array([end_id], np.uint32)
        keys, held, size, file = [], [], 0, 0

        def close():
            return pa.RecordBatch.from_pylist([{"part": part, "file": file, "n_ids": size, "content": write_file(keys, held)}], schema)

        for doc_ids, texts in rows_of(batches, SLICE):
            for doc, ids in zip(doc_ids, tokens.encode(texts)):
                keys.append(doc)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= file_ids:
                    yield close()
                    keys, held, size, file = [], [], 0, file + 1
        if keys:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("content", pa.binary())])
    ordered = text_or_empty(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch_table(ordered.mapInArrow(encode, FILES), "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it over all files), n_tokens and ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys, lengths, ids = read_file(content.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=[f.split()[0] for f in READ.split(", ")])

    # one row per part in the first window and one per file in the second: the ids themselves never meet
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    starts = files.select("part", "file", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")).alias("file_start"))
    rows = files.select("part", "file", "content").mapInArrow(decode, READ)
    placed = rows.join(starts.join(parts, "part"), ["part", "file"])
    return placed.select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir):
    """Ids of every document, written to files and read back."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")))
