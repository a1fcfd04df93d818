"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code. A fingerprint is at home with its nearest anchor, within the code's
covering radius, and is replicated to every anchor within covering radius plus threshold; two fingerprints within the
threshold therefore meet at the home of either, and are compared there and nowhere else.

The code is two binary Golay codes, each perfect on 23 bits with covering radius 3, on the first 46 bits; the other
18 bits are free. Distances add over the two halves, so a fingerprint reaches an anchor pair if its distances
beyond radius 3 add to the threshold at most. That leaves 2**24 anchors and some 60 replicas of a fingerprint.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import rows_of, scratch_table, table, text_or_empty
from strandline.llm.graph import components

#: Generator polynomial of the binary Golay code of length 23, its length, and its covering radius.
GOLAY, LENGTH, RADIUS = 0b101011100011, 23, 3
CHECKS = 11

#: The bits of every byte value, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; no words give 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[-n:].tolist())], "<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(lanes[:, k], minlength=256) for k in range(8)]) @ BITS
    return int(np.packbits(2 * counts.reshape(64) > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long; a null text counts as one without words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            values = np.array([fingerprint(t.encode("utf-8", "surrogatepass"), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return text_or_empty(docs).mapInArrow(of, "doc_id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - CHECKS)), rest)
    return rest


@functools.cache
def patterns(beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns at distance RADIUS + ``beyond`` exactly (at most RADIUS for 0), ordered by syndrome, and where each syndrome starts."""
    weights = range(RADIUS + 1) if beyond == 0 else [RADIUS + beyond]
    every = np.array([sum(1 << b for b in bits) for w in weights for bits in itertools.combinations(range(LENGTH), w)], np.int64)
    by = syndromes(every)
    order = np.argsort(by, kind="stable")
    return every[order], np.searchsorted(by[order], np.arange((1 << CHECKS) + 1))


def anchors(words: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``words``, anchor) for each anchor at that distance; anchors by their 12 message bits."""
    errors, first = patterns(beyond)
    s = syndromes(words)
    count = first[s + 1] - first[s]
    which = np.repeat(np.arange(len(words)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[s], count)
    return which, (words[which] ^ errors[place]) >> CHECKS


def halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << LENGTH) - 1
    return fp & mask, fp >> LENGTH & mask


def homes(fp: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint."""
    left, right = (anchors(h, 0)[1] for h in halves(fp))
    return left << 12 | right


def reached(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every anchor within covering radius plus threshold."""
    left, right = halves(fp)
    at, keys = [], []
    for a in range(threshold + 1):
        one, left_keys = anchors(left, a)
        for b in range(threshold + 1 - a):
            two, right_keys = anchors(right[one], b)
            at.append(one[two])
            keys.append(left_keys[two] << 12 | right_keys)
    return np.concatenate(at), np.concatenate(keys)


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in 1 to ``threshold`` bits."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(homes(fp)), pa.array(fp)], names=["anchor", "a"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for k in range(0, len(every), 2000):
                fp = every[k : k + 2000]
                at, keys = reached(fp, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], names=["anchor", "b"])

    at_home = distinct.select("fp").mapInArrow(home, "anchor long, a long")
    everywhere = distinct.select("fp").mapInArrow(replicate, "anchor long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # sizes are known of the fingerprints, not of their replicas: neither side may be broadcast on such an estimate
    return at_home.hint("merge").join(everywhere, "anchor").filter(near).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links), one row per row of ``docs``.

    Texts of equal fingerprint form a class; only classes are compared, so copies are never paired with each other. Texts
    without words, null ones included, have fingerprint 0 and link like any other. A null doc_id keeps its row and never
    names a component unless its whole component has none. Further columns are ignored; no rows give no rows.
    """
    marked = scratch_table(fingerprints(docs, shingle), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = scratch_table(classes, "classes")
    joined = components(links(classes, threshold)).withColumnsRenamed({"node": "fp"})
    grouped = scratch_table(classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "grouped")
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))

