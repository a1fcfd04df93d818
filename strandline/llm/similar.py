"""Near-duplicate documents at a given similarity of word shingles: every pair that reaches it is found and checked exactly.

Two texts of that similarity share a shingle among the first few of either (about a fifth at 0.8) in any one order of all
shingles. Texts that share such a shingle, and whose sizes, places and bit signatures allow the similarity, are compared on
their whole shingles. Frequent shingles, estimated from a sample of texts, come last in the order; the order changes the work and never
the result. A first round compares each class with one likely centre, and the classes whose SimHash fingerprints meet in the
covering join of ``simhash``, so that a large group is mostly one component before all remaining pairs of distinct
components are compared.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.common import drop_table, rows_of, scratch_table, settle, text_or_empty
from strandline.llm.graph import components

#: One text in so many is counted for the order of shingles, from so many of them a shingle is frequent; most that are told apart.
SAMPLE, FREQUENT, MOST = 12, 5, 200_000
#: Longs of a bit signature, and most digests (16 bytes) that the executors hold each as a list of what to read.
LANES, FEW = 8, 1_000_000


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, in order; fewer words are one shingle, no words none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[-n:].tolist())], np.uint64))


def frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of frequent shingles, the most frequent last."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in rows_of(batches):
            found = [shingles(t.encode("utf-8", "surrogatepass"), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    sample = docs.select(F.lit(0).cast("long").alias("doc_id"), "text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counts = text_or_empty(sample).mapInArrow(each, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST).select("shingle").toArrow()
    return top.column(0).to_numpy().view(np.uint64)[::-1]


def prefix(hashes: np.ndarray, least: float, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a text, one of which each text of the similarity has among its own; ``known`` sorted, ``rank`` its places."""
    if not len(hashes):
        return hashes
    count = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
    if not len(known):
        return hashes[:count]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return hashes[np.argsort(np.where(known[at] == hashes, rank[at] + 1, 0), kind="stable")[:count]]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each bit: two texts differ in as many shingles at least as their signatures do in bits."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * LANES), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the shingles, as a signed long."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(lanes[:, k], minlength=256) for k in range(8)]) @ simhash.BITS
    return int(np.packbits(2 * counts.reshape(64) > len(hashes), bitorder="little").view("<i8")[0])


MARKED = "doc_id long, class long, n int, fp long, prefix array<long>, bits array<long>, text_key binary"


def marked(docs: DataFrame, least: float, shingle: int) -> DataFrame:
    """Per row of ``docs``: the class of its shingles (texts of equal shingles have one), their number, what it is joined on, and the digest of the text, by which it is found again."""
    order = frequent(docs, shingle)
    rank = np.argsort(order)
    known = order[rank]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, texts in rows_of(batches):
            rows = []
            for doc, text in zip(ids, texts):
                raw = text.encode("utf-8", "surrogatepass")
                h = shingles(raw, shingle)
                rows.append((doc, xxhash.xxh64_intdigest(h.tobytes(), 42) - 2**63, len(h), fingerprint(h), prefix(h, least, known, rank).view(np.int64), signature(h), hashlib.md5(raw).digest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = [f.split()[0] for f in MARKED.split(", ")]
    return text_or_empty(docs).mapInArrow(mark, MARKED)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of sorted hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def shared(classes: DataFrame) -> DataFrame:
    """token, class, n, bits, i: the first shingles that more than one class has among its first, and their place in the class."""
    tokens = classes.select("class", "n", F.posexplode("prefix").alias("i", "token"))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("token")
    return tokens.join(several, "token")


def starred(members: DataFrame, least: float) -> DataFrame:
    """Pairs a < b: every class with the one likely centre that it shares most first shingles with."""
    weight = members.groupBy("class").agg(F.count(F.lit(1)).alias("w"))
    weighed = members.select("token", "class", "n").join(weight, "class")
    centres = weighed.groupBy("token").agg(F.max(F.struct("w", "class", "n")).alias("c")).select("token", F.col("c.class").alias("centre"), F.col("c.n").alias("m"))
    met = members.select("token", "class", "n").join(centres, "token").filter(F.col("class") != F.col("centre")).filter(F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)
    best = met.groupBy("class", "centre").agg(F.count(F.lit(1)).alias("k")).groupBy("class").agg(F.max(F.struct("k", "centre")).alias("x"))
    return best.select(F.least("class", "x.centre").alias("a"), F.greatest("class", "x.centre").alias("b")).distinct()


def covered(classes: DataFrame, least: float, threshold: int = 2) -> DataFrame:
    """Pairs a < b of classes whose fingerprints differ in few bits, each fingerprint by its least class, and of those with equal ones."""
    held = scratch_table(classes.groupBy("fp").agg(F.min(F.struct("class", "n")).alias("c")).select("fp", F.col("c.class").alias("a"), F.col("c.n").alias("m")), "fingerprints")
    equal = classes.select("fp", F.col("class").alias("b"), "n").join(held, "fp").filter(F.col("a") != F.col("b"))
    met = simhash.links(held.select("fp"), threshold).withColumnsRenamed({"a": "one", "b": "two"})
    near = met.join(held.withColumnsRenamed({"fp": "one"}), "one").join(held.withColumnsRenamed({"fp": "two", "a": "b", "m": "n"}), "two")
    both = equal.select("a", "b", "m", "n").unionByName(near.select("a", "b", "m", "n")).filter(F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def remaining(members: DataFrame, signatures: DataFrame, joined: DataFrame, least: float) -> DataFrame:
    """Every pair a, b of classes of distinct components whose first shingles, sizes, places and signatures allow the similarity."""
    named = members.join(joined.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    held = named.join(open_, "token").join(signatures, "class")
    held = scratch_table(held.select("token", "class", "n", "i", "component", *[F.col("bits")[k].alias(f"b{k}") for k in range(LANES)]), "open")
    x, y = held.alias("x"), held.alias("y")
    size, both = F.col("x.n") + F.col("y.n"), F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    differ = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(LANES)), F.lit(0))
    near = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") < F.col("y.class")))) & (F.col("x.n") >= least * F.col("y.n") - 1e-9)
        & (both >= least / (1 + least) * size - 1e-6) & (differ <= (1 - least) / (1 + least) * size + 1e-6)
    )
    return x.join(y, near).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def checked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those of the pairs whose whole shingles have the similarity. Only texts that stand in a pair are moved, each once a pair."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = functools.lru_cache(256)(lambda text: shingles(text.encode("utf-8", "surrogatepass"), shingle))
        for batch in batches:
            keep = [similarity(of(x.as_py()), of(y.as_py())) >= least for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = scratch_table(pairs, "pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = classes.select("class", "text_key").join(met, "class")
    keys = wanted.select("text_key").distinct()
    texts = text_or_empty(docs).select(F.unhex(F.md5("text")).alias("text_key"), "text")
    texts = texts.join(F.broadcast(keys) if 2 * pairs.count() <= FEW else keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    held = scratch_table(texts.join(wanted, "text_key").select("class", "text"), "texts")
    both = pairs.join(held.withColumnsRenamed({"class": "a", "text": "x"}), "a").join(held.withColumnsRenamed({"class": "b", "text": "y"}), "b")
    return scratch_table(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "alike")


def links(docs: DataFrame, classes: DataFrame, least: float, shingle: int) -> DataFrame:
    """Pairs a, b of classes that connect what the similarity connects: each class with its component of the first round, and the remaining pairs.

    A component found in the first round goes on as a star, so that naming the components of all pairs takes it as one step.
    """
    members = scratch_table(shared(classes), "members")
    settle(docs.sparkSession)
    met = scratch_table(covered(classes, least), "covered")
    settle(docs.sparkSession)
    first = checked(docs, classes, starred(members, least).unionByName(met).distinct(), least, shingle)
    joined = scratch_table(components(first), "joined")
    stars = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return stars.unionByName(checked(docs, classes, remaining(members, classes.select("class", "bits"), joined, least), least, shingle))


def _grouped(docs: DataFrame, least: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, text_key of every row) and (class, least, component of every class), as written tables."""
    marks = scratch_table(marked(docs, least, shingle), "shingles")
    one = F.first(F.struct("text_key", "n", "fp", "prefix", "bits")).alias("one")
    classes = scratch_table(marks.groupBy("class").agg(F.min("doc_id").alias("least"), one).select("class", "least", "one.*"), "classes")
    rows = scratch_table(marks.select("doc_id", "class", "text_key"), "rows")
    drop_table(marks)
    joined = components(links(docs, classes, least, shingle)).withColumnsRenamed({"node": "class"})
    return rows, scratch_table(classes.select("class", "least").join(joined, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component")), "grouped")


def groups(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, component_id (least doc_id of its near-duplicate group), one row per row of ``docs``.

    Texts without words, null ones included, are one group. Null ids keep their rows. A text of any length is compared on all its
    shingles. Further columns are ignored; no rows give no rows. ``docs`` is read a second time for the texts of the pairs.
    """
    rows, grouped = _grouped(docs, least, shingle)
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select("class", "component_id")
    return rows.select("doc_id", "class").join(named, "class").select("doc_id", "component_id")


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of its least doc_id (of several texts under that id the least digest).

    Rows are told apart by id and text, so that different texts under one id are all kept unless they are near-duplicates. Rows
    with a null doc_id all stay; of rows with the same id and text one stays.
    """
    rows, grouped = _grouped(docs, least, shingle)
    # ids and digests are summed up before they meet: of a group of copies each task sends one row
    each = rows.filter("doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    chosen = each.join(grouped.select("class", "component"), "class").groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key").distinct()
    keyed = docs.filter("doc_id is not null").withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = keyed.join(chosen.withColumnRenamed("text_key", "_key"), ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.filter("doc_id is null"))
