"""Katz backoff language model over words, order 2, with Good-Turing discounts and exactly normalised backoff weights.

P(w | h) = d(r) r / c(h) for a pair seen r > 0 times, and alpha(h) P(w) otherwise; P(w) = d(c) c / N for a word seen in
training, and what the discounts leave for any word that was not. alpha(h) is what the seen pairs of h leave, over what
their words leave in P. Discounts are Katz's up to ``LAST`` and 1 beyond.

Rows of single words or pairs would move the corpus many times over, so tokens travel packed. Texts become chunks: the
distinct words of some thousand texts as 64-bit hashes, and the tokens as places among them. A chunk asks the bucket
of each word, later of each pair, for its count; buckets add up what all chunks hold and answer each chunk in its own
order. Both tables of answers, partitioned by bucket, lie in the shared folder. Buckets go by history, those of
frequent histories by the next word as well, so that no word, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import rows_of, scratch_table, settle, table, text_or_empty

#: Largest count that is discounted.
LAST = 5
#: Hashes that stand for the end of a text and for what precedes its first word.
END, START = np.uint64(1), np.uint64(2)
#: Tokens of a chunk and of a bucket, and training tokens of a history beyond which its pairs are spread.
CHUNK, BUCKET, SPREAD = 2_000_000, 2_000_000, 1_000_000
#: Most histories that are spread; their sums go to every chunk.
MOST_SPREAD = 1 << 16

CHUNKS = "chunk long, doc_ids binary, no_ids binary, train binary, lengths binary, words binary, tokens binary, n_tokens long"
ANSWERS = "chunk long, kind int, bucket int, counts binary, seen binary, sums binary, stats array<long>"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def chunks_of(docs: DataFrame, size: int) -> DataFrame:
    """The corpus as packed chunks of at least ``size`` tokens (fewer at the end of a partition)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, number = TaskContext.get().partitionId(), 0
        places: dict[str, int] = {}
        ids, lengths, tokens, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in places), np.uint64, len(places))
            words = np.concatenate([words, np.array([END], np.uint64)])
            row = [part << 24 | number, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), np.array([not held_out(i) for i in ids], np.uint8).tobytes(), _small(np.concatenate(lengths)), words.tobytes(), _small(np.concatenate(tokens) + 1), total]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        for doc_ids, texts in rows_of(batches):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
            coded = lists.values.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            here = np.fromiter((places.setdefault(w, len(places)) if w else -1 for w in distinct), np.int32, len(distinct))
            got = here[coded.indices.to_numpy()]
            owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[got >= 0]
            got = got[got >= 0]
            count = np.bincount(owner, minlength=len(texts)) + 1
            # the end of each text, marked -1 until the chunk's words are known
            flat = np.full(len(got) + len(texts), -1, np.int32)
            ends = np.cumsum(count) - 1
            inner = np.ones(len(flat), bool)
            inner[ends] = False
            flat[inner] = got
            ids += doc_ids
            lengths.append(count.astype(np.int64))
            tokens.append(flat)
            total += len(flat)
            if total >= size:
                yield close()
                number, places, ids, lengths, tokens, total = number + 1, {}, [], [], [], 0
        if ids:
            yield close()

    kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64()]
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    return text_or_empty(docs).mapInArrow(build, CHUNKS)


class Chunk:
    """A chunk's row, opened: its words, and its pairs in the order in which they are asked for."""

    def __init__(self, row):
        # bytes and a mask, as pandas would turn ids beside nulls into doubles
        self.ids = pd.arrays.IntegerArray(np.frombuffer(row.doc_ids, np.int64).copy(), np.frombuffer(row.no_ids, np.uint8).astype(bool))
        self.train = np.frombuffer(row.train, np.uint8).astype(bool)
        self.lengths = _read(row.lengths)
        self.words = np.frombuffer(row.words, np.uint64)
        self.tokens = _read(row.tokens).astype(np.int32) - 1
        self.tokens[self.tokens < 0] = len(self.words) - 1
        self.first = np.cumsum(self.lengths) - self.lengths
        self.trains = np.repeat(self.train, self.lengths)

    def word_order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words by bucket, and where each bucket starts."""
        return _by_bucket((self.words % np.uint64(buckets)).astype(np.int64), buckets)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trains], minlength=len(self.words))

    def pairs(self, counts: np.ndarray, buckets: int, spread: int) -> None:
        """Distinct (history, word) pairs; place len(words) is the start of a text."""
        n = len(self.words)
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = self.tokens[:-1]
        key[self.first] = n
        key *= n + 1
        key += self.tokens
        # np.unique with inverse, with fewer arrays of a place per token at once
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        keys = key[new]
        del key
        self.inverse = np.empty(len(order), np.int32)
        self.inverse[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        self.history, self.word = keys // (n + 1), keys % (n + 1)
        self.times = np.bincount(self.inverse[self.trains], minlength=len(keys))
        self.hashes = np.append(self.words, START)
        self.totals = np.append(counts, counts[-1])  # as many starts as ends
        self.shares = np.maximum(1, -(-self.totals // spread)).astype(np.uint64)
        salt = self.hashes[self.word] % self.shares[self.history]
        bucket = ((self.hashes[self.history] >> np.uint64(8)) + salt * np.uint64(7919)) % np.uint64(buckets)
        self.order, self.starts = _by_bucket(bucket.astype(np.int64), buckets)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _small(values: np.ndarray) -> bytes:
    """Counts or places in few bytes: the width that the largest needs, then their bytes by significance, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def _read(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel().astype(np.int64)


def _tally(counts: np.ndarray) -> list[int]:
    """Kinds and tokens seen, then how many kinds were seen 1, 2, ... LAST + 1 times."""
    return [int(np.count_nonzero(counts)), int(counts.sum()), *(int(np.count_nonzero(counts == r)) for r in range(1, LAST + 2))]


def discounts(times: list[int]) -> np.ndarray:
    """d(0), ... d(LAST) from the numbers of kinds seen 1, 2, ... LAST + 1 times.

    Where a Good-Turing estimate does not exist or does not discount, as in small corpora, half an occurrence goes.
    """
    n = [0, *times]
    out = np.ones(LAST + 1)
    rest = (LAST + 1) * n[LAST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LAST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """P(w) from a word's count; ``unseen`` is what all words not seen in training share."""

    def __init__(self, stats: list[int]):
        self.kinds, self.total, *times = stats
        self.d = discounts(times)
        seen = sum(self.d[r] * r * n for r, n in zip(range(1, LAST + 1), times)) + self.total - sum(r * n for r, n in zip(range(1, LAST + 1), times))
        self.scale = 1 / max(self.total, 1)
        if self.total and seen >= self.total:  # no discounted count occurs
            self.scale = 1 / (self.total + 1)
        self.unseen = 1.0 - seen * self.scale

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, np.where(counts <= LAST, self.d[np.minimum(counts, LAST)], 1.0) * counts * self.scale, self.unseen)


def ask_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Training counts of all words, answered to each chunk; rows with chunk -1 hold the buckets' tallies."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                c = Chunk(row)
                order, starts = c.word_order(buckets)
                words, counts = c.words[order], c.word_counts()[order]
                yield pd.DataFrame({"bucket": np.arange(buckets, dtype=np.int32), "chunk": row.chunk, "words": [words[a:b].tobytes() for a, b in zip(starts, starts[1:])], "counts": [_small(counts[a:b]) for a, b in zip(starts, starts[1:])]})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, np.uint64) for w in group.words]
        _, inverse = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([_read(c) for c in group.counts])).astype(np.int64)
        parts = np.split(counts[inverse], np.cumsum([len(w) for w in words])[:-1])
        out = pd.DataFrame({"chunk": group.chunk, "kind": 1, "bucket": group.bucket, "counts": [_small(p) for p in parts], "seen": None, "sums": None, "stats": None})
        out.loc[len(out)] = [-1, 1, int(group.bucket.iloc[0]), None, None, None, _tally(counts)]
        return out

    return chunks.mapInPandas(ask, "bucket int, chunk long, words binary, counts binary").groupBy("bucket").applyInPandas(answer, ANSWERS)


def _word_counts(c: Chunk, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    order, _ = c.word_order(buckets)
    counts = np.empty(len(c.words), np.int64)
    counts[order] = np.concatenate([_read(x) for x in answers[answers.kind == 1].sort_values("bucket").counts])
    return counts


def ask_pairs(chunks: DataFrame, words: DataFrame, unigrams: Unigrams, buckets: int, spread: int) -> DataFrame:
    """Training counts of all pairs and the sums of their histories, answered to each chunk.

    Rows with chunk -1 hold tallies; rows with chunk -2 the sums of histories that several buckets hold.
    """

    def ask(row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(row.iloc[0])
        counts = _word_counts(c, answers, buckets)
        c.pairs(counts, buckets, spread)
        out = []
        for b, (low, high) in enumerate(zip(c.starts, c.starts[1:])):
            pairs = c.order[low:high]
            history, followers = np.unique(c.history[pairs], return_counts=True)
            word, place = np.unique(c.word[pairs], return_inverse=True)
            out.append((b, row.chunk.iloc[0], c.hashes[history].tobytes(), _small(c.shares[history].astype(np.int64)), _small(followers), c.hashes[word].tobytes(), _small(counts[word]), _small(place), _small(c.times[pairs])))
        return pd.DataFrame(out, columns=columns)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        histories = [np.frombuffer(x, np.uint64) for x in group.histories]
        each = np.concatenate(histories)
        history, at = np.unique(each, return_inverse=True)
        shares = np.ones(len(history), np.int64)
        shares[at] = np.concatenate([_read(x) for x in group.shares])
        pair_history = np.repeat(at, np.concatenate([_read(x) for x in group.followers]))
        word, word_count = [], []
        for w, n, p in zip(group.words, group.counts, group.places):
            place = _read(p)
            word.append(np.frombuffer(w, np.uint64)[place])
            word_count.append(_read(n)[place])
        sizes = [len(w) for w in word]
        with np.errstate(over="ignore"):
            key = history[pair_history] * np.uint64(0x9E3779B97F4A7C15) ^ np.concatenate(word) * np.uint64(0xC2B2AE3D27D4EB4F)
        del word
        word_count = np.concatenate(word_count)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        del key
        r = np.bincount(inverse, np.concatenate([_read(x) for x in group.times])).astype(np.int64)
        mine, seen = pair_history[first], r > 0
        p = unigrams.p(word_count[first])
        del pair_history, word_count
        sums = np.zeros((len(history), LAST + 2))  # training tokens, pairs seen 1, ... LAST times, P of all words seen after
        sums[:, 0] = np.bincount(mine, r, len(history))
        for k in range(1, LAST + 1):
            sums[:, k] = np.bincount(mine[r == k], minlength=len(history))
        sums[:, -1] = np.bincount(mine[seen], p[seen], len(history))
        parts = np.split(r[inverse], np.cumsum(sizes)[:-1])
        own = np.split(at, np.cumsum([len(h) for h in histories])[:-1])
        whole = sums[:, :-1].T.astype(np.int64)  # all but the last are counts, small ones mostly
        out = pd.DataFrame({"chunk": group.chunk, "kind": 2, "bucket": group.bucket, "counts": [_small(x) for x in parts], "seen": [_small(whole[:, h].ravel()) for h in own], "sums": [sums[h, -1].tobytes() for h in own], "stats": None})
        bucket = int(group.bucket.iloc[0])
        out.loc[len(out)] = [-1, 2, bucket, None, None, None, _tally(r)]
        hot = np.flatnonzero(shares > 1)
        out.loc[len(out)] = [-2, 2, bucket, history[hot].tobytes(), None, sums[hot].tobytes(), None]
        return out

    columns = ["bucket", "chunk", "histories", "shares", "followers", "words", "counts", "places", "times"]
    kinds = "bucket int, chunk long, histories binary, shares binary, followers binary, words binary, counts binary, places binary, times binary"
    asked = chunks.groupBy("chunk").cogroup(words.filter("chunk >= 0").groupBy("chunk")).applyInPandas(ask, kinds)
    return asked.groupBy("bucket").applyInPandas(answer, ANSWERS)


def _stats(answers: DataFrame) -> list[int]:
    row = answers.filter("chunk = -1").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(LAST + 3)]).first()
    return [int(x or 0) for x in row]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, chunk_tokens: int = CHUNK, bucket_tokens: int = BUCKET, spread: int = SPREAD) -> DataFrame:
    """Base-10 log probability of every text by the model of the training texts, and by smoothed word counts.

    A token is a word in lower case (A-Z), or the end of a text. Null and empty texts are an end alone. Null ids are held out. Repeated
    rows train and are scored each. Further columns are ignored; no rows give no rows, and without training texts
    the words' base probabilities are all alike and the model gives 0 to no text.
    """
    chunks = scratch_table(chunks_of(docs, chunk_tokens), "chunks")
    total = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    spread = max(spread, total // MOST_SPREAD)
    words = scratch_table(ask_words(chunks, buckets), "words")
    settle(docs.sparkSession)
    unigrams = Unigrams(_stats(words))
    pairs = scratch_table(ask_pairs(chunks, words, unigrams, buckets, spread), "pairs")
    settle(docs.sparkSession)
    d = discounts(_stats(pairs)[2:])

    hot: dict[int, np.ndarray] = {}  # at most MOST_SPREAD histories
    for row in pairs.filter("chunk = -2").select("counts", "sums").toLocalIterator():
        hashes = np.frombuffer(row.counts, np.uint64)
        for h, s in zip(hashes.tolist(), np.frombuffer(row.sums).reshape(len(hashes), LAST + 2)):
            hot[h] = hot.get(h, 0) + s

    def evaluate(row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(row.iloc[0])
        counts = _word_counts(c, answers, buckets)
        c.pairs(counts, buckets, spread)
        r = np.empty(len(c.order), np.int64)
        sums = np.zeros((LAST + 2, len(c.hashes)))
        mine = answers[answers.kind == 2].set_index("bucket")
        for b, (low, high) in enumerate(zip(c.starts, c.starts[1:])):
            pairs_here = c.order[low:high]
            r[pairs_here] = _read(mine.counts[b])
            history = np.unique(c.history[pairs_here])
            sums[:-1, history] = _read(mine.seen[b]).reshape(LAST + 1, len(history))
            sums[-1, history] = np.frombuffer(mine.sums[b])
        for place in np.flatnonzero(c.shares[:-2] > 1).tolist() + [len(c.shares) - 1] * int(c.shares[-1] > 1):  # an end is no history
            sums[:, place] = hot[int(c.hashes[place])]
        seen = sums[0].copy()
        discounted = seen - sum((1 - d[k]) * k * sums[k] for k in range(1, LAST + 1))
        below = seen + (discounted >= seen)  # a history without discounted pairs leaves the mass of one more token
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(seen > 0, (1 - discounted / below) / np.maximum(1 - sums[-1], 1e-12), 1.0)
            p_word = unigrams.p(counts)
            high = np.where(r <= LAST, d[np.minimum(r, LAST)], 1.0) * r / below[c.history]
            log_p = np.log10(np.where(r > 0, high, alpha[c.history] * p_word[c.word]))
        base = np.log10((counts + 0.1) / (unigrams.total + 0.1 * (unigrams.kinds + 1)))
        return pd.DataFrame({
            "doc_id": c.ids, "held_out": ~c.train, "n_tokens": c.lengths,
            "n_known": np.add.reduceat((counts > 0)[c.tokens].astype(np.int64), c.first), "train_tokens": unigrams.total,
            "base_score": np.add.reduceat(base[c.tokens], c.first), "score": np.add.reduceat(log_p[c.inverse], c.first),
        })

    answers = words.unionByName(pairs).filter("chunk >= 0")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(evaluate, SCORES)


def op7_katz(spark, sf_dir):
    """All documents scored by the model of the training documents."""
    return score(table(spark, sf_dir, "documents"))
