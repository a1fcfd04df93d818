"""Phrase collocations from vertical positional lists: phrases grow word by word, and a list's length is the phrase's frequency.

Texts become chunks of some million words of one language. A chunk holds postings: places of its words in order, with a gap
between pieces, so that no phrase crosses one. At each length a chunk's lists of the phrases that are frequent everywhere are merged with the
postings of the words after them (place + length), and with the lists of what follows, as a phrase can only be frequent if all parts
of it are. The lengths of the longer lists are summed over all chunks by Spark; what reaches the threshold goes back to the chunks that hold it, and postings that no list
covers any more are dropped. So a chunk's state shrinks with each length and nothing is gathered beyond a chunk.

Words are 64-bit hashes, phrases sums of them under powers of an odd number. Strings leave a chunk for frequent phrases only, each from one chunk, and all others
compare; a hash that stands for two phrases is found there and is an error (another ``seed`` helps), so frequencies are exact or not returned. The scores are DataFrame functions on exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import drop_table, rows_of, scratch_table, settle, table

#: Words of a chunk, least frequency, longest phrase, and phrases that are reported for a language.
CHUNK, LEAST, LONGEST, MOST = 2_000_000, 100, 5, 2000
#: Fixed value: an odd number that phrases' words are summed under.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Frequent phrases that are broadcast at most (sixteen bytes each), and parts of a language that are ranked first.
MOST_BROADCAST, PARTS = 1_000_000, 64
#: A-Z in lower case, ends of pieces as line ends, tabs as blanks.
BYTES = bytes(b"\n"[0] if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
ROWS = "chunk long, lang string, words binary, places binary, ids binary, keys binary, n_words long, key long, phrase string"
NAMES = [f.split()[0] for f in ROWS.split(", ")]
KINDS = dict(zip(NAMES, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string())))


def _packed(values: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def _opened(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel().astype(np.int64)


def _table(**columns) -> pa.RecordBatch:
    """A batch of ``ROWS``; columns that are not given are null."""
    n = len(columns["chunk"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], KINDS[c]) if c in columns else pa.nulls(n, KINDS[c]) for c in NAMES], names=NAMES)


class Postings:
    """Words of a chunk at their places, in order: ``places`` and ``ids``, the words' strings and hashes."""

    def __init__(self, chunk: int, lang: str, words: list[str], places: np.ndarray, ids: np.ndarray, seed: int):
        import xxhash

        self.chunk, self.lang, self.words, self.places, self.ids = chunk, lang, words, places, ids
        start = xxhash.xxh64_intdigest(lang, seed)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, start) for w in words), np.uint64, len(words))

    @classmethod
    def read(cls, row, seed: int) -> Postings:
        words = zstandard.ZstdDecompressor().decompress(row.words).decode().split("\t")
        return cls(row.chunk, row.lang, words, np.cumsum(_opened(row.places)), _opened(row.ids), seed)

    def state(self, keep: np.ndarray, keys: np.ndarray, n_words: int | None = None) -> pa.RecordBatch:
        """The postings at ``keep`` as a row, with the words that they need and the keys of the frequent phrases among them."""
        used, ids = np.unique(self.ids[keep], return_inverse=True)
        words = zstandard.ZstdCompressor(level=1).compress("\t".join([self.words[i] for i in used]).encode())
        return _table(chunk=[self.chunk], lang=[self.lang], words=[words], places=[_packed(np.diff(self.places[keep], prepend=0))], ids=[_packed(ids)], keys=[keys.tobytes()], n_words=[n_words])

    def heads(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings at which ``length`` words follow each other, and the keys of these phrases."""
        at = np.arange(max(0, len(self.places) - length + 1))
        at = at[self.places[at + length - 1] - self.places[at] == length - 1]
        with np.errstate(over="ignore"):
            key = self.hashes[self.ids[at]]
            for k in range(1, length):
                key = key * BASE + self.hashes[self.ids[at + k]]
        return at, key

    def lists(self, length: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the phrases of ``length`` words whose keys are among ``frequent`` (sorted): postings and keys, in order of places."""
        at, key = self.heads(length)
        if not len(frequent):
            return at[:0], key[:0]
        found = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
        return at[found], key[found]

    def extended(self, at: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases one word longer: lists merged by place with those that begin one place on, and the postings of the word at the end."""
        after = np.searchsorted(at, at + 1)
        both = at[np.minimum(after, len(at) - 1)] == at + 1 if len(at) else np.zeros(0, bool)
        # neighbours in the order of places stand next to each other only if their places do
        both &= self.places[np.minimum(at + 1, len(self.places) - 1)] == self.places[at] + 1
        at, key = at[both], key[both]
        with np.errstate(over="ignore"):
            return at, key * BASE + self.hashes[self.ids[at + length]]

    def strings(self, at: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, list[str]]:
        """Keys and strings of the lists; an error if a key stands for two phrases."""
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        for k in range(length):
            ids = self.ids[at + k]
            if (ids != ids[first][inverse]).any():
                raise ValueError("two phrases share a hash: choose another seed")
        spelt = [[self.words[i] for i in self.ids[at[first] + k]] for k in range(length)]
        return keys, [" ".join(p) for p in zip(*spelt)]


def chunks_of(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """``ROWS`` of the chunks' states.

    A partition fills one chunk for each language; when all together hold ``size`` words the largest is closed.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        open_: dict[str, list] = {}  # words, then parts of places and ids, the next place and the number of words

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            known, places, ids, _, n = open_.pop(lang)
            p = Postings(part << 24 | number, lang, list(known), np.concatenate(places), np.concatenate(ids), seed)
            number, held = number + 1, held - n
            if n:
                yield p.state(np.arange(n), p.hashes[:0], n)

        for langs, texts in rows_of(batches, 1_000_000):
            for lang in dict.fromkeys(langs):
                raw = b"\n".join(t.encode().translate(BYTES) for x, t in zip(langs, texts) if x == lang).replace(b"\n", b" \n ")
                coded = pc.split_pattern(pa.array([raw.decode()], pa.large_string()), " ").values.dictionary_encode()
                state = open_.setdefault(lang, [{}, [], [], 0, 0])
                known = state[0]
                here = np.fromiter((-1 if w == "" else -2 if w == "\n" else known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                got = here[coded.indices.to_numpy()]
                got = got[got != -1]
                places = np.arange(len(got)) + state[3]
                word = got >= 0
                state[1].append(places[word])
                state[2].append(got[word])
                state[3] += len(got) + 1
                state[4] += int(word.sum())
                held += int(word.sum())
                while held >= size:
                    yield from close(max(open_, key=lambda x: open_[x][4]))
        for lang in list(open_):
            yield from close(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(build, ROWS)


def counted(states: DataFrame, length: int, seed: int) -> DataFrame:
    """chunk, key, n: the lists of ``length`` words of each chunk, by their lengths. Longer than one word, they grow from the frequent ones a word shorter."""
    schema = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = next(batch.slice(i, 1).to_pandas().itertuples(index=False))
                p = Postings.read(row, seed)
                at, key = p.heads(1) if length == 1 else p.extended(*p.lists(length - 1, np.frombuffer(row.keys, np.uint64)), length - 1)
                lists, sizes = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([np.full(len(lists), p.chunk), lists.view(np.int64), sizes], schema=schema)

    return states.select("chunk", "lang", "words", "places", "ids", "keys").mapInArrow(each, "chunk long, key long, n long")


def _kept(row, frequent: np.ndarray, spellers: np.ndarray | None, length: int, seed: int) -> list[pa.RecordBatch]:
    """``ROWS`` of a chunk's state without what no frequent phrase of ``length`` words covers, and the strings of those that it is to spell (null: all)."""
    p = Postings.read(row, seed)
    at, key = p.lists(length, frequent)
    if not len(at):
        return []
    named, phrases = p.strings(at, key, length)
    covered = np.zeros(len(p.places), bool)
    for k in range(length):
        covered[at + k] = True
    out = p.state(np.flatnonzero(covered), named)
    if spellers is not None:
        mine = spellers[np.searchsorted(frequent, named)] == p.chunk
        named, phrases = named[mine], [x for x, m in zip(phrases, mine) if m]
    return [_table(chunk=np.full(len(named), p.chunk), lang=[p.lang] * len(named), key=named.view(np.int64), phrase=phrases), out]


def pruned(states: DataFrame, frequent: DataFrame, length: int, seed: int, broadcast: bool) -> DataFrame:
    """``ROWS`` of the chunks' next states and of the strings of the frequent phrases (key, chunk) of ``length`` words; chunks without any are done.

    With ``broadcast`` keys and the chunks that spell them, sixteen bytes each, go to all tasks and the chunks stay where they are; otherwise each chunk is
    sent those that it holds, and spells them all.
    """
    held = states.select("chunk", "lang", "words", "places", "ids", "keys")
    if broadcast:
        rows = frequent.select("key", "chunk").toPandas()
        order = np.argsort(keys := rows["key"].to_numpy(np.int64).view(np.uint64))
        sent = states.sparkSession.sparkContext.broadcast((keys[order], rows["chunk"].to_numpy(np.int64)[order]))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _kept(next(batch.slice(i, 1).to_pandas().itertuples(index=False)), *sent.value, length, seed)

        return held.mapInArrow(each, ROWS)

    def keep(row: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if row.num_rows and asked.num_rows:
            out = _kept(next(row.to_pandas().itertuples(index=False)), np.sort(asked.column("asked").to_numpy().view(np.uint64)), None, length, seed)
        return pa.Table.from_batches(out, pa.schema(KINDS.items()))

    asked = counted(states, length, seed).join(frequent.select("key"), "key").select(F.col("chunk").alias("of"), F.col("key").alias("asked"))
    return held.groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(keep, ROWS)


def verify(states: DataFrame, spelt: DataFrame, length: int, seed: int) -> None:
    """An error if a chunk's frequent phrase of ``length`` words is another one than that spelt (key, lang, phrase) elsewhere for its key; both are broadcast as 64-bit numbers."""
    rows = spelt.select("key", F.xxhash64("phrase", "lang").alias("digest")).toPandas()
    order = np.argsort(keys := rows["key"].to_numpy(np.int64).view(np.uint64))
    sent = states.sparkSession.sparkContext.broadcast((keys[order], rows["digest"].to_numpy(np.int64)[order]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i in range(batch.num_rows):
                row = next(batch.slice(i, 1).to_pandas().itertuples(index=False))
                p = Postings.read(row, seed)
                named, phrases = p.strings(*p.lists(length, np.frombuffer(row.keys, np.uint64)), length)
                keys, digests = sent.value
                # as Spark: the hash of the first is the second's seed
                own = np.fromiter((xxhash.xxh64_intdigest(p.lang, xxhash.xxh64_intdigest(x, 42)) for x in phrases), np.uint64, len(phrases)).view(np.int64)
                if (digests[np.searchsorted(keys, named)] != own).any():
                    raise ValueError("two phrases share a hash: choose another seed")
                yield pa.RecordBatch.from_arrays([pa.array([len(named)], pa.int64())], names=["n"])

    states.select("chunk", "lang", "words", "places", "ids", "keys").mapInArrow(each, "n long").agg(F.sum("n")).collect()


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_words: int = CHUNK, seed: int = 0, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words seen ``least`` times or more, and (lang, n) of all languages."""
    spark = docs.sparkSession
    rows = scratch_table(chunks_of(docs, chunk_words, seed), "postings")
    totals = scratch_table(rows.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    kept, spelt = [], []
    for length in range(1, longest + 1):
        states = rows.filter("key is null")
        found = scratch_table(counted(states, length, seed).groupBy("key").agg(F.sum("n").alias("f"), F.min("chunk").alias("chunk")).filter(F.col("f") >= least), f"frequent{length}")
        settle(spark)
        kept.append(found.select("key", "f", F.lit(length).alias("words")))
        broadcast = found.count() <= most_broadcast
        after = scratch_table(pruned(states, found, length, seed, broadcast), "postings")
        drop_table(rows)
        rows = after
        # the same string from many chunks is one row; two strings are a hash met twice
        names = rows.filter("phrase is not null").groupBy("key").agg(F.min("lang").alias("lang"), F.max("lang").alias("_lang"), F.min("phrase").alias("phrase"), F.max("phrase").alias("_phrase"))
        one = F.when((F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), F.col("phrase")).otherwise(F.raise_error(F.lit("two phrases share a hash: choose another seed")))
        spelt.append(scratch_table(names.select("key", "lang", one.alias("phrase")), f"phrases{length}"))
        if broadcast:
            verify(rows.filter("key is null"), spelt[-1], length, seed)
    drop_table(rows)
    every = None
    for held, names in zip(kept, spelt):
        each = held.join(names, "key").select("lang", "words", "phrase", "f")
        every = each if every is None else every.unionByName(each)
    return every, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, chunk_words: int = CHUNK, seed: int = 0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases by score, frequency and string.

    Words are runs without blanks and tabs between ``. , ; : ! ?`` and line ends, A-Z lower-cased. A phrase is cut where its score floor(1000 a n / (l r)) is
    least, at the first such place. Phrases inside a longer one as frequent go. A null text is the empty one and has no words; a null language is
    ``und``. Repeated rows count each, ids and further columns are ignored. A very long text stays in one chunk, whose size it may
    exceed. No rows, or no frequent phrase, give no rows.
    """
    every, totals = mined(docs, least, longest, chunk_words, seed, most_broadcast)
    every = scratch_table(every, "phrases")
    phrases = every.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = phrases.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("rest"))
    part = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    whole = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # exact up to 38 digits: 1000 a n is below 10 ** 29 for corpora of 10 ** 13 words
    score = F.expr("cast(1000 as decimal(4,0)) * cast(cast(a as decimal(15,0)) * cast(n as decimal(15,0)) as decimal(34,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    lowest = whole.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # a longer phrase as frequent has parts one word shorter that are as frequent, so these alone need be looked at
    inner = F.explode(F.expr("array(slice(w, 1, words - 1), slice(w, 2, words - 1))"))
    inside = phrases.filter("words > 2").select("lang", inner.alias("w"), "a").select("lang", F.array_join("w", " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rest = lowest.join(inside, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a")
    rows = rest.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first the best of each part of a language, so that no more than PARTS times ``most`` rows of it meet
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents by language."""
    out = collocations(table(spark, sf_dir, "documents"))
    return out.withColumn("rank", F.col("rank").cast("long"))


def phrases_sql(least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> str:
    """The same in SQL, from all phrases of all lengths."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS words, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, longest + 1))
    return f"""WITH p AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
        t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
        c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
        k AS (SELECT *, array_to_string(w[1:k], ' ') AS lead, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
        s AS (SELECT k.lang, k.words, k.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lead JOIN f y ON y.lang = k.lang AND y.phrase = k.rest JOIN t ON t.lang = k.lang),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s) WHERE place = 1),
        d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.words > b.words AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) WHERE rank <= {most}"""
