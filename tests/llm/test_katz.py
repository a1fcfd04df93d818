import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from strandline.llm import katz


def d_of(times):
    n = [0, *times]
    rest = 6 * n[6] / n[1] if n[1] else 1.0
    out = {0: 1.0}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Brute:
    """The same model from plain counts."""

    def __init__(self, docs):
        self.words = lambda t: [w.decode() for w in t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()] + [None]
        self.c, self.pairs = Counter(), defaultdict(Counter)
        for doc, text in docs:
            if not self.held(doc):
                history = "<s>"
                for w in self.words(text):
                    self.c[w] += 1
                    self.pairs[history][w] += 1
                    history = w
        self.n, self.v = sum(self.c.values()), len(self.c)
        times = lambda counts: [sum(x == r for x in counts) for r in range(1, 7)]
        self.d1 = d_of(times(list(self.c.values())))
        self.d2 = d_of(times([x for p in self.pairs.values() for x in p.values()]))
        seen = sum(self.d1.get(x, 1.0) * x for x in self.c.values())
        self.scale = 1 / (self.n + 1) if self.n and seen >= self.n else 1 / max(self.n, 1)
        self.unseen = 1 - seen * self.scale

    @staticmethod
    def held(doc):
        return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0

    def p1(self, w):
        return self.d1.get(self.c[w], 1.0) * self.c[w] * self.scale if self.c[w] else self.unseen

    def p2(self, h, w):
        row = self.pairs.get(h)
        if not row:
            return self.p1(w)
        total = sum(row.values())
        kept = sum(self.d2.get(x, 1.0) * x for x in row.values())
        below = total + (kept >= total)
        if row[w]:
            return self.d2.get(row[w], 1.0) * row[w] / below
        return (1 - kept / below) / (1 - sum(self.p1(x) for x in row if row[x])) * self.p1(w)

    def score(self, text):
        history, total, base, known = "<s>", 0.0, 0.0, 0
        tokens = self.words(text)
        for w in tokens:
            p = self.p2(history, w)
            total += math.log10(p) if p > 0 else -math.inf
            base += math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1)))
            known += self.c[w] > 0
            history = w
        return len(tokens), known, base, total


def corpus():
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(60)])
    weights = 1 / np.arange(1, 61)
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum())).replace("w1 ", "W1\t ")) for i in range(120)]


def test_scores_by_brute_force(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    brute = Brute(docs)
    for h in ["<s>", "w0", "w59", "never"]:  # exactly normalised, with all unseen words as one
        assert abs(sum(brute.p2(h, w) for w in [*brute.c, "never seen"]) - 1) < 1e-9
    for sizes in ((10**6, 10**6, 10**6), (200, 150, 100)):  # one chunk and bucket; many, with frequent histories spread
        rows = {r.doc_id: r for r in katz.score(table, *sizes).collect()}
        assert len(rows) == len(docs)
        for i, text in docs:
            n, known, base, total = brute.score(text)
            r = rows[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held(i), n, known, brute.n)
            assert abs(r.base_score - base) < 1e-6 and abs(r.score - total) < 1e-6
    unseen = [r for r in rows.values() if r.held_out]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen) * 1.2


def test_odd_rows(spark, odd, none):
    assert katz.score(none).count() == 0
    rows = katz.score(odd, 50, 50, 20).collect()
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    brute = Brute(docs)
    want = sorted((str(i), *brute.score(t)[:2], round(brute.score(t)[3], 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in rows) == want
    only = spark.createDataFrame([(None, "held out")], "doc_id long, text string")
    assert katz.score(only).first().train_tokens == 0


def test_discounts():
    assert katz.discounts([0] * 6).tolist() == [1.0, *((r - 0.5) / r for r in range(1, 6))]
    assert np.allclose(katz.discounts([1000, 300, 150, 90, 60, 43]), list(d_of([1000, 300, 150, 90, 60, 43]).values()))


def test_a_chunk_needs_little_memory(spark):
    import tracemalloc

    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.zipf(1.3, 300_000) % 50_000)
    docs = spark.createDataFrame([(1, text), (3, text[:1000])], "doc_id long, text string")
    row = katz.chunks_of(docs.coalesce(1), 10**7).first()
    tracemalloc.start()
    chunk = katz.Chunk(row)
    chunk.pairs(np.ones(len(chunk.words), np.int64), 1, 10**9)
    peak = tracemalloc.get_traced_memory()[1] / row.n_tokens
    tracemalloc.stop()
    assert peak < 50, peak  # bytes a token
    assert (np.unique(chunk.inverse) == np.arange(len(chunk.history))).all()
    assert (chunk.word[chunk.inverse] == chunk.tokens).all() and (chunk.history[chunk.inverse][1:300_000] == chunk.tokens[:299_999]).all()


def test_answers_hold_counts_packed(spark):
    table = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(1)
    chunks = katz.chunks_of(table, 10**6)
    words = katz.ask_words(chunks, 1)
    pairs = katz.ask_pairs(chunks, words, katz.Unigrams(katz._stats(words)), 1, 10**6)
    row = pairs.filter("chunk >= 0").first()
    assert sum(len(x) for x in row.asDict().values() if isinstance(x, (bytes, bytearray))) < 2000, row  # 62 histories and some 1500 pairs
