import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.llm import katz, katz_tables
from tests.llm.test_katz import Brute, corpus, d_of

TRAIN = [(i, t) for i, t in corpus() if not Brute.held(i)]


class Plain:
    """A Katz model of any order from plain counts, evaluated recursively."""

    def __init__(self, texts, order):
        self.order, self.one = order, Brute([])
        self.rows = [defaultdict(Counter) for _ in range(order + 1)]  # by history, nearest word last
        for text in texts:
            said = ["<s>"] * (order - 1) + self.one.words(text)
            for i in range(order - 1, len(said)):
                for n in range(1, order + 1):
                    self.rows[n][tuple(said[i - n + 1 : i])][said[i]] += 1
        self.d = [None] + [d_of([sum(x == r for p in self.rows[n].values() for x in p.values()) for r in range(1, 7)]) for n in range(1, order + 1)]
        words = self.rows[1][()]
        self.total = sum(words.values())
        kept = sum(self.d[1].get(x, 1.0) * x for x in words.values())
        self.scale = 1 / (self.total + 1) if self.total and kept >= self.total else 1 / max(self.total, 1)
        self.unseen = 1 - kept * self.scale

    def p(self, history, w):
        n = len(history) + 1
        row, d = self.rows[n].get(history, {}), self.d[n]
        if n == 1:
            return d.get(row[w], 1.0) * row[w] * self.scale if row.get(w) else self.unseen
        if not row:
            return self.p(history[1:], w)
        total, kept = sum(row.values()), sum(d.get(x, 1.0) * x for x in row.values())
        below = total + (kept >= total)
        if row.get(w):
            return d.get(row[w], 1.0) * row[w] / below
        return (1 - kept / below) / (1 - sum(self.p(history[1:], x) for x in row)) * self.p(history[1:], w)

    def score(self, text):
        said = ["<s>"] * (self.order - 1) + self.one.words(text)
        return sum(math.log10(self.p(tuple(said[i - self.order + 1 : i]), said[i])) for i in range(self.order - 1, len(said)))


def test_another_corpus_at_order_three_by_brute_force(spark, tmp_path):
    path = str(tmp_path / "model")
    katz_tables.train(spark.createDataFrame(TRAIN, "doc_id long, text string").repartition(3), path, 3, 4)
    plain = Plain([t for _, t in TRAIN], 3)
    other = [(i, t) for i, t in corpus() if Brute.held(i)] + [(500, "W0 w1 w2 never w2 w3"), (501, None), (501, None), (502, "w1 " * 3000)]
    rows = katz_tables.evaluate(spark.createDataFrame(other, "doc_id long, text string"), path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, len(plain.one.words(t or ""))) for i, t in other)
    want = {i: plain.score(t or "") for i, t in other}
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in rows)


def test_probabilities_after_a_history_sum_to_one(spark, tmp_path):
    path = str(tmp_path / "model")
    katz_tables.train(spark.createDataFrame(TRAIN, "doc_id long, text string"), path, 3, 4)
    words = spark.read.parquet(f"{path}/probs-1").select("word")  # the empty one is any unseen word
    histories = spark.createDataFrame([("w0", "w1"), (" ", " "), ("w3", "never"), ("never", "w3")], "b1 string, b2 string")
    sums = katz_tables.probabilities(words.join(F.broadcast(histories)), path).groupBy("b1", "b2").agg(F.sum("p").alias("p")).collect()
    assert len(sums) == 4 and all(abs(r.p - 1) < 1e-9 for r in sums)


def test_agrees_with_the_packed_form_at_order_two(spark, tmp_path):
    path = str(tmp_path / "model")
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    katz_tables.train(spark.createDataFrame(TRAIN, "doc_id long, text string"), path, 2, 4)
    packed = {r.doc_id: r.score for r in katz.score(docs).collect()}
    rows = katz_tables.evaluate(docs, path, 2).collect()
    assert len(rows) == len(packed) and all(abs(r.score - packed[r.doc_id]) < 1e-6 for r in rows)


def test_odd_rows(spark, odd, none, tmp_path):
    path, empty = str(tmp_path / "model"), str(tmp_path / "none")
    katz_tables.train(odd, path)
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    plain = Plain([t for _, t in texts], 3)
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 5)) for r in katz_tables.evaluate(odd, path).collect())
    assert got == sorted((str(i), len(plain.one.words(t)), round(plain.score(t), 5)) for i, t in texts)
    assert katz_tables.evaluate(none, path).count() == 0
    katz_tables.train(none, empty)
    assert katz_tables.evaluate(odd, empty).filter("score = 0").count() == len(texts)
