import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, words string, phrase string, n long, key long"


def by_hand(docs, least, longest, most):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = {}
    for (lang, w), a in cand.items():
        inside = any(l2 == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (l2, v), b in cand.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most]))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, x, "w", "p", 1, 2) for i, (x, t) in enumerate(docs)], SCHEMA)


@pytest.mark.parametrize("chunk, most, broadcast", [(2_000_000, 2000, 10), (200, 2000, 0), (200, 5, 1000)])
def test_equals_counting_all_phrases(spark, chunk, most, broadcast):
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "new", "york", "city", "hall", "a", "é", "x-y", "ha"]
    docs = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + [", ", ".\n", "  ", "\t", "\r\n", "\x0b", "!?"]) for _ in range(rng.randint(1, 120)))) for _ in range(60)]
    docs += [("en", "new york city hall of the new york " * 5)] * 4 + [("en", "ha " * 300), ("en", None), ("de", ""), ("de", " .,;\n"), (None, "und"), ("und", "new york new york"), ("en", "\x1c \u2028 \u2028 \x1c")]
    got = P.collocations(frame(spark, docs).repartition(3), least=8, most=most, chunk_words=chunk, most_broadcast=broadcast).collect()
    want = by_hand(docs, 8, 5, most)
    assert sorted(map(tuple, got)) == want and len(want) > 8


def test_nothing_frequent_and_no_rows(spark):
    rows = frame(spark, [("en", "one two three"), ("de", None)])
    assert P.collocations(rows).count() == 0
    assert P.collocations(rows.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    f = {("a",): 3 * 10**12, ("b",): 5 * 10**12, ("a", "b"): 2 * 10**12}
    every = spark.createDataFrame([("en", len(w), " ".join(w), n) for w, n in f.items()], "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10**13 + 7)], "lang string, n long")
    monkeypatch.setattr(P, "mined", lambda *a: (every, totals))
    got = P.collocations(every).first()
    assert got.score == 1000 * (2 * 10**12) * (9 * 10**13 + 7) // (15 * 10**24) and (got.l, got.r) == (3 * 10**12, 5 * 10**12)


def test_a_hash_met_twice_is_an_error():
    p = P.Postings(1, "en", ["a", "b", "c"], np.array([0, 1, 5, 6]), np.array([0, 1, 0, 2]), 0)
    p.hashes[2] = p.hashes[1]
    at, key = p.extended(*p.heads(1), 1)
    with pytest.raises(ValueError, match="another seed"):
        p.strings(at, key, 2)
    assert len(set(key)) == 1 and list(at) == [0, 2]


def test_another_spelling_elsewhere_is_an_error(spark):
    states = P.chunks_of(frame(spark, [("en", "a b a b")]), 100, 0)
    named = P.pruned(states, P.counted(states, 1, 0).groupBy("key").agg({"chunk": "min"}).withColumnRenamed("min(chunk)", "chunk"), 1, 0, True)
    spelt = named.filter("phrase is not null").select("key", "lang", "phrase")
    assert sorted(r.phrase for r in spelt.collect()) == ["a", "b"]
    P.verify(named.filter("key is null"), spelt, 1, 0)
    with pytest.raises(Exception, match="another seed"):
        P.verify(named.filter("key is null"), spelt.replace("a", "c", "phrase"), 1, 0)
