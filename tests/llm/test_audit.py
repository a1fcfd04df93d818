import random
import re
from itertools import permutations

from strandline.llm import audit as A

SCHEMA = "doc_id long, text string, source string, part string, mask long, digest string, good int, n long"


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]


def by_hand(docs, labels):
    """Every document through every order."""
    masks, out = [], {}
    for i, text, part in docs:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        flags = [(q, t) for j, q, t in labels if j is not None and j == i]
        masks.append((part or "", [*fails(text), copy], any(q == 1 for q, _ in flags), any(t == 1 for _, t in flags)))
    for part in {m[0] for m in masks}:
        mine, shares = [m for m in masks if m[0] == part], [0] * 5
        for order in permutations(range(5)):
            for k, i in enumerate(order):
                gone = [m for m in mine if m[1][i] and not any(m[1][j] for j in order[:k])]
                early = [m for m in mine if m[1][i] and any(m[1][j] for j in order[:k])]
                kept = [m for m in mine if not any(m[1][j] for j in order[: k + 1])]
                shares[i] += len(gone)
                key = part, "".join("ABCDE"[j] for j in order), k + 1
                out[key] = [len(kept), len(gone), len(early), sum(m[1][i] and sum(m[1]) == 1 for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), i]
        for key in out:
            if key[0] == part:
                out[key][-1] = shares[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_equals_document_by_document(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(words[: rng.choice([60, 300])], k=rng.choice([50, 210, 260])))
        text = text.upper() if rng.random() < 0.3 else text
        text += rng.choice(["", "", " 5%", "\x0b\x0c x\x1cy", "\té "])
        docs.append((i, text, rng.choice(["a", "b"])))
    docs += [(100 + i, docs[i % 5][1], "a" if i % 2 else "c") for i in range(12)]
    docs += [(7, docs[7][1], "a"), (7, docs[7][1], "b"), (None, docs[0][1], "a"), (None, docs[0][1], None), (200, None, None), (201, "", "a"), (202, " \n", None), (3, "x" * 200_000, "b"), (2**60 + 1, docs[1][1], "a"), (2**60 + 3, "once", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 110, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (2**60 + 1, 1, 1)]
    rows = spark.createDataFrame([(i, t, s, "p", 1, "d", 1, 1) for i, t, s in docs], SCHEMA)
    got = A.audit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = by_hand(docs, labels)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in docs})


def test_no_rows_and_no_labels(spark):
    rows = spark.createDataFrame([(1, "a", "s", "p", 1, "d", 1, 1)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(rows.limit(0), labels).count() == 0
    got = A.audit(rows, labels).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.shapley, r.good_lost) for r in got] == [(0, 1, 120, 0)] + [(0, 0, 0, 0)] * 4
    assert dict(A.audit(rows, labels).dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
