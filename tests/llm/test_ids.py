"""Ids that no double holds, beside null ids, through every query."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.llm.queries import QUERIES

IDS = [2**60 + 1, 2**60 + 3, -(2**60) - 1, None, 2**53 + 1, 2**60 + 50, None, 5]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("ids")
    texts = [f"text number {i} of its own, write to a{i}@mail.example.com" + " and more words" * i for i in range(len(IDS))]
    docs = pa.table({"doc_id": pa.array(IDS, pa.int64()), "text": texts, "lang": ["en"] * len(IDS), "source": ["s"] * len(IDS), "n_chars": pa.array(map(len, texts), pa.int64())})
    pq.write_table(docs, out / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(IDS, pa.int64()), "quality": pa.array([1, 0] * 4, pa.int64()), "toxic": pa.array([0] * 7 + [1], pa.int64())}), out / "labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array(IDS, pa.int64()), "url": ["http://a.org/"] * len(IDS), "html": [""] * len(IDS)}), out / "pages.parquet")
    return str(out)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op1_nearest", "op12_phrases", "op13_audit")])
def test_ids_come_back(spark, folder, name):
    id_ = "page_id" if name == "op11_urls" else "doc_id"
    got = [r[0] for r in QUERIES[name](spark, folder).select(id_).collect()]
    if name == "op10_secrets":  # a row for each secret
        assert set(got) <= set(IDS)
    elif name == "op3_packing":
        assert set(got) == set(IDS)
    else:
        assert sorted(map(str, got)) == sorted(map(str, IDS))


def test_vectors(spark, tmp_path):
    ids = [2**60 + 50 - (2**60 + 50) % 50 + k for k in range(6)]
    rows = pa.table({"vec_id": pa.array([*ids, None], pa.int64()), "embedding": pa.array([[1.0, k] for k in range(7)], pa.list_(pa.float32())), "label": pa.array([0] * 7, pa.int32())})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    got = QUERIES["op1_nearest"](spark, str(tmp_path)).toPandas()
    assert set(got.query_id) == {ids[0]} and set(pd.array(got.vec_id, "Int64").dropna()) <= set(ids[1:]) and ids[1] in set(got.vec_id)
