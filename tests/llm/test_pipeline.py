import numpy as np

import corpus_pipeline


def test_stages_over_small_tables(spark, odd, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    texts[59] = texts[0] + " end"
    texts[58] += " password=b7db7aa4a5fcc78305"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = docs
    left = []
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, str(tmp_path))
        if name != "packing":
            assert held.dtypes == docs.dtypes
            left.append({r.doc_id: r.text for r in held.collect()})
    assert len(left[0]) == 60 and left[1].keys() == set(range(59)) and "<SECRET>" in left[2][58]
    assert set(left[3].items()) <= set(left[2].items()) and left[3]
    pieces = __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == left[3].keys()
    for stage in (s for _, s in corpus_pipeline.STAGES):
        stage(spark, odd, str(tmp_path)).collect()
        stage(spark, odd.limit(0), str(tmp_path)).collect()
