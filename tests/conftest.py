import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "2", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """A folder with small documents and benchmark tables; some texts share passages, some repeat."""
    import random

    import pandas as pd

    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    shared = prose(60)
    texts = [prose(rng.randint(1, 70)) + ("\n" + shared if i % 4 == 0 else "") for i in range(14)]
    texts += [texts[0], "Short", "", "ha " * 60]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": ["en", "de", "fr"] * 6, "source": "s", "n_chars": [len(t) for t in texts]})
    out = tmp_path_factory.mktemp("small")
    docs.to_parquet(out / "documents.parquet")
    pd.DataFrame({"item_id": range(4), "text": [shared, texts[1], prose(30), "x"]}).to_parquet(out / "benchmark.parquet")
    return str(out)
