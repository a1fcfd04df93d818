import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tokens string, fp long, digest string, key string, grade int, clean string, tail_probability double"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns of clashing names."""
    texts = [(1, "Write to a.b@mail.example.com or +1 (555) 123-4567 now"), (1, "Write to a.b@mail.example.com or +1 (555) 123-4567 now"), (2, None), (None, "no id here"), (3, ""), (4, " \t\n "), (5, "Ünï ćode    text\x00 end"), (6, "word " * 30_000), (7, "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" x"), (1, "another text of one id"), (-8, "😀 😀 😀")]
    rows = [(i, t, None if i == 2 else "en", None if i == 4 else "src", None, "r", "t", 1, "d", "k", 9, "c", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
