"""Leaks and look-alikes written by hand; none of them is made by the templates that train the forest."""

import pytest

from strandline.llm import secrets

LEAKS = {
    'api_key = "Zx9k,kk88Ppq2Lm0Qw"': 'api_key = "<SECRET>"',
    "secret: p@ss;w0rdLong99": "secret: <SECRET>",
    "password=hunt,er2dragonfly99": "password=<SECRET>",
    "PASSWORD: Zx9<kk88Ppq": "PASSWORD: <SECRET>",
    'password="correct horse battery staple"': 'password="<SECRET>"',
    "the password is hunter2Dragon": "the password is <SECRET>",
    "https://user:s3cretPassw0rd@db.example.com/x": "https://user:<SECRET>@db.example.com/x",
    "Log in with password: Sommer2023!, then wait.": "Log in with password: <SECRET>!, then wait.",
    "pwd=q7T": "pwd=<SECRET>",
    "{'token': 'mF9.B5f-4.1JqM'}": "{'token': '<SECRET>'}",
    'secret_key => "9drTJvcXLB89EDLAj9CB"': 'secret_key => "<SECRET>"',
    "redis://default:kLm29xQz81@cache:6379/0": "redis://default:<SECRET>@cache:6379/0",
    "export API_KEY=7f3a9c21e8": "export API_KEY=<SECRET>",
    "the passphrase is: violet-umbrella-cactus-9": "the passphrase is: <SECRET>",
}
CLEAN = [
    "the password is required", "The secret is that nobody knew.", "password: must be at least twelve characters long", 'placeholder password="Please choose a password"', "token = null", "the secret is not in the sauce",
    "password=${DB_PASSWORD}", "commit 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae", "see https://example.com:8080/path and mail a.b@example.com", "secret: the recipe of the family", "The token is sent to the server", "password = None",
    "pass: True", "order 4041894974608795 shipped", "api_key: string", "uuid: 123e4567-e89b-12d3-a456-426614174000", 'password: ""', "The secret: patience.",
]


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_leaks_go_and_look_alikes_stay(spark, forest):
    texts = [*LEAKS, *CLEAN]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(spark, docs, model=forest).collect()}
    left = [t for i, t in enumerate(texts) if t in LEAKS and got[i] != LEAKS[t]]
    marred = [(t, got[i]) for i, t in enumerate(texts) if t not in LEAKS and got[i] != t]
    assert not left and not marred, (left, marred)


def test_values_as_they_are_read(spark):
    hits = ['password="a \\" b" c', "password='' x", "token: 'ab", "pwd=!!!", "secret is x.", 'key ://u:p@q@h', "password==x", "pass:: y", 'PASSWORD="x" or "y"']
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(hits)], "doc_id long, text string")
    got = {r.doc_id: (r.token, r.before) for r in secrets._occurrences(secrets._cut(docs), "doc_id").collect()}
    assert got == {0: ('a \\" b', 'password="'), 2: ("ab", "token: '"), 3: ("!!!", "pwd="), 4: ("x", "secret is "), 5: ("p@q", "key ://u:"), 6: ("x", "password=="), 7: ("y", "pass:: "), 8: ("x", 'PASSWORD="')}


def test_long_runs_cost_their_length(spark, forest):
    import time

    texts = ["password=" + "," * 200_000 + "x", "password=\"" * 20_000, "token: '" + "a" * 300_000, "://" * 50_000, "://a:" * 50_000, "secret is " * 20_000, "pass" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begin = time.time()
    secrets.redact(spark, docs, model=forest).collect()
    assert time.time() - begin < 60


def test_labelled_findings_are_planned_once(spark):
    found = secrets.labelled_findings(spark, 10)
    plan = secrets.features(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Generate" not in plan and "Union" not in plan


def test_labelled_findings_lie_alike_on_any_cluster(spark):
    at = lambda: [tuple(r) for r in secrets.labelled_findings(spark, 10).collect()]
    first, names = at(), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "2000")
    try:
        assert secrets.labelled_findings(spark, 10).rdd.getNumPartitions() == 1 and at() == first and len(first) > 300
    finally:
        for n, x in zip(names, kept):
            spark.conf.set(n, x)
