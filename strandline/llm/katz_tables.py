"""A Katz model of any order as stored tables, for scoring texts that it was not trained on.

The discounts and the treatment of unseen words are those of ``katz``, whose packed form scores a corpus by its own
pairs. Here an n-gram is a row: its words back from the last (``b1`` is the word before, ``b2`` the one before that) and its
probability; a history is a row with its backoff weight. Tables of each order lie in a folder of their own, partitioned by a
hash of the history.

    P(w | b2 b1) = the table's, if the n-gram was seen, else weight(b2 b1) P(w | b1), and so on down to words.

A seen n-gram's shorter forms were all seen, so training needs no recursion: weights come from joins with the order below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import scratch_table, text_or_empty
from strandline.llm.katz import LAST, Unigrams, discounts

#: What precedes a text and what ends it; a word holds no blank.
START, END = " ", "\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _back(order: int) -> list[str]:
    """Columns of an n-gram's history."""
    return [f"b{i}" for i in range(1, order)]


def tokens(rows: DataFrame, order: int) -> DataFrame:
    """The other columns of ``rows`` with b1, b2, ... and word of every token of ``text``, in time linear in the text."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("word", F.concat(words, F.array(F.lit(END))))
    zipped = [F.slice(F.concat(F.array_repeat(F.lit(START), i), "word"), F.lit(1), F.size("word")).alias(f"b{i}") for i in range(1, order)]
    kept = [c for c in rows.columns if c not in ("text", "word")]
    return rows.select(*kept, *zipped, "word").select(*kept, F.inline(F.arrays_zip(*_back(order), "word")))


def _stats(counts: DataFrame) -> list[int]:
    """Kinds, tokens, and how many kinds were seen 1, 2, ... LAST + 1 times."""
    row = counts.agg(F.count(F.lit(1)), F.sum("c"), *[F.count_if(F.col("c") == r) for r in range(1, LAST + 2)]).first()
    return [int(x or 0) for x in row]


def _discounted(d: list[float]) -> Column:
    kept = F.coalesce(*[F.when(F.col("c") == r, d[r] * r) for r in range(1, LAST + 1)], F.col("c"))
    return kept.cast("double")


def _store(rows: DataFrame, path: str, history: list[str], buckets: int) -> DataFrame:
    """Written by bucket of the history; a frequent history's words are spread over tasks."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(0), *history), F.lit(buckets)).cast("int"))
    spread = [F.pmod(F.xxhash64("word"), F.lit(16))] if "word" in rows.columns else []
    rows.repartition("bucket", *spread).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).drop("bucket")


def train(docs: DataFrame, path: str, order: int = 3, buckets: int = 16) -> None:
    """Write the tables of a model of all texts of ``docs`` to the new folder ``path``.

    ``probs-n`` holds b1, ... b(n-1), word, p; ``weights-n`` holds b1, ... b(n-1), weight. The empty word of ``probs-1`` is
    what all words not seen in training share. Null and empty texts are an end alone; repeated rows count each; other columns are
    ignored; without rows the tables are empty but for that word, whose p is 1.
    """
    spark = docs.sparkSession
    grams = tokens(text_or_empty(docs).select("text"), order)
    counts = {order: scratch_table(grams.groupBy(*_back(order), "word").agg(F.count(F.lit(1)).alias("c")), f"grams-{order}")}
    for n in range(order - 1, 0, -1):
        counts[n] = scratch_table(counts[n + 1].groupBy(*_back(n), "word").agg(F.sum("c").alias("c")), f"grams-{n}")
    unigrams = Unigrams(_stats(counts[1]))
    words = counts[1].select("word", (_discounted(unigrams.d.tolist()) * unigrams.scale).alias("p"))
    unseen = spark.createDataFrame([("", float(unigrams.unseen))], "word string, p double")
    lower = _store(words.unionByName(unseen), f"{path}/probs-1", [], buckets)
    for n in range(2, order + 1):
        history, kept = _back(n), _discounted(discounts(_stats(counts[n])[2:]).tolist())
        known = counts[n].join(lower, [*_back(n - 1), "word"])
        sums = known.groupBy(*history).agg(F.sum("c").alias("seen"), F.sum(kept).alias("kept"), F.sum("p").alias("covered"))
        # a history without discounted n-grams leaves the mass of one more token
        sums = scratch_table(sums.withColumn("total", F.col("seen") + (F.col("kept") >= F.col("seen")).cast("long")), f"histories-{n}")
        weight = (1 - F.col("kept") / F.col("total")) / F.greatest(1 - F.col("covered"), F.lit(1e-12))
        _store(sums.select(*history, weight.alias("weight")), f"{path}/weights-{n}", history, buckets)
        found = counts[n].join(sums.select(*history, "total"), history)
        lower = _store(found.select(*history, "word", (kept / F.col("total")).alias("p")), f"{path}/probs-{n}", history, buckets)


def _read(spark: SparkSession, path: str, name: str, n: int) -> DataFrame:
    value = "word string, p double" if name == "probs" else "weight double"
    schema = ", ".join([*(f"{b} string" for b in _back(n)), value])
    return spark.read.schema(schema).parquet(f"{path}/{name}-{n}")


def probabilities(grams: DataFrame, path: str, order: int = 3) -> DataFrame:
    """``grams`` (b1, ... and word; distinct) with p: the model's probability of the word after its history."""
    spark = grams.sparkSession
    ones = _read(spark, path, "probs", 1)
    unseen = ones.filter("word = ''").first()["p"]
    rows = grams.join(ones, "word", "left").withColumn("p", F.coalesce("p", F.lit(unseen)))
    for n in range(2, order + 1):
        found = _read(spark, path, "probs", n).withColumnRenamed("p", "seen")
        rows = rows.join(found, [*_back(n), "word"], "left").join(_read(spark, path, "weights", n), _back(n), "left")
        rows = rows.withColumn("p", F.coalesce("seen", F.coalesce("weight", F.lit(1.0)) * F.col("p"))).drop("seen", "weight")
    return rows


def evaluate(docs: DataFrame, path: str, order: int = 3) -> DataFrame:
    """doc_id, n_tokens, score (log10 probability) of every row of ``docs`` by the model stored in ``path``.

    ``order`` may be less than the model's. Equal texts are scored once; repeated rows and ids are rows of their own. An n-gram
    is looked up once, however often it occurs. Null and empty texts are an end alone; no rows give no rows.
    """
    rows = text_or_empty(docs).withColumn("key", F.sha2("text", 256))
    said = tokens(rows.select("key", "text").dropDuplicates(["key"]), order)
    columns = [*_back(order), "word"]
    said = scratch_table(said.groupBy("key", *columns).agg(F.count(F.lit(1)).alias("times")), "said")
    known = probabilities(said.select(*columns).distinct(), path, order)
    logs = said.join(known, columns)
    scores = logs.groupBy("key").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log10("p")).alias("score"))
    return rows.select("doc_id", "key").join(scores, "key").select("doc_id", "n_tokens", "score")
