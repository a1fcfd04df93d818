"""Filter interaction audit: what each filter removes in every order of the filters, from counts of failure masks alone.

A document is the set of filters that it fails (a mask). Per part, the documents that a set of filters removes are the corner values
of a polynomial in one variable a filter, f(x) = sum over masks of n(mask) (1 - prod over the mask of (1 - x_i)), whose coefficients follow
from the mask counts by inclusion and exclusion. A filter's Shapley share is the integral of its partial derivative along the
diagonal: a coefficient of a set T adds 1 / |T| to each of its filters. Scaled by the number of orders, 120, these are whole numbers.

Texts are read once and never shuffled: a row of an id, a part, a mask and a digest goes on. Equal rows are summed up before
each shuffle, so that a group of copies, however large, is a few rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import table

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
ORDERS = factorial(len(FILTERS))


def _bits(members) -> int:
    return sum(1 << i for i in members)


def failures(text: Column) -> list[Column]:
    """Whether a text fails filters A to D: too few words, too repetitive, too many capitals, marks. The empty text fails A alone."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the filters that they fail, all and those of either label.

    Filter E fails a document if a smaller id has the same text anywhere in the table; a null id is neither smaller nor larger than any.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(text))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.sha2(text, 256).alias("digest"))
    same = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    # null ids have no label; they get keys that meet none, spread by digest
    keyed = same.withColumn("id", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("none", F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    labelled = keyed.join(flags.withColumn("none", F.lit(0)), ["id", "none"], "left").na.fill(0, ["good", "toxic"])
    # an id stands once in each of these groups, since its row is one and its labels are its own
    groups = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("idless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # of a text: a row for each part and label at most
    passing = F.col("idless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("least", least).withColumn("passing", passing)
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("x")
    each = split.select("part", "good", "toxic", both).select("part", "good", "toxic", "x.mask", "x.n")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def polynomials(counts: DataFrame) -> DataFrame:
    """part, total, and for each of n, good, toxic the array of the removal polynomial's coefficients by set of filters.

    The coefficient of a set T is the sum over masks that hold T of their counts, negative for sets of an even size.
    """
    sums = [F.sum("n").alias("total")]
    for what in ("n", "good", "toxic"):
        terms = [F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(t)) == t, F.col(what))), F.lit(0)) * (1 if bin(t).count("1") % 2 else -1) if t else F.lit(0).cast("long") for t in range(FULL + 1)]
        sums.append(F.array(*terms).alias(what))
    return counts.groupBy("part").agg(*sums)


def corner(coefficients: str, members: int) -> Column:
    """Value of a polynomial where the filters of ``members`` are 1 and the others 0: the documents that these remove."""
    return sum((F.col(coefficients)[t] for t in range(1, FULL + 1) if t & members == t), F.lit(0).cast("long"))


def shapley(coefficients: str, i: int) -> Column:
    """A filter's Shapley share times the number of orders: the derivative's terms t^(|T| - 1) integrate to 1 / |T|."""
    terms = []
    for t in range(1, FULL + 1):
        if t >> i & 1:
            weight = Fraction(1, bin(t).count("1")) * ORDERS
            assert weight.denominator == 1
            terms.append(F.col(coefficients)[t] * weight.numerator)
    return sum(terms[1:], terms[0])


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    A null text is the empty one and a null part the empty string. Repeated rows count each; those of one id and text are no copies of each other. Null
    ids have no label. A document of several label rows is good or toxic if one of them says so. Very long texts stay in their row;
    further columns are ignored; an empty table gives no rows.
    """
    rows = polynomials(mask_counts(docs, labels, part))
    corners = rows.select("part", "total", *[F.array(*[corner(w, s) for s in range(FULL + 1)]).alias(w) for w in ("n", "good", "toxic")], F.array(*[shapley("n", i) for i in range(len(FILTERS))]).alias("shares"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        for k, i in enumerate(order):
            before = _bits(order[:k])
            steps.append((("".join(FILTERS[j] for j in order)), k + 1, i, before, before | 1 << i))
    fields = {"o": "filter_order", "s": "step", "i": "i", "b": "before", "a": "after"}
    plan = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"i":{i},"b":{b},"a":{a}}}' for o, s, i, b, a in steps) + "]"), "array<struct<o:string,s:int,i:int,b:int,a:int>>")
    each = corners.select("*", F.explode(plan).alias("x")).select("part", "total", "n", "good", "toxic", "shares", *[F.col(f"x.{short}").alias(name) for short, name in fields.items()])
    gain = lambda w: F.expr(f"{w}[after] - {w}[before]")
    removed = gain("n")
    return each.select(
        "part", "filter_order", "step", (F.col("total") - F.expr("n[after]")).alias("kept"), removed.alias("removed"), (F.expr("n[shiftleft(1, i)]") - removed).alias("redundant"),
        F.expr(f"n[{FULL}] - n[{FULL} - shiftleft(1, i)]").alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), F.expr("shares[i]").alias("shapley"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def audit_sql() -> str:
    """The same in SQL, document by document through every order."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    fails = ["len(w) < 200", "100 * len(list_distinct(w)) < 50 * len(w)", "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)"]
    mask = " + ".join(f"({c})::INT * {1 << i}" for i, c in enumerate(fails))
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    # the first failing filter of an order removes a document
    first = "list_min(list_filter([strpos(o, f) for f in string_split('ABCDE', '')], lambda p: (mask >> strpos('ABCDE', substr(o, CAST(p AS INT), 1))::INT - 1) & 1 = 1))"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, t, {words} AS w FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, {mask} AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
        g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL), o AS (SELECT * FROM (VALUES {orders}) AS x(o)),
        r AS (SELECT part, o, mask, n, n * good AS good, n * toxic AS toxic, {first} AS gone FROM g, o),
        s AS (SELECT part, o, k, 1 << strpos('ABCDE', substr(o, k::INT, 1))::INT - 1 AS bit, mask, n, good, toxic, gone FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        a AS (SELECT part, o, k, bit, sum(CASE WHEN gone IS NULL OR gone > k THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = k THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND gone < k THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone = k THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = k THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
        SELECT part, o AS filter_order, k::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
        (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM a"""
