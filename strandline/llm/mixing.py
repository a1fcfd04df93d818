"""Mixing sources to target weights by iterative proportional fitting (raking), with DataFrame functions only.

Token counts are summed per cell of (source, language, topic). The cells' weights are raked to the three target
marginals in turn; a document's sampling probability is its cell's weight over its tokens, scaled so that the
largest is 1. Sampling by a hash of the doc_id then meets the marginals in expectation, and again on every run. With a
tolerance, more is kept: the scale is the largest at which every marginal stays that near its target, cells that would need
more than all their documents being kept whole.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import scratch_table, table

MARGINS = ("source", "lang", "topic")
#: Words are runs without these characters; a text's tokens for mixing are its words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds over all marginals, and rounds between two written tables.
ROUNDS, BLOCK = 6, 3
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A coarse topic by the first cue that the text holds."""
    return (
        F.when(F.contains(text, F.lit("icense")), "licensed")
        .when(F.contains(text, F.lit(" | ")), "tables")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as a struct, beside its marginals and tokens; nulls in a marginal are a level of their own."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
    )


def rake(cells: DataFrame, alpha: float = 0.5, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the marginals and tokens > 0) with a raked ``weight``.

    A margin's targets are shares of all tokens, by level, normalised over the levels that occur; levels without a target
    keep their own share. A margin without targets aims at shares in proportion to its tokens to the power ``alpha``. Where
    marginals contradict each other the last margin of the last round is exact and the others near.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    out = out.withColumn("total", total.cast("double"))
    for m in MARGINS:
        own = F.sum("tokens").over(Window.partitionBy(m)).cast("double")
        if targets and m in targets:
            given = F.create_map(*[F.lit(x) for pair in targets[m].items() for x in pair])
            aim = F.coalesce(given[F.col(m)], own / F.col("total"))
        else:
            aim = F.pow(own, F.lit(alpha))
        levels = out.select(m, aim.alias(f"aim_{m}")).distinct()
        levels = levels.withColumn(f"aim_{m}", F.col(f"aim_{m}") / F.sum(f"aim_{m}").over(Window.partitionBy(F.lit(0))))
        out = out.join(levels, m)
    for k in range(rounds):
        for m in MARGINS:
            out = out.withColumn("weight", F.col("weight") * F.col(f"aim_{m}") * F.col("total") / F.sum("weight").over(Window.partitionBy(m)))
        if (k + 1) % BLOCK == 0 or k + 1 == rounds:
            out = scratch_table(out, "raked")
    return out


def mix(docs: DataFrame, alpha: float = 0.5, targets: dict[str, dict[str, float]] | None = None, seed: str = "mix", rounds: int = ROUNDS, tolerance: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: row (struct), the marginals, n_tokens, probability and kept.

    Without a tolerance the cell that is shortest of its target is kept whole and the others in proportion, so that the marginals
    are met as raking met them. With one, shares of tokens in each margin may be off by that much, and as much as that allows is kept.

    Texts without words (null ones included) carry no weight and are always kept, with probability 1. Null ids
    share one draw. Repeated rows count each and share their draw. Further columns travel in ``row``; no rows give
    no rows. Cells are as many as combinations of levels, and only they are raked.
    """
    rows = described(docs)
    cells = scratch_table(rows.filter("n_tokens > 0").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, alpha, targets, rounds).withColumn("ratio", F.col("weight") / F.col("tokens"))
    most = raked.agg(F.max("ratio")).first()[0]
    if not tolerance:
        p = F.col("ratio") / F.lit(most)
    else:
        p = F.least(F.col("ratio") * widest(raked, tolerance, most), F.lit(1.0))
    chances = raked.select(*MARGINS, p.alias("p"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    joined = rows.join(chances, list(MARGINS), "left")
    p = F.when(F.col("n_tokens") > 0, F.col("p")).otherwise(F.lit(1.0))
    return joined.select("row", *MARGINS, "n_tokens", p.alias("probability"), (draw < p).alias("kept"))


def residuals(raked: DataFrame, scales: list[float]) -> list[tuple[float, float]]:
    """(scale, largest difference of a margin's share of kept tokens from its target) for each scale; one row per cell and scale."""
    each = raked.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).withColumn("kept", F.col("tokens") * F.least(F.col("ratio") * F.col("scale"), F.lit(1.0)))
    levels = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("level"), F.col(f"aim_{m}").alias("aim")) for m in MARGINS])).alias("x")
    by_level = each.select("scale", "kept", levels).groupBy("scale", "x.margin", "x.level").agg(F.sum("kept").alias("kept"), F.first("x.aim").alias("aim"))
    whole = by_level.groupBy("scale", "margin").agg(F.sum("kept").alias("all"))
    off = by_level.join(whole, ["scale", "margin"]).groupBy("scale").agg(F.max(F.abs(F.col("kept") / F.col("all") - F.col("aim"))).alias("off"))
    return sorted((r["scale"], r["off"]) for r in off.collect())  # one row per scale


def widest(raked: DataFrame, tolerance: float, most: float | None, steps: int = 96) -> float:
    """The largest scale of a grid (a tenth apart) whose residual, and that of all smaller ones, is within ``tolerance``; at least the exact one."""
    if not most:
        return 1.0
    found = residuals(raked, [1.1**k / most for k in range(steps)])
    within = list(itertools.takewhile(lambda x: x[1] <= tolerance + 1e-9, found))
    return (within or found)[-1 if within else 0][0]


def op5_mixing(spark, sf_dir):
    """Sampling probability and decision for every document."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *MARGINS, "n_tokens", F.round("probability", 9).alias("probability"), "kept")


def sampled(spark, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, the shares of all margins within 0.05 of their targets."""
    return mix(docs, tolerance=0.05).filter("kept").select("row.*")


def mixing_sql(alpha: float = 0.5, seed: str = "mix", rounds: int = ROUNDS) -> str:
    """The same in SQL."""
    steps = [
        "d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text FROM documents)",
        "r AS (SELECT doc_id, source, lang, CASE WHEN contains(text, 'icense') THEN 'licensed' WHEN contains(text, ' | ') THEN 'tables' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,"
        " CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM d)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"a_{m} AS (SELECT {m}, a / sum(a) OVER () AS aim_{m} FROM (SELECT {m}, pow(sum(tokens), {alpha}) AS a FROM c GROUP BY {m}))")
    steps.append("w0 AS (SELECT c.*, tokens AS weight, sum(tokens) OVER () AS total, aim_source, aim_lang, aim_topic FROM c JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic))")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (weight * aim_{m} * total / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM w{n})")
            n += 1
    steps.append(f"p AS (SELECT source, lang, topic, (weight / tokens) / max(weight / tokens) OVER () AS p FROM w{n})")
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0"
    chance = "CASE WHEN n_tokens > 0 THEN p ELSE 1.0 END"
    return f"WITH {', '.join(steps)} SELECT doc_id, r.source, r.lang, r.topic, n_tokens, round({chance}, 9) AS probability, ({draw}) < {chance} AS kept FROM r LEFT JOIN p USING (source, lang, topic)"
