"""URL filters: host-suffix and path-prefix expressions of every URL joined with the rules by short hash prefixes.

A rule has a host, a path and an action. It fits its host and all subdomains if the URL's path starts with the rule's path; the
longest rule that fits a URL decides. A URL is expanded into the expressions that a rule could be equal to: its host's suffixes at
dots, of as many labels as some rule's host has, each with the beginnings of its path, of the lengths that some rule's path has. So the number of expressions
depends on the rules and not on the length of a URL. Expressions meet rules by the first 32 bits of their SHA-256, and those that meet are confirmed by the whole digest.

DataFrame functions only. One pass over the URLs: a row's expressions and the row itself travel as one exploded array. Few rules are
broadcast after they are counted. Otherwise rules are repeated under ``SALTS`` salts and each row takes one of them by its place, so
that no expression, however common, meets in one task.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

#: Rules that are broadcast at most (some 200 bytes each), salts of a longer list, and kinds of labels and lengths of paths at most.
MOST_BROADCAST, SALTS, MOST_SIZES = 50_000, 64, 4096
RULES = "action string, host string, path string"


def _lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parted(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both are empty for a null URL and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; a host holds no slash, so host and path can be told apart in it."""
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def prepared(rules: DataFrame) -> DataFrame:
    """The rules by digest: host, path, action, digest, short. Of equal rules with different actions ``block`` counts.

    Rules without a host fit nothing and are left out, a null path is the empty one, which every path starts with. A path that does
    not start with a slash, or one with ``?`` or ``#``, can't start any path; nor can a host with ``/``, ``?`` or ``#`` be one.
    """
    rows = rules.select(F.col("action"), _lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    sound = rows.filter("host <> ''").filter(~F.col("host").rlike("[/?#]")).filter(F.col("path").rlike(r"^(/[^?#]*)?$"))
    held = sound.groupBy("host", "path").agg(F.min(F.when(F.col("action") == "block", "block").otherwise("allow")).alias("first"), F.max_by("action", F.col("action") == "block").alias("action"))
    return held.select("host", "path", "action").withColumn("digest", _digest(F.col("host"), F.col("path"))).withColumn("short", _short(F.col("digest")))


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``urls`` as a struct ``row`` with host, path, rule (``host`` + ``path``; null if none fits) and verdict.

    The longest rule wins (in characters); of several as long the one with the longer host. ``otherwise`` is the verdict without a rule.
    Every row is judged by itself: repeated rows and ids each give a row, null URLs have an empty host and path
    and no rule. Further columns travel in ``row``. Very long URLs cost their length times the number of expressions. No rows give no rows; no rules leave ``otherwise``.
    """
    held = prepared(rules)
    sizes = held.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    n, labels, lengths = sizes[0], sorted(sizes[1]), sorted(sizes[2])
    if len(labels) + len(lengths) > MOST_SIZES:
        raise ValueError(f"rules of more than {MOST_SIZES} numbers of labels and lengths of paths")
    salts = 1 if n <= most_broadcast else SALTS

    host, path = parted(F.col(url))
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("at"))
    salt = F.pmod(F.xxhash64("at"), F.lit(salts))
    suffix = lambda k: F.substring_index("host", ".", -k)
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    # a suffix of k labels, or a beginning of k characters, is there if the host or path has as many; others are null and go
    fits = [F.when((dots >= k - 1) & (F.length("path") >= m), _digest(suffix(k), F.left("path", F.lit(m)))) for k, m in product(labels, lengths)]
    plain = F.struct(F.lit(None).cast("string").alias("digest"), F.col("row"), F.col("host"), F.col("path"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("row", rows.schema["row"].dataType), ("host", "string"), ("path", "string"))]
    asked = F.filter(F.array(*[F.struct(d.alias("digest"), *none) for d in fits]), lambda x: x["digest"].isNotNull()) if fits else F.array().cast(f"array<struct<digest:string,row:{rows.schema['row'].dataType.simpleString()},host:string,path:string>>")
    each = rows.select("at", salt.alias("salt"), F.explode(F.concat(F.array(plain), asked)).alias("x")).select("at", "salt", "x.*")
    # what carries the row itself asks for nothing; below zero it meets no rule and is spread by its place
    each = each.withColumn("short", F.when(F.col("digest").isNull(), -1 - F.col("at")).otherwise(_short(F.col("digest"))))

    right = held.select("short", F.col("digest").alias("whole"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("n_host"), F.concat("host", "path").alias("rule"), "action").alias("hit"))
    if salts == 1:
        met = each.join(F.broadcast(right), "short", "left")
    else:
        met = each.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))), ["short", "salt"], "left")
    hit = F.when(F.col("digest") == F.col("whole"), F.col("hit"))
    best = met.withColumn("hit", hit).filter("digest is null or hit is not null")
    out = best.groupBy("at").agg(F.first("row", True).alias("row"), F.max("host").alias("host"), F.max("path").alias("path"), F.max("hit").alias("hit"))
    return out.select("row", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(otherwise)).alias("verdict"))


#: The rules of the query.
QUERY_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the query's rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judged(pages, spark.createDataFrame(QUERY_RULES, RULES))
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def url_sql() -> str:
    """The same in SQL."""
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in QUERY_RULES)
    lower = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH rules(action, rule_host, rule_path) AS (VALUES {rules}), p AS (SELECT n, page_id, {lower} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (
        SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM (SELECT *, rule_host || rule_path AS rule, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
        FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) WHERE place = 1"""
