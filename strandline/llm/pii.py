"""Personal data: base identifiers by pattern, and more by bootstrapped context.

The base spans are seeds. They induce lexical patterns: the word or two words before, the word after, and both. The form of a string
only decides whether it is a candidate, and of which kind; no pattern knows it, so nothing is found without a cue. Strings that look like an identifier but fail its base rules (spelt-out addresses, addresses without
a dot, four dotted numbers beyond 255, digit runs with a wrong check digit, numbers without a plus sign) are candidates and
stand in patterns too, as do all other strings with a digit or an at sign, which only count against a pattern. Patterns and
instances (the strings, by kind) form a graph that Spark scores in rounds: a pattern's confidence is the share of its places
that seeds and trusted instances fill; an instance's score is 1 - product(1 - confidence) over its trusted patterns. All places of trusted
instances are found, and they induce patterns in the next round. A pattern must also tell something: known identifiers have to stand at a
stated share of all occurrences of its rarest word in all texts, so that words which stand before anything ("the", "of") are no cues.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import rows_of, scratch_table, table, text_or_empty

#: The kinds of identifiers, in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Shapes that the base patterns leave: an address with its signs spelt out, one without a dot, and a number in groups. Each
#: run of letters is tried from its start only, so that long runs cost no more than their length.
SPELT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+")
BARE = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![.@])")
NUMBER = re.compile(r"(?<![A-Za-z0-9+.])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,5}){1,4}(?![A-Za-z0-9]|[.-][0-9])")
#: A string with a digit or an at sign, of whatever kind.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,3}\s*(?:([^\W\d_]+)[^\w]{0,3})?\s*$")
AFTER = re.compile(r"[^\w]{0,3}\s*([^\W\d_]+)")

#: Rounds of scoring, the least number of places that known identifiers fill in a pattern, the least confidence of a pattern, and the
#: score (more likely than not) from which an instance is trusted.
ROUNDS, LEAST_PLACES, LEAST_PATTERN, LEAST_INSTANCE = 3, 5, 0.4, 0.5
#: Least share of the occurrences of a pattern's rarest word, anywhere in the texts, at which known identifiers stand.
LEAST_SHARE = 0.1
#: Fewest and most digits of a run that may be a card with a wrong check digit. Strings that are no candidates have the kind OTHER.
RUN_DIGITS, OTHER = (12, 19), 4


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their signs, so that long texts without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    return spans(text)[0]


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and those that only failed their rules: (start, kind, end), each in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    failed = []
    for m in IP.finditer(text):
        fits = all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m.group().split(".")))
        (out if fits else failed).append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= RUN_DIGITS[0]:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
            elif RUN_DIGITS[0] <= len(digits) <= RUN_DIGITS[1]:
                failed.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out), sorted(failed)


def apart(found: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``found`` that meet none of ``taken``, in order; ``taken`` is in order of starts."""
    starts, ends = [t[0] for t in taken], list(itertools.accumulate((t[2] for t in taken), max, initial=-1))
    return [c for c in sorted(found) if ends[bisect.bisect_left(starts, c[2])] <= c[0]]


def candidates(text: str, base: list[tuple[int, int, int]] | None = None, failed: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Identifier-shaped strings that meet no base span: (start, kind, end). A string is a candidate of one kind."""
    if base is None or failed is None:
        base, failed = spans(text)
    own = apart(failed, base)
    found = [(m.start(), 0, m.end()) for m in SPELT.finditer(text)] if " at " in text or "at)" in text or "at]" in text else []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in BARE.finditer(text)]
    for m in NUMBER.finditer(text):
        if 7 <= sum("0" <= c <= "9" for c in m.group()) <= 13:
            found.append((m.start(), 3, m.end()))
    return sorted(own + apart(found, sorted(base + own)))


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The patterns of words that a string stands in."""
    m = BEFORE.search(text[max(0, start - 40) : start])
    words = [x.lower() for x in m.groups() if x] if m else []
    n = AFTER.match(text[end : end + 40])
    after = n.group(1).lower() if n else ""
    out = []
    if words:
        out.append(f"{words[-1]} _")
        if len(words) > 1:
            out.append(f"{words[0]} {words[1]} _")
    if after:
        out.append(f"_ {after}")
    if words and after:
        out.append(f"{words[-1]} _ {after}")
    return out


MARKS = "doc_id long, row long, base array<struct<s: int, k: int, e: int>>, marks array<struct<s: int, k: int, e: int, seed: boolean, instance: string, patterns: array<string>>>"


def marked(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: base spans, and every seed, candidate and other string with its patterns. The text is left behind."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for ids, texts in rows_of(batches):
            rows = []
            for doc, text in zip(ids, texts):
                base, failed = spans(text)
                rest = candidates(text, base, failed)
                others = apart([(m.start(), OTHER, m.end()) for m in TOKEN.finditer(text)], sorted(base + rest))
                marks = [{"s": s, "k": k, "e": e, "seed": i == 0, "instance": instance(text[s:e]) if k != OTHER else "", "patterns": patterns_at(text, s, e)} for i, group in enumerate((base, rest, others)) for s, k, e in group]
                rows.append({"doc_id": doc, "row": row, "base": [{"s": s, "k": k, "e": e} for s, k, e in base], "marks": marks})
                row += 1
            yield pa.RecordBatch.from_pylist(rows, schema)

    span = [("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("base", pa.list_(pa.struct(span))), ("marks", pa.list_(pa.struct([*span, ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])))])
    return text_or_empty(docs).mapInArrow(mark, MARKS)


def instance(text: str) -> str:
    """What a string is told apart by: itself in lower case, or a digest if it is long."""
    return text.lower() if len(text) <= 80 else hashlib.sha256(text.lower().encode("utf-8", "surrogatepass")).hexdigest()


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: how often each word (a run of letters, in lower case) stands in the texts; counted before they are shuffled."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return text_or_empty(docs).select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rarest(totals: DataFrame, words: DataFrame) -> DataFrame:
    """pattern, total, common: how often the rarest word of each pattern stands in the texts (0: no word of it is counted)."""
    each = totals.select("pattern", F.explode(F.split("pattern", " ")).alias("word")).filter("word <> '_'")
    held = each.join(words, "word").groupBy("pattern").agg(F.min("n").alias("common"))
    return totals.join(held, "pattern", "left").na.fill(0, ["common"])


def trusted(places: DataFrame, words: DataFrame, rounds: int = ROUNDS, least_places: int = LEAST_PLACES, least_pattern: float = LEAST_PATTERN, least_instance: float = LEAST_INSTANCE, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) that are trusted: k, pattern, confidence and k, instance, score.

    ``places`` has k, pattern, instance, seed, n, ``words`` word, n. A pattern needs a share of ``least_share`` of its rarest word's occurrences, and ``least_places`` places filled by known identifiers of its kind, of
    two different ones at least, so that copies of one text make no pattern. Ties change nothing; no places give no rows.
    """
    # a pattern with fewer places than known identifiers must fill is never trusted
    totals = places.groupBy("pattern").agg(F.sum("n").alias("total")).filter(F.col("total") >= least_places)
    total = scratch_table(rarest(totals, words), "totals")
    rest = places.filter(f"not seed and k <> {OTHER}").select("k", "pattern", "instance", "n")
    several = [F.sum("filled").alias("filled"), F.min("low").alias("low"), F.max("high").alias("high")]
    one = [F.min("instance").alias("low"), F.max("instance").alias("high")]
    seeds = scratch_table(places.filter("seed").groupBy("k", "pattern").agg(F.sum("n").cast("double").alias("filled"), *one), "seeds")
    instances = rest.select("k", "instance", F.lit(1.0).alias("score")).filter("1 = 0")
    patterns = None
    for _ in range(rounds):
        held = rest.join(instances, ["k", "instance"]).groupBy("k", "pattern").agg(F.sum(F.col("n") * F.col("score")).alias("filled"), *one)
        known = seeds.unionByName(held).groupBy("k", "pattern").agg(*several).filter((F.col("filled") >= least_places - 1e-9) & (F.col("low") < F.col("high")))
        scored = known.join(total, "pattern").filter(F.col("filled") >= least_share * F.col("common") - 1e-9).select("k", "pattern", F.least(F.col("filled") / F.col("total"), F.lit(1.0)).alias("confidence"))
        patterns = scratch_table(scored.filter(F.col("confidence") >= least_pattern - 1e-9), "patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        found = rest.join(patterns, ["k", "pattern"]).groupBy("k", "instance").agg((1 - doubt).alias("score"))
        instances = scratch_table(found.filter(F.col("score") >= least_instance - 1e-9), "instances")
    return patterns, instances


def places_of(each: DataFrame) -> DataFrame:
    """k, pattern, instance, seed, n of marks, counted before they are shuffled."""
    return each.select("k", "instance", "seed", F.explode("patterns").alias("pattern")).groupBy("k", "pattern", "instance", "seed").agg(F.count(F.lit(1)).alias("n"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (spans that the method added), n_found and n_spans, per row of ``docs``.

    Null and empty texts have no spans; a very long text is one row of marks. Null ids and repeated rows keep a row each; further
    columns are ignored; no rows give no rows. Only counts of patterns, instances and words are shuffled, and the few candidates found.
    """
    rows = scratch_table(marked(docs), "marks")
    each = rows.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    _, instances = trusted(scratch_table(places_of(each), "places"), scratch_table(words_of(docs), "words"))
    rest = each.filter(f"not seed and k <> {OTHER}").select("row", "s", "k", "e", "instance")
    added = rest.join(instances.select("k", "instance"), ["k", "instance"], "left_semi")
    added = added.groupBy("row").agg(F.collect_list(F.struct("s", "k", "e")).alias("more"))
    joined = rows.select("doc_id", "row", "base").join(added, "row", "left")
    more = F.coalesce("more", F.array().cast("array<struct<s: int, k: int, e: int>>"))

    def listed(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def of_kind(k):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    n_found, n_spans = F.size(more).cast("long"), (F.size("base") + F.size(more)).cast("long")
    return joined.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", more)).alias("spans"), listed(more).alias("found"), n_found.alias("n_found"), n_spans.alias("n_spans"))


def op4_pii(spark, sf_dir):
    """Personal data in every document."""
    return find(table(spark, sf_dir, "documents"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The digest of base spans, for tests and single texts."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
