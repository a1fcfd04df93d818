"""Secret scanning: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a run of 16 or more key characters that has a digit or begins like a known key, or whatever is assigned to an asking word (``password=``,
``token: "``, ``the secret is``) or stands after a URL's user: of any length, up to the closing quote if it is quoted and to the next blank if not, the
stops before that blank not counted. Every occurrence is judged by itself: by its length, character classes and their
transitions, how much of it common letter pairs and dictionary words cover, whether it is a path, and the words before it.
The forest is trained from labelled findings: a table of (token, before, label), by default one made from templates of real
secret formats and of look-alikes.

A text is cut at its candidates once; what stands between two of them is the context of the second and, on redaction, is
put back as it was. The work is linear in the text, however many candidates it has.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import collect_garbage, scratch_table, table

#: An asking word with its sign of assignment or "is", what may be assigned to it, a URL's user, and runs that stand alone.
#: Signs and quotes are possessive, so that a hit's cue can be found again from the hit alone.
ASKING = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|token|(?:api|access|auth|private)[_-]?key|credentials?)[\"']?+(?:\s{0,4}+[=:]{1,2}+>?+\s{0,4}+|\s{1,4}+is:?+\s{1,4}+)"
QUOTED = r"(?:\"(?!\")[^\r\n]+?(?<!\\)(?=\")|'(?!')[^\r\n]+?(?<!\\)(?='))"
BARE = r"[\"']?+(?![\s\"'])\S++"
USER = r"://[^\s/:@?#]*+:"
ALONE = r"(?<![A-Za-z0-9+/_.\-])(?=(?:AKIA|ASIA|gh[po]_|github_pat_|xox[abp]-|sk[-_]|AIza|glpat-|ya29\.|eyJ)|[A-Za-z+/_.\-]*+[0-9])[A-Za-z0-9+/_.\-]{16,}+"
CANDIDATE = f"(?:{ASKING}(?:{QUOTED}|{BARE}))|(?:{USER}[^\\s/]+(?=@))|(?:{ALONE})"
CUE = f"^(?:{ASKING}[\"']?|{USER})"
#: What may follow a bare value without being part of it.
STOPS = ",;.:!?)]}>\"'"
#: Characters before a candidate that its neighbouring words are taken from.
BEFORE = 40
#: Cues in neighbouring words, frequent English letter pairs, and words that identifiers are made of.
ASKS = r"(?i)(pass(word|wd)?|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private)"
DENIES = r"(?i)(sha\d*|md5|commit|checksum|digest|uuid|guid|version|revision|build|page|fig|isbn|doi|https?:|href|src|phone|card|order|invoice)"
PAIRS = r"(?i)(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce)"
WORDS = r"(?i)(example|sample|test|user|name|file|image|photo|index|page|chapter|section|version|release|report|data|table|figure|introduction|appendix|static|assets|content|upload|download|article|number|document|public|local|home|http|www|mail|com|org|net|html|json|jpg|png|pdf|txt)"
#: What is assigned to an asking word without being a secret.
EMPTY = r"(?i)^([*.x_\-]+|required|optional|enabled|disabled|changed|expired|missing|invalid|incorrect|unknown|hidden|removed|redacted|string|number|boolean|default|please|please.*|\$\{?[A-Z_a-z.]+\}?|\{\{.*\}\}|%\w+%|your[_-].*|process\.env.*|os\.environ.*|getenv.*)$"
#: Fixed value: words of ordinary sentences.
PROSE = r"(?i)(?<!\w)(the|an?|your|you|my|his|her|its|our|is|are|was|be|been|must|can|cannot|may|will|should|at|least|to|of|and|or|in|on|for|with|from|by|not|no|yes|none|null|nil|true|false|this|that|what|which|who|when|how|please|enter|forgot|forgotten|type|choose|new|old|wrong|again|very|only|still|never|also|known|kept|safe|sent|used|set|long|short|one|it|as|if|so|too|all|any|only|empty|correct|required|same|hidden|stored)(?!\w)"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk[-_](live|test)?|AIza|glpat-|ya29\.|eyJ)"
FEATURES = ("n", "digits", "uppers", "lowers", "others", "hex", "transitions", "pairs", "words", "distinct", "path", "dashes", "dots", "prefix", "assigned", "asks", "denies", "blank", "spaces", "prose", "user")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def features(findings: DataFrame) -> DataFrame:
    """``findings`` (columns token and before, among others) with the columns of FEATURES."""
    t, b = F.col("token"), F.col("before")
    return findings.withColumns({
        "n": F.length(t).cast("double"),
        "digits": _share(t, "[0-9]"),
        "uppers": _share(t, "[A-Z]"),
        "lowers": _share(t, "[a-z]"),
        "others": _share(t, "[^A-Za-z0-9]"),
        "hex": t.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "transitions": _share(t, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "pairs": _share(t, PAIRS),
        "words": 1 - F.length(F.regexp_replace(t, WORDS, "")) / F.length(t),
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.least(F.length(t), F.lit(32)),
        "path": (t.rlike(r"/[^/]*/|\.(html?|js|css|png|jpe?g|gif|pdf|txt|json|xml|zip)$") | b.rlike("[/@]$")).cast("double"),
        "dashes": _share(t, "-"),
        "dots": _share(t, r"\."),
        "prefix": t.rlike(PREFIX).cast("double"),
        "assigned": b.rlike("[=:]\\s*[\"']?$").cast("double"),
        "asks": F.regexp_extract(b, r"([\w\-.]+)(?:\s+is)?[\s=:>\"'(]*$", 1).rlike(ASKS).cast("double"),
        "denies": F.regexp_extract(b, r"([\w\-.:]+)[\s=:\"'(]*$", 1).rlike(DENIES).cast("double"),
        "blank": t.rlike(EMPTY).cast("double"),
        "spaces": F.regexp_count(t, F.lit("\\s+")).cast("double"),
        "prose": F.regexp_count(t, F.lit(PROSE)) / (F.regexp_count(t, F.lit("\\s+")) + 1),
        "user": b.rlike(r"://[^\s/:@]*:$").cast("double"),
    })


def labelled_findings(spark: SparkSession, each: int = 120) -> DataFrame:
    """Findings with labels (1.0 a secret), ``each`` of every template, as a written table.

    Else all that reads them would be planned and compiled for each part of the union again. It is a fixed number of rows, in one
    partition and in order, so that the forest is the same on any cluster.
    """
    i = F.col("id")

    def hexes(n: int, salt: str) -> Column:
        return F.substring(F.concat(F.sha2(F.concat(F.lit(salt), i.cast("string")), 256), F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256)), 1, n)

    def letters(n: int, salt: str, upper: bool = False) -> Column:
        code = F.regexp_replace(F.base64(F.unhex(F.concat(hexes(64, salt), hexes(64, salt + "x")))), "[+/=\\s]", "")
        return F.substring(F.translate(F.upper(code), "0189", "ABCD") if upper else code, 1, n)

    def one_of(*texts: str) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in texts]), (F.pmod(F.xxhash64(i, F.lit("|".join(texts))), F.lit(len(texts))) + 1).cast("int"))

    plain = one_of("the report says ", "and then to ", "see ", "of which the ", "")
    asked = one_of("password=", "token = \"", "secret: ", "api_key=\"", "Authorization: Bearer ", "passwd: ", "access key ", "auth_token='")
    noted = one_of("commit ", "sha1 ", "md5: ", "checksum ", "sha256=", "digest ", "build ", "uuid: ", "version ")
    digits = F.translate(hexes(16, "k"), "abcdef", "123456")
    word = one_of("chapter", "section", "annual", "introduction", "photo", "release", "meeting", "northern")
    other = one_of("report", "appendix", "summary", "minutes", "results", "overview", "station")
    sign, animal, animal2 = one_of("!", "&", "#", "$", "%", "@"), one_of("hunter", "dragon", "monkey", "tiger", "falcon"), one_of("winter", "purple", "hunter", "shadow", "silver", "garden")
    told = one_of("the password is ", "my token is ", "secret key is: ", "passphrase is ", "new password is ", "password: ", "secret: ", "pwd=")
    quoted = one_of("password=\"", "passphrase: '", "secret = \"", "pwd: \"", "password is \"")
    user = one_of("see https://user:", "postgres://admin:", "ftp://root:", "amqp://svc:", "mongodb://app:")
    noun = [one_of("correct", "yellow", "seven", "river", "quiet", "copper"), one_of("horse", "lantern", "window", "pepper", "saddle"), one_of("battery", "orbit", "thunder", "basket", "marble"), one_of("staple", "ladder", "cactus", "violin", "anchor")]
    common = one_of("that", "not", "the", "a", "very", "long", "only", "one", "in", "to", "what", "wrong", "kept", "safe", "still", "never", "also", "written", "known", "simple", "about", "gone", "older", "sent", "shared")
    sentence = one_of("please enter your password", "must be at least eight characters", "forgot your password", "enter a new password", "is not correct", "the password that you chose", "cannot be empty", "your password was sent to you", "type it again", "choose one that is long")
    secret = [
        (F.concat(letters(4, "v"), one_of(",", ";", "<", ">", "&", "@"), letters(9, "v2"), F.substring(digits, 1, 2)), asked), (F.concat(letters(5, "v3"), one_of(",", ";", "@", "'"), letters(6, "v4")), told),
        (F.concat(F.substring(digits, 1, 1), letters(3, "v5"), one_of(",", ";", "#"), letters(4, "v6")), quoted), (F.concat_ws(" ", *noun), quoted), (F.concat_ws(" ", *noun[1:]), quoted), (F.concat_ws("-", *noun), told), (F.concat_ws("-", *noun[1:], F.substring(digits, 1, 1)), told),
        (F.concat(animal, F.substring(digits, 1, 1)), told), (F.concat(animal, F.initcap(animal2)), told), (F.concat(animal, F.substring(digits, 1, 1), F.initcap(animal2)), told), (letters(5, "v7"), asked), (F.concat(F.substring(digits, 1, 4)), asked), (letters(12, "v8"), told),
        (letters(10, "w"), user), (F.concat(animal, F.substring(digits, 1, 2)), user), (hexes(18, "w2"), user), (F.concat(F.lit("s3cret"), F.initcap(animal), F.substring(digits, 1, 1)), user), (F.concat(animal, one_of("@", "!", ","), animal2), user),
        (F.concat(F.lit("AKIA"), letters(16, "a", True)), plain),
        (F.concat(F.lit("AKIA"), letters(16, "b", True)), one_of("access key ", "aws_access_key_id = ")),
        (F.concat(F.lit("ghp_"), letters(36, "c")), plain),
        (F.concat(one_of("sk_live_", "xoxb-", "glpat-"), letters(24, "d")), plain),
        (hexes(18, "e"), asked), (hexes(40, "f"), asked), (hexes(32, "g"), asked),
        (letters(24, "h"), asked), (letters(40, "i"), asked), (letters(64, "j"), asked),
        (F.concat(letters(5, "u"), sign, F.substring(digits, 1, 2), letters(3, "u2")), asked), (F.concat(word, F.initcap(other), F.substring(digits, 1, 2), sign), asked),
        (F.concat(animal, animal2, animal), asked), (F.translate(letters(20, "u3"), "0123456789", "ghijklmnop"), asked), (letters(10, "u4"), asked),
    ]
    clean = [
        (common, told), (common, one_of("secret: ", "token: ", "pass: ", "the token is ", "whose secret is ")), (common, told), (sentence, quoted), (F.concat(sentence, F.lit(" "), common), quoted),
        (F.concat_ws("/", F.lit("assets/img"), hexes(40, "l5"), F.concat(other, F.lit("_1.jpg"))), one_of("see ", "src=\"", "and ")), (one_of("True", "False", "None", "NULL", "Yes", "No", "nothing", "hidden"), asked),
        (one_of("true", "false", "null", "none", "None", "yes", "no", "nil", "N/A", "empty", "undefined", "str", "..."), asked), (word, told), (other, one_of("secret: ", "token: ", "the pass is ")), (F.concat(F.initcap(word)), told),
        (one_of("8080", "443", "3000", "5432"), user), (one_of("password", "pass", "${PASS}", "<password>", "{password}", "xxxx", "****"), user),
        (hexes(40, "l"), noted), (hexes(64, "m"), noted), (hexes(32, "n"), noted), (hexes(32, "n2"), plain), (hexes(40, "l2"), plain), (F.upper(hexes(40, "l3")), plain), (F.upper(hexes(64, "l4")), noted),
        (F.concat_ws("-", hexes(8, "o"), hexes(4, "p"), hexes(4, "q"), hexes(4, "r"), hexes(12, "s")), one_of("uuid: ", "id ", "guid=", "the ")),
        (digits, one_of("card ", "order ", "the ", "number ", "")),
        (F.concat_ws("-", word, other, F.substring(digits, 1, 4)), plain),
        (F.concat_ws("_", word, other, F.substring(digits, 1, 2), other), asked),
        (F.concat_ws("/", F.lit("assets"), word, F.substring(digits, 1, 4), F.concat(other, F.lit(".jpg"))), one_of("src=\"", "see ", "href='/")),
        (F.concat(F.lit("www."), word, other, F.substring(digits, 1, 2), F.lit(".com")), one_of("https://", "site ")),
        (F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-01-02T03.04.05.678")), one_of("on ", "date: ")),
        (F.concat(word, other, word, F.substring(digits, 1, 1)), plain),
        (one_of("required", "********", "expired", "${DB_PASSWORD}", "{{password}}", "optional", "incorrect", "xxxxxxxx", "string", "your_password"), asked),
        (one_of("missing", "process.env.TOKEN", "disabled", "......", "default", "please", "%TOKEN%", "your-token-here"), asked),
        (F.concat_ws(".", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 3), F.substring(digits, 10, 4)), plain),
    ]
    parts = []
    for y, group in ((1.0, secret), (0.0, clean)):
        for k in range(0, len(group), 8):  # some at a time, or the generated code would be too long
            rows = F.array(*[F.struct(t.alias("token"), b.alias("before"), F.lit(y).alias("label")) for t, b in group[k : k + 8]])
            parts.append(spark.range(0, each, 1, 1).select(F.explode(rows).alias("x")).select("x.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = scratch_table(out.withColumn("at", F.monotonically_increasing_id()), "findings")
    return out.coalesce(1).sortWithinPartitions("at").drop("at")


def train(findings: DataFrame, trees: int = 60, depth: int = 10, seed: int = 17) -> RandomForestClassificationModel:
    """The forest; ``findings`` are labelled rows (token, before, label), trained where they lie."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings)).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    collect_garbage(findings.sparkSession)
    return model


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` with hits (asking words included) and pieces (what stands before each hit, and after the last); rows without hits go."""
    hits = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    cut = docs.withColumn("hits", hits).filter(F.size("hits") > 0)
    return cut.withColumn("pieces", F.split("text", CANDIDATE, -1))


def _cue(hit: Column) -> Column:
    """The asking word of a hit with its sign and quote, or a URL's user; empty for a run that stands alone."""
    return F.regexp_extract(hit, CUE, 0)


def _token(hit: Column) -> Column:
    """The value of a hit; stops after one that is neither quoted nor alone are left out, unless it is nothing else."""
    rest = F.substring(hit, F.length(_cue(hit)) + 1, F.length(hit))
    bare = F.rtrim(rest, F.lit(STOPS))
    return F.when((bare == "") | ~_cue(hit).rlike("[=:>s]\\s*$") | hit.startswith("://"), rest).otherwise(bare)


def _occurrences(cut: DataFrame, *keys: str) -> DataFrame:
    """One row per hit: the keys, place (its number in the text), token, before."""
    each = cut.select(*keys, F.explode(F.transform("hits", lambda hit, i: F.struct(i.alias("place"), hit.alias("hit"), F.concat(
        F.when(i > 0, F.right(F.element_at("hits", F.greatest(i, F.lit(1))), F.lit(BEFORE))).otherwise(F.lit("")), F.right(F.element_at("pieces", i + 1), F.lit(BEFORE))
    ).alias("left")))).alias("x"))
    return each.select(*keys, "x.place", _token(F.col("x.hit")).alias("token"), F.right(F.concat("x.left", _cue(F.col("x.hit"))), F.lit(BEFORE)).alias("before"))


def _judged(found: DataFrame, model: RandomForestClassificationModel, least: float) -> DataFrame:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found))
    judged = model.transform(rows).withColumn("score", F.round(vector_to_array(F.col("probability"))[1], 6))
    return judged.withColumn("secret", F.col("score") >= least)


def scan(docs: DataFrame, key: str, model: RandomForestClassificationModel | None = None, least: float = 0.5) -> DataFrame:
    """Findings: ``key``, place (from 0 in its text), token, before, score, secret.

    One row per occurrence, each with its own context, so that a value is a secret in one place and a checksum in another. Null and
    empty texts have none, and rows with equal keys are scanned each on its own. Only ``key`` and ``text`` are read, so further
    columns do no harm; no rows give no rows. Long texts cost their length.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    found = _occurrences(_cut(docs.select(F.col(key).alias("key"), "text")), "key")
    return _judged(found, model, least).select(F.col("key").alias(key), "place", "token", "before", "score", "secret")


def op10_secrets(spark, sf_dir):
    """Every candidate of every document, judged."""
    return scan(table(spark, sf_dir, "documents"), "doc_id")


def redact(spark, docs: DataFrame, mask: str = "<SECRET>", model: RandomForestClassificationModel | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with every occurrence of a confirmed secret replaced by ``mask`` (and n_chars, if there, made to agree).

    Occurrences are replaced by place, so that no other part of a text changes. A value that is a secret anywhere in a text
    goes in all of that text's places: a leak is a leak, whatever stands before it. Texts are told apart by their digest, so
    null, repeated and clashing ids do no harm; texts without candidates are passed on as they are.
    """
    model = model or train(labelled_findings(spark))
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    some = F.coalesce(F.regexp_count("text", F.lit(CANDIDATE)) > 0, F.lit(False))
    plain = rows.filter(~some).select("row.*")
    marked = rows.filter(some).withColumn("digest", F.sha2("text", 256))
    texts = marked.groupBy("digest").agg(F.first("text").alias("text"))
    found = _occurrences(_cut(texts), "digest")
    secrets = _judged(found, model, least).filter("secret").groupBy("digest").agg(F.collect_set("token").alias("tokens"))
    secrets = scratch_table(secrets, "secrets")
    # a text's own candidates are a row's worth, and so are its secrets
    joined = _cut(marked).join(secrets, "digest", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    put = lambda hit: F.when(F.array_contains("tokens", _token(hit)), F.concat(_cue(hit), F.lit(mask), F.substring(hit, F.length(_cue(hit)) + F.length(_token(hit)) + 1, F.length(hit)))).otherwise(hit)
    clean = F.when(F.size("tokens") == 0, F.col("text")).otherwise(F.array_join(F.zip_with("pieces", F.transform("hits", put), lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), ""))
    done = joined.select("row", clean.alias("clean"))
    out = done.select(*[F.col("clean").alias(c) if c == "text" else F.length("clean").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in columns])
    return plain.unionByName(out)
