"""Reads from files, and reads that stand in for them in the test tables.

Files are read as lines with Spark's text source: a record is two lines (FASTA) or four (FASTQ) or one (plain), told apart
by the first character. Files are split as any text; a line's number is its place in its split after the lines of the splits
before it in the file, so that one large file is read by many tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.seq import is_sequence, longest_known, mask_low_quality, revcomp

#: Least length of a cleaned read, most libraries of pairs, and bits of a fragment's number within its document.
LEAST, MOST_PAIRED, LOCAL = 45, 5, 20

#: The stand-in alphabet: letters of a text as bases, a-z and A-Z each cycling through them.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 7)[:26] * 2


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """lib_id, kind (paired, single), paths: lines ``paired a b``, ``paired ab`` or ``single a``; blank lines and comments skipped.

    Paired libraries come first, in the order of the file; more than five paired ones or another word are errors.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    words = lines.withColumn("line", F.trim("line")).filter("line <> '' and line not like '#%'").select("n", F.split("line", "\\s+").alias("w"))
    rows = words.select("n", F.element_at("w", 1).alias("kind"), F.slice("w", 2, F.size("w") - 1).alias("paths"))
    bad = ~F.col("kind").isin("paired", "single") | (F.size("paths") < 1) | (F.size("paths") > F.when(F.col("kind") == "paired", 2).otherwise(1))
    checked = rows.withColumn("paths", F.when(bad, F.raise_error(F.concat(F.lit("bad line in list of libraries: "), F.col("kind")))).otherwise(F.col("paths")))
    if checked.filter("kind = 'paired'").count() > MOST_PAIRED:
        raise ValueError(f"more than {MOST_PAIRED} paired libraries")
    return checked.select((F.row_number().over(Window.orderBy(F.col("kind") != "paired", "n")) - 1).alias("lib_id"), "kind", "paths")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n (line number in its file from 0), line. Only one row per split is counted and summed up, file by file."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("path").orderBy("block")) - F.col("held")
    placed = splits.select("path", "block", (before - F.col("first")).alias("shift"))
    return rows.join(placed, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("n"), "line")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n (record number in its file), header, seq, quality (null unless FASTQ) of plain, FASTA and FASTQ files.

    A file's first character tells its kind; one that is neither a base nor a mark is an error. A file that is cut short keeps
    the record whose sequence is there. An empty file has no records.
    """
    lines = numbered_lines(spark, paths)
    first = lines.filter("n = 0").select("path", F.upper(F.substring("line", 1, 1)).alias("mark"))
    known = F.when(F.col("mark").isin(*"ACGTN>@", ""), F.col("mark")).otherwise(F.raise_error(F.concat("path", F.lit(": neither bases, FASTA nor FASTQ"))))
    kinds = first.select("path", F.when(known == ">", 2).when(known == "@", 4).otherwise(1).alias("step"))
    each = lines.join(kinds, "path").withColumn("rec", F.expr("n div step")).withColumn("at", (F.col("n") % F.col("step")).cast("int"))
    pick = lambda at: F.max(F.when(at, F.col("line")))
    records = each.groupBy("path", F.col("rec").alias("n")).agg(
        pick((F.col("at") == 0) & (F.col("step") > 1)).alias("header"), pick(F.col("at") == F.when(F.col("step") == 1, 0).otherwise(1)).alias("seq"), pick((F.col("step") == 4) & (F.col("at") == 3)).alias("quality")
    )
    return records.filter("seq is not null").select("path", "n", F.expr("substring(header, 2)").alias("header"), "seq", "quality")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or a local one on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='strandline-')}/reads-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, for what is read more than once and dear to make again.

    The driver's garbage is collected behind it, so that Spark removes the shuffle files of the phase that it ends.
    """
    spark = rows.sparkSession
    path = shared_folder(spark)
    rows.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(rows.schema).parquet(path)


def cleaned(seq: Column, quality: Column | None = None, least_quality: int = 0) -> Column:
    """Masked, cut to the longest known stretch; null if that is too short or the read holds other letters."""
    masked = seq if quality is None else F.when(quality.isNull(), seq).otherwise(mask_low_quality(seq, quality, least_quality))
    best = longest_known(masked)
    return F.when(is_sequence(F.upper(masked)) & (F.length(best) >= LEAST), F.upper(best))


def pair_up(left: DataFrame, right: DataFrame) -> DataFrame:
    """n, seq, mate: pairs of cleaned mates of one record number; a mate left alone is demoted to a single read (mate null)."""
    both = left.select("n", F.col("seq").alias("a")).join(right.select("n", F.col("seq").alias("b")), "n", "full")
    return both.filter("a is not null or b is not null").select("n", F.coalesce("a", "b").alias("seq"), F.when(F.col("a").isNotNull(), F.col("b")).alias("mate"))


def read_length(reads: DataFrame, most: int = 1000) -> int:
    """Longest of the first thousand records; 80 to 255 is accepted."""
    longest = reads.orderBy("n").limit(most).agg(F.max(F.length("seq"))).first()[0]
    if longest is None or not 80 <= longest <= 255:
        raise ValueError(f"read length {longest} is not within 80 and 255")
    return longest


def bases(text: Column) -> Column:
    """A text's letters as bases."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS, BASES)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, if they lie in fewer partitions than there are; a table of many splits stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows.repartition(2 * cores) if held < cores else rows


def fragments(docs: DataFrame, sequence: Column | None = None) -> DataFrame:
    """frag_id, seq: windows of 100 at every 50th base of each document, those of 45 or more.

    A text is cut into pieces of 50 once and neighbours are joined, so that its cost is linear in its length.
    """
    g = spread(docs).select("doc_id", (bases(F.col("text")) if sequence is None else sequence).alias("g"))
    pieces = g.select("doc_id", F.regexp_extract_all("g", F.lit(".{1,50}"), F.lit(0)).alias("p")).filter(F.size("p") > 0)
    windows = F.transform("p", lambda x, k: F.when(k + 1 < F.size("p"), F.concat(x, F.element_at("p", F.least(k + 2, F.size("p"))))).otherwise(x))
    each = pieces.select("doc_id", F.posexplode(windows).alias("k", "seq")).filter(F.length("seq") >= LEAST)
    return each.select((F.col("doc_id") * (1 << LOCAL) + F.col("k")).alias("frag_id"), "seq")


def oriented(frags: DataFrame) -> DataFrame:
    """read_id, frag_id, strand, seq: each fragment forward (2 * frag_id) and as its reverse complement (the id after it)."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("seq")), F.struct(F.lit(1).alias("strand"), revcomp(F.col("seq")).alias("seq"))))
    return frags.select("frag_id", both.alias("x")).select((F.col("frag_id") * 2 + F.col("x.strand")).alias("read_id"), "frag_id", "x.strand", "x.seq")


#: The rule by which stand-in reads get errors: next base in this order, and what follows an insert.
ORDER, ADAPTER = ("ACGT", "CGTA"), "CTGTCTCTTATA"


def noisy(rows: DataFrame) -> DataFrame:
    """Oriented reads with errors by a fixed rule: of each four one as it is, one with one base changed, one with two, one that ends in an adapter."""
    p = (10 + F.col("frag_id") % 30).cast("int")

    def changed(seq: Column, at: Column) -> Column:
        return F.concat(F.substring(seq, F.lit(1), at - 1), F.translate(F.substring(seq, at, F.lit(1)), *ORDER), F.substring(seq, at + 1, F.length(seq)))

    once = changed(F.col("seq"), p)
    kind = (F.col("frag_id") + F.col("strand")) % 4
    seq = F.when(kind == 1, once).when(kind == 2, changed(once, p + 7)).when(kind == 3, F.concat(F.left("seq", F.length("seq") - len(ADAPTER)), F.lit(ADAPTER))).otherwise(F.col("seq"))
    return rows.select("read_id", "frag_id", "strand", seq.alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in reads of ``documents``."""
    return oriented(fragments(spark.read.parquet(f"{sf_dir}/documents.parquet")))
