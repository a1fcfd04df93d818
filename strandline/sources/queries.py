"""Query sequences from files or literals, and results written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.seq import is_sequence

#: Least length of a coverage query.
LEAST = 300


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, n, line; files of queries are small, so each is one row at first."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def query_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, n (record in its file), query (header, null in plain files), q, up to the first blank or invalid record of a file."""
    file = Window.partitionBy("path")
    head = F.substring(F.min_by("line", "n").over(file), 1, 1)
    step = F.when(head == ">", 2).when(head == "@", 4).otherwise(1)
    lines = _lines(spark, paths).withColumn("step", step).withColumn("rec", F.floor(F.col("n") / F.col("step"))).withColumn("at", F.col("n") % F.col("step"))
    header = F.max(F.when((F.col("at") == 0) & (F.col("step") > 1), F.expr("substring(line, 2)")))
    seq = F.max(F.when(F.col("at") == F.least(F.col("step") - 1, F.lit(1)), F.col("line")))
    marked = F.max(F.when(F.col("at") == 0, (F.col("step") == 1) | (F.substring("line", 1, 1) == F.when(F.col("step") == 2, ">").otherwise("@"))))
    records = lines.groupBy("path", F.col("rec").alias("n")).agg(header.alias("query"), seq.alias("q"), marked.alias("marked"))
    valid = F.coalesce(F.col("marked") & (F.col("q") != "") & is_sequence(F.col("q")), F.lit(False))
    bad = F.min(F.when(~valid, F.col("n"))).over(file)
    return records.withColumn("bad", bad).filter("bad is null or n < bad").select("path", "n", "query", "q")


def literal(spark: SparkSession, sequences: dict[str, str]) -> DataFrame:
    """query, q of sequences given by name."""
    return spark.createDataFrame(list(sequences.items()), "query string, q string")


def coverage_queries(spark: SparkSession, paths: str | list[str], least: int = LEAST) -> DataFrame:
    """path, n (line), q: the lines of ``least`` letters or more."""
    return _lines(spark, paths).filter(F.length("line") >= least).select("path", "n", F.col("line").alias("q"))


def write_fasta(rendered: DataFrame, path: str) -> None:
    """Rendered lines (query, line_no, line) as text files, each query's lines together and in order."""
    rendered.repartitionByRange("query").sortWithinPartitions("query", "line_no").select("line").write.text(path)


def write_coverage(medians: DataFrame, path: str) -> None:
    """One line with two decimals for each covered query, in the order of queries."""
    ordered = medians.repartitionByRange("query").sortWithinPartitions("query")
    ordered.select(F.format_string("%.2f", F.col("coverage").cast("double")).alias("line")).write.text(path)
