"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset on a local master, as in tests on one
    machine, a local folder is made and set for the rest of the session; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts lineage: a lost executor costs at most the task it ran, and what follows reads the
    table as often as it likes without making it again. The frame remembers its folder for ``drop_table``;
    ``options`` are the Parquet writer's. Each phase ends with such a table, and so its garbage is collected here: else
    the driver's heap grows with the number of phases and tasks, far beyond what it holds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """At the end of a phase that leaves no scratch table."""
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Remove the files of a scratch table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished phases: Spark removes those that its driver's JVM has collected."""
    for _ in range(2):  # the second time for what only the first let go of
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def text_or_empty(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], most_chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) in slices of about ``most_chars`` characters; one text is never divided."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = t.as_py()
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= most_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts

