"""Helpers shared by the operators: table access and shared intermediate storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.store import shared_folder

#: Word separators of every contract: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bounds of what Python receives at a time, in rows and bytes; whether Spark removes a query's shuffle files as soon as the query ends.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/lexiforge/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as they are) that hold within the block alone."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def limit_batches(spark: SparkSession) -> None:
    """Have Python receive few rows and few bytes at a time, which bounds memory where texts are long.

    Operators whose result runs Python only after they return call this, each
    for itself; the session keeps the limits, which change no result.
    """
    for name, value in BATCH_LIMITS.items():
        spark.conf.set(name, value)


def materialize(df: DataFrame, tag: str, *more: DataFrame) -> DataFrame:
    """Write ``df``, then ``more`` of its kind, to one folder in the shared folder and return the written table.

    Cuts the lineage: whoever reads the result again, after a lost executor
    too, reads files and repeats none of the work before.  Shuffle files of each
    write go when it ends.  Python receives bounded batches meanwhile.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    limit_batches(spark)
    with settings(spark, **{SHUFFLE_CLEANUP: "true"}):
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them has been written itself."""
    for written in tables:
        spark = written.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written._written_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def md5_int(*parts: Column, digits: int = 13) -> Column:
    """A non-negative integer of ``4 * digits`` bits from the MD5 of the joined parts.

    MD5 rather than Spark's own hashes, so that any SQL engine can follow.
    """
    joined = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("bigint")


def buckets_for(rows: int, per_bucket: int = 200_000, least: int = 16) -> int:
    """How many buckets to deal ``rows`` into, so that none outgrows a task."""
    return max(least, -(-rows // per_bucket))
