"""Tables that are computed once and read many times, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder and a cluster is refused."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_lexiforge_store", None)
    if own is None:
        own = spark.sparkContext._lexiforge_store = f"file://{tempfile.mkdtemp(prefix='lexiforge-store-')}"
    return own


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, whose files go when the session's JVM ends."""
    path = f"{shared_folder(spark)}/lexiforge-store/{name}-{uuid.uuid4().hex}"
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    return path


def written(df: DataFrame, tag: str, bucket_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again; the files go when the session's JVM ends.

    With ``bucket_by`` it becomes a table of the catalogue, bucketed and sorted by
    that column into ``spark.sql.shuffle.partitions`` buckets: joins on the column
    read it as it lies, without a shuffle.
    """
    spark = df.sparkSession
    path = temporary(spark, tag)
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    named = f"lexiforge_{path.rsplit('/', 1)[1].replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Each bucket is one task's, so that it is one file.
    df.repartition(buckets, bucket_by).write.format("parquet").option("path", path).bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(named)
    return spark.table(named)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: what it was computed from."""
    target, files = _file_system(spark, path)
    if not files.exists(target):
        return (path,)
    return (path, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(target)))


def once(spark: SparkSession, source: str, tag: str, make: Callable[[], DataFrame], bucket_by: str | None = None) -> DataFrame:
    """The written result of ``make``, computed at most once a session for each state of the ``source`` table, until ``release``."""
    kept = getattr(spark.sparkContext, "_lexiforge_once", None)
    if kept is None:
        kept = spark.sparkContext._lexiforge_once = {}
    key = (tag, state_of(spark, source))
    if key not in kept:
        kept[key] = written(make(), tag, bucket_by)
    return kept[key]


def release(spark: SparkSession) -> None:
    """Forget what ``once`` keeps, with its tables and files; nothing that reads them may still run."""
    kept = getattr(spark.sparkContext, "_lexiforge_once", None) or {}
    for found in kept.values():
        for file in found.inputFiles()[:1]:
            target, files = _file_system(spark, file.rsplit("/", 1)[0])
            files.delete(target, True)
    for table in spark.catalog.listTables():
        if table.name.startswith("lexiforge_") and not table.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    kept.clear()
