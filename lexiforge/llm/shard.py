"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of their keys.  A balanced Feistel
network over ``a * a >= n`` points, walked along its cycle until it lands
below n, permutes the numbers; ``shard = image mod shards`` and
``slot = image div shards``.  Shard and slot of any row number are computable
without reading data, and shard sizes differ by at most one row.

Numbering never passes through one task: rows are dealt into key ranges, the
ranges are counted, and a row's number is its rank in its range plus the rows
in lower ranges.  The number is a function of the data alone, so it does not
depend on where the range borders fall.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import fresh_name, materialize

ROUNDS = 6
#: Walks along a cycle.  The domain exceeds n by at most 2 * sqrt(n) points, so
#: for n up to 1000 no walk can be longer, and beyond that the chance of a
#: longer one is below (2 / sqrt(n)) ** WALKS.
WALKS = 64


def feistel(number: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The image of ``number`` under the seeded permutation of 0..n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)

    def mix(half: Column, turn: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") % F.lit(a)

    def once(x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)),
            F.struct(F.floor(x / F.lit(a)).cast("bigint").alias("l"), (x % F.lit(a)).cast("bigint").alias("r")),
            lambda s, turn: F.struct(s["r"].alias("l"), ((s["l"] + mix(s["r"], turn)) % F.lit(a)).alias("r")),
            lambda s: s["l"] * F.lit(a) + s["r"],
        )

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        number.cast("bigint"),
        lambda x, step: F.when((step > 1) & (x < F.lit(n)), x).otherwise(once(x)),
    )
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def number_rows(df: DataFrame, keys: list[str], out: str = "row_no") -> tuple[DataFrame, int]:
    """Add the 0-based rank of each row in the order of ``keys``; also return the row count.

    Nulls come first.  Rows equal in all keys take adjacent numbers in any
    order; give all columns as keys where that matters.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    range_, rank, ahead = (fresh_name(df, c) for c in ("range", "rank", "before"))
    ranged = materialize(df.repartitionByRange(*order).withColumn(range_, F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(range_).agg(F.count(F.lit(1)).alias("rows"))
    # One row for each range: at most spark.sql.shuffle.partitions rows.
    before = counts.select(range_, (F.sum("rows").over(Window.orderBy(range_)) - F.col("rows")).alias(ahead))
    n = ranged.count()
    ranked = ranged.withColumn(rank, F.row_number().over(Window.partitionBy(range_).orderBy(*order)) - 1)
    numbered = ranked.join(before, range_)
    return numbered.withColumn(out, F.col(rank) + F.col(ahead)).drop(rank, ahead, range_), n


def shard_rows(df: DataFrame, keys: list[str], n_shards: int = 16, seed: int = 17) -> DataFrame:
    """Return ``df`` with ``row_no``, ``shard`` and ``slot``.

    Law ``rows``: shard sizes differ by at most one.  Rows equal in all keys
    are interchangeable; null keys sort first; an empty input gives an empty
    result; other columns pass through (columns named like the three results
    are replaced).
    """
    df = df.drop("row_no", "shard", "slot")
    numbered, n = number_rows(df, keys)
    at = fresh_name(numbered, "image")
    image = numbered.withColumn(at, feistel(F.col("row_no"), n, seed))
    return image.withColumns(
        {
            "shard": (F.col(at) % F.lit(n_shards)).cast("int"),
            "slot": F.floor(F.col(at) / F.lit(n_shards)).cast("bigint"),
        }
    ).drop(at)


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1) and text_crc32 of each document; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
