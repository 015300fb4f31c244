"""Best-fit packing planned on the histogram of lengths.

Lengths are whole numbers up to the capacity, so all that a plan needs is how
many pieces each length has: at most ``capacity`` numbers, whatever the input.
Best-fit decreasing runs over these counts.  Sequences that look alike are one
class with a count, and one step moves as many pieces of a length as there are
sequences in the best-fitting class.  Each step says: ranks r.. of this length
go to sequences s.. at this offset.  Pieces then take their slots by joining on
length and rank within length.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import buckets_for, fresh_name, materialize
from lexiforge.llm.tokens import CAPACITY, pieces

PLAN = "length bigint, rank_from bigint, rank_to bigint, sequence_from bigint, place bigint"
#: Steps of a plan up to which it is broadcast (40 bytes each); a longer one is joined by length.
BROADCAST_STEPS = 100_000


def plan_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps ``(length, rank_from, rank_to, sequence_from, offset)`` of best-fit decreasing over counts."""
    classes: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, how many)
    rooms: list[int] = []
    steps: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(room: int, first: int, many: int) -> None:
        if room not in classes:
            classes[room] = []
            bisect.insort(rooms, room)
        classes[room].append((first, many))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                new = -(-left // fit)
                put(capacity, opened, new)
                opened += new
                at = len(rooms) - 1
            room = rooms[at]
            first, many = classes[room].pop()
            take = min(many, left)
            if take < many:
                classes[room].append((first + take, many - take))
            if not classes[room]:
                del classes[room]
                rooms.pop(at)
            steps.append((length, rank, rank + take, first, capacity - room))
            if room > length:
                put(room - length, first, take)
            rank, left = rank + take, left - take
    return steps


def rank_within_length(rows: DataFrame, order: list[str], spread: list[str], n: int, out: str = "rank") -> DataFrame:
    """Add ``out``, the 0-based rank within ``length``, without sorting a length in one task.

    Rows are dealt by length and a hash of ``spread``; a row's rank is its
    place in its own part plus the rows in the parts before.
    """
    parts = buckets_for(n, 100_000)
    part, place, ahead = (fresh_name(rows, c) for c in ("part", "place", "before"))
    keyed = rows.withColumn(part, F.pmod(F.xxhash64(*spread), F.lit(parts)))
    sizes = keyed.groupBy("length", part).agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("length", part, (F.sum("rows").over(Window.partitionBy("length").orderBy(part)) - F.col("rows")).alias(ahead))
    own = F.row_number().over(Window.partitionBy("length", part).orderBy(*order)) - 1
    ranked = keyed.withColumn(place, own).join(before, ["length", part])
    return ranked.withColumn(out, F.col(place) + F.col(ahead)).drop(place, ahead, part)


def place_pieces(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` (1..capacity); ``rows`` should be a stored table.

    Rows alike in all columns of ``order`` are interchangeable.
    """
    spark: SparkSession = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    steps = plan_counts(counts, capacity)
    plan = spark.createDataFrame(steps, PLAN) if steps else spark.createDataFrame([], PLAN)
    # The plan's columns, and the rank, take names that the rows have not.
    own = {c: fresh_name(rows, c) for c in (*plan.columns, "rank")}
    plan = plan.withColumnsRenamed({c: own[c] for c in plan.columns})
    at = {c: F.col(name) for c, name in own.items()}
    if len(steps) <= BROADCAST_STEPS:
        plan = F.broadcast(plan)
    ranked = rank_within_length(rows, order, order, sum(counts.values()), own["rank"])
    placed = ranked.join(plan, (F.col("length") == at["length"]) & (at["rank"] >= at["rank_from"]) & (at["rank"] < at["rank_to"]))
    return placed.withColumns({"sequence_id": at["sequence_from"] + at["rank"] - at["rank_from"], "offset": at["place"]}).drop(*own.values())


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, backend: str = "tiktoken") -> DataFrame:
    """Pack all documents: one row for each piece, with its place in a sequence.

    Null and empty texts are one end id each; repeated rows are packed each for
    itself; an empty table gives an empty plan.
    """
    cut = materialize(pieces(docs, path, backend, capacity), "pieces")
    return place_pieces(cut, ["doc_id", "piece", "start", "ids_crc32"], capacity)
