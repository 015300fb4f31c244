"""Packed token-id matrices: best-fit decreasing with a segment-tree capacity search.

Documents are tokenised, overlong ones are cut into pieces without losing an
id, and pieces are packed in blocks as they come: a task fills blocks of
``BLOCK_PIECES`` pieces from its part of the input, so most ids are never
shuffled and memory is bounded.  A second pass gathers the sequences that were
left with room, chiefly those of each task's last block, and packs their pieces
anew, so that the fill does not depend on how the input is split.  Within a block, pieces in falling length take the
sequence with the least room that still holds them.  The room is found in a
segment tree over capacities, whose leaves count open sequences by room left,
in log(capacity) steps.  A sequence becomes one row: its ids as a fixed-width little-endian
matrix row, cumulative segment lengths, and positions that restart at 0 with
each segment.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm._common import limit_batches, materialize
from lexiforge.llm.tokens import CAPACITY, END_ID, cuts, default_vocabulary, encoder

PAD_ID = 0
#: Pieces in a block: thousands of candidates for each gap, some 20 MB of ids.
BLOCK_PIECES = 8192
#: Sequences with more than this part of their room left are packed again; blocks of that pass are numbered from AGAIN on.
SPARE, AGAIN = 64, 1 << 62
MATRIX = "block bigint, sequence int, ids binary, n_ids int, cu_lengths array<int>, positions binary, doc_ids array<bigint>, pieces array<int>, starts array<bigint>"


class CapacityTree:
    """Counts of open sequences by room left; finds the least room of at least a given size."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.width)

    def add(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, size: int) -> int:
        """The least room >= size with an open sequence, or -1."""
        node = size + self.width
        if self.count[node]:
            return size
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node *= 2
                    if not self.count[node]:
                        node += 1
                return node - self.width
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """``(sequence, offset)`` of each length in falling order, and the number of sequences."""
    tree, by_room, placed, opened = CapacityTree(capacity), defaultdict(list), [], 0
    for length in lengths:
        room = tree.least(length)
        if room < 0:
            room, sequence, opened = capacity, opened, opened + 1
        else:
            sequence = by_room[room].pop()
            tree.add(room, -1)
        placed.append((sequence, capacity - room))
        if room > length:
            by_room[room - length].append(sequence)
            tree.add(room - length, 1)
    return placed, opened


def wasteful(capacity: int) -> Column:
    """Sequences with more than a ``SPARE``-th of their room left."""
    return F.lit(capacity) - F.col("n_ids") > capacity // SPARE


def matrix_schema() -> pa.Schema:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), ints, pa.binary(), longs, ints, longs)
    return pa.schema([pa.field(c.split()[0], kind) for c, kind in zip(MATRIX.split(", "), kinds, strict=True)])


def pack_block(block: int, rows: list[tuple[int | None, int, int, np.ndarray]], capacity: int, pad_id: int) -> Iterator[pa.RecordBatch]:
    """Batches of packed sequences from ``(doc_id, piece, start, ids)`` rows."""
    rows = sorted(rows, key=lambda r: (-len(r[3]), r[0] is not None, r[0] or 0, r[1], r[2]))
    placed, opened = best_fit_decreasing([len(r[3]) for r in rows], capacity)
    members: list[list[int]] = [[] for _ in range(opened)]
    for at, (sequence, _) in enumerate(placed):
        members[sequence].append(at)
    kind = rows[0][3].dtype
    places = np.dtype("<u2") if capacity <= 1 << 16 else np.dtype("<u4")
    for first in range(0, opened, 512):
        out: list[list] = [[] for _ in range(9)]
        for sequence in range(first, min(first + 512, opened)):
            own = [rows[i] for i in members[sequence]]
            lengths = [len(r[3]) for r in own]
            used = sum(lengths)
            row, positions = np.full(capacity, pad_id, kind), np.zeros(capacity, places)
            row[:used] = np.concatenate([r[3] for r in own])
            positions[:used] = np.concatenate([np.arange(n) for n in lengths])
            values = (block, sequence, row.tobytes(), used, [0, *np.cumsum(lengths).tolist()], positions.tobytes(), [r[0] for r in own], [r[1] for r in own], [r[2] for r in own])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, matrix_schema(), strict=True)], schema=matrix_schema())


def packed_matrices(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, backend: str = "tiktoken", pad_id: int = PAD_ID, block_pieces: int = BLOCK_PIECES, id_bytes: int = 2) -> DataFrame:
    """One row for each packed sequence; write it with any Spark writer.

    ``ids`` (little-endian, ``id_bytes`` 2 or 4 each) and ``positions`` are rows
    of fixed width; ``cu_lengths`` starts at 0 and has one more entry than the
    sequence has segments.  Null and empty texts are one end id each; a null
    doc_id stays null; repeated rows are packed each for itself; ties in length
    go by id, piece and start.  A very long text becomes many pieces.  A block
    is numbered by its task and its place in the task, so the same splits of
    the input give the same rows, after a lost executor too.  The first pass is
    written; the result reads it and packs what it left open once more.
    """
    limit_batches(docs.sparkSession)
    where = path or default_vocabulary()
    kind = np.dtype(f"<u{id_bytes}")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, rows = encoder(where, backend), TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [*encode(text.as_py() or ""), END_ID]
                if max(found) >> 8 * id_bytes:
                    raise ValueError(f"an id does not fit {id_bytes} bytes")
                ids = np.array(found, kind)
                rows.extend((doc_id, piece, start, ids[start : start + length]) for piece, (start, length) in enumerate(cuts(len(ids), capacity)))
                while len(rows) >= block_pieces:
                    yield from pack_block(block, rows[:block_pieces], capacity, pad_id)
                    rows, block = rows[block_pieces:], block + 1
        if rows:
            yield from pack_block(block, rows, capacity, pad_id)

    first = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pack, MATRIX), "first-pass")
    loose = first.filter(wasteful(capacity))
    pieces = loose.agg(F.sum(F.size("pieces"))).head()[0] or 0
    again = loose.repartition(max(1, pieces // block_pieces), F.xxhash64("block", "sequence")).sortWithinPartitions("block", "sequence")

    def repack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = AGAIN + (TaskContext.get().partitionId() << 32), []
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = np.frombuffer(row["ids"], kind), row["cu_lengths"]
                rows.extend((doc_id, piece, start, ids[ends[at] : ends[at + 1]]) for at, (doc_id, piece, start) in enumerate(zip(row["doc_ids"], row["pieces"], row["starts"], strict=True)))
            while len(rows) >= 2 * block_pieces:
                yield from pack_block(block, rows[:block_pieces], capacity, pad_id)
                rows, block = rows[block_pieces:], block + 1
        if rows:
            yield from pack_block(block, rows, capacity, pad_id)

    return first.filter(~wasteful(capacity)).unionByName(again.mapInArrow(repack, MATRIX))


def placements(matrices: DataFrame, id_bytes: int = 2) -> DataFrame:
    """One row for each piece in written matrices: where it lies, and the CRC-32 of the ids found there (as 32-bit)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{id_bytes}").astype("<u4")
                ends = row["cu_lengths"]
                for at, (doc_id, piece, start) in enumerate(zip(row["doc_ids"], row["pieces"], row["starts"], strict=True)):
                    values = (doc_id, piece, start, ends[at + 1] - ends[at], zlib.crc32(ids[ends[at] : ends[at + 1]].tobytes()), row["block"], row["sequence"], ends[at])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "sequence", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("piece", "sequence") else pa.int64()) for c, n in zip(out, names, strict=True)], names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, sequence int, offset bigint"
    return matrices.select("block", "sequence", "ids", "cu_lengths", "doc_ids", "pieces", "starts").mapInArrow(read, schema)
