"""Token ids of whole texts, and their cuts into pieces.

The vocabulary is a byte-level BPE in a ``tokenizers`` JSON file, whose path is
a parameter.  Its merges are ranked by id, so tiktoken encodes with the same
ranks to the same ids at a multiple of the speed; ``backend="tokenizers"``
encodes with the library that the file was made for.  Tests compare the two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiforge.llm._common import limit_batches

#: Splitting pattern of byte-level BPE (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 2
CAPACITY = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE files write bytes: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str, backend: str = "tiktoken", special: bool = True) -> Callable[[str], list[int]]:
    """A function from text to ids.

    Strings of special tokens in a text become their ids, as ``tokenizers`` has
    it by default; with ``special=False`` they are ordinary text.
    """
    if backend == "tokenizers":
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = not special
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    added = {token["content"]: token["id"] for token in stored["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in word): rank for word, rank in stored["model"]["vocab"].items() if word not in added and all(c in alphabet for c in word)}
    own = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added if special else {})
    if not special:
        return own.encode_ordinary
    return lambda text: own.encode(text, allowed_special="all") if any(s in text for s in added) else own.encode_ordinary(text)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for a shorter first where n is no multiple."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def piece_rows(batches: Iterable[pa.RecordBatch], path: str, backend: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, backend)
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.fromiter(encode(text.as_py() or ""), dtype="<u4")
            ids = np.append(ids, np.array([end_id], dtype="<u4"))
            for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                raw = ids[start : start + length].tobytes()
                row = (key, number, start, length, zlib.crc32(raw), raw if with_ids else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        wanted = 6 if with_ids else 5
        for at in range(0, len(columns[0]), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 4096], k) for c, k in zip(columns[:wanted], kinds, strict=False)], names[:wanted])


def pieces(docs: DataFrame, path: str | None = None, backend: str = "tiktoken", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and the end id, cut to ``capacity``.

    A null text counts as empty and gives the end id alone.  ``ids`` holds
    little-endian unsigned 32-bit ids.  Repeated rows give repeated pieces.
    """
    limit_batches(docs.sparkSession)
    where = path or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(lambda it: piece_rows(it, where, backend, capacity, end_id, with_ids), schema)
