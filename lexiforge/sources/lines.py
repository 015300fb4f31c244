"""Lines of dictionary and affix files: plain or compressed, in any character set."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the compressed format.
PLAIN_MAGIC, KEYED_MAGIC = b"hz0", b"hz1"
TAB, BLANK, ESCAPE, TAB_LEFT = 9, 32, 31, 30
FIRST_PLAIN, RIGHT_BASE = 47, 31
SUFFIX = ".hz"

LINES = "entry_id bigint, value string"
SCHEMA = pa.schema([("entry_id", pa.int64()), ("value", pa.string())])


def codec(charset: str) -> str:
    """The Python codec of a character set as affix files name it; unknown sets are refused."""
    name = re.sub(r"^microsoft-", "", charset.strip().lower())
    name = re.sub(r"^tis620.*", "tis-620", name)
    try:
        return codecs.lookup(name).name
    except LookupError:
        raise ValueError(f"character set {charset} is not supported") from None


class Header:
    """The code table: pairs of bytes by their bits; the last entry ends the text."""

    def __init__(self, data: bytes, key: bytes | None):
        magic = data[:3]
        if magic not in (PLAIN_MAGIC, KEYED_MAGIC):
            raise ValueError("not a compressed dictionary")
        self.data, self.at, self.key, self.used = data, 3, None, 0
        if magic == KEYED_MAGIC:
            check = 0
            for b in key or b"":
                check ^= b
            if not key or data[3] != check:
                raise ValueError("missing or wrong key of a compressed dictionary")
            self.at, self.key = 4, key
        self.codes: dict[str, bytes] = {}
        self.end = ""
        count = int.from_bytes(self.take(2), "big")
        for _ in range(count):
            pair, size = self.take(2), self.take(1)[0]
            bits = "".join(f"{b:08b}" for b in self.take(size // 8 + 1))[:size]
            self.codes[bits] = pair
            self.end = bits

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("a compressed dictionary ends too early")
        self.at += n
        if self.key:
            got = bytes(b ^ self.key[(self.used + i) % len(self.key)] for i, b in enumerate(got))
            self.used += n
        return got


def unpack(data: bytes, key: bytes | None = None) -> bytes:
    """The bytes that the codes stand for, with what shortens lines still in them."""
    header = Header(data, key)
    out, bits = bytearray(), ""
    for byte in data[header.at :]:
        for bit in f"{byte:08b}":
            bits += bit
            pair = header.codes.get(bits)
            if pair is None:
                continue
            if bits == header.end:
                return bytes(out + pair[1:] if pair[0] else out)
            out += pair
            bits = ""
    raise ValueError("a compressed dictionary ends too early")


def restore(packed: bytes) -> Iterator[bytes]:
    """Lines, each given as what differs from the start and the end of the line before."""
    last, own, stream = b"", bytearray(), iter(packed)
    for byte in stream:
        if byte == ESCAPE:
            own += bytes([next(stream, 0)])
        elif byte in (TAB, BLANK) or byte >= FIRST_PLAIN:
            own.append(byte)
        else:
            right = byte - RIGHT_BASE if byte > BLANK else 0
            left = next(stream, 0) if right else byte
            left = TAB if left == TAB_LEFT else left
            last = last[:left] + bytes(own) + (last[len(last) - right :] if right else b"")
            yield last
            own = bytearray()
    if own:
        yield bytes(own)


def file_lines(data: bytes, charset: str, key: str | None = None) -> list[str]:
    """Lines of a file's bytes, without line ends; compressed files are told by their first bytes."""
    if data[:3] in (PLAIN_MAGIC, KEYED_MAGIC):
        found = [line.decode(codec(charset), "replace") for line in restore(unpack(data, key.encode() if key else None))]
    else:
        found = data.decode(codec(charset), "replace").split("\n")
        found = found[:-1] if found and not found[-1] else found
    return [line.rstrip("\r\n") for line in found]


def existing(spark: SparkSession, path: str) -> str:
    """The path, or its compressed twin where only that exists."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    twin = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + SUFFIX)
    return path + SUFFIX if not files.exists(target) and files.exists(twin) else path


def read_lines(spark: SparkSession, path: str, charset: str = "UTF-8", key: str | None = None) -> DataFrame:
    """``(entry_id, value)`` in the order of the file.

    Plain UTF-8 files are split among tasks.  Others are read whole by one task
    each: their bits or bytes can be told apart from the start only.
    """
    path = existing(spark, path)
    if not path.endswith(SUFFIX) and codec(charset) == "utf-8":
        return spark.read.text(path).withColumn("entry_id", F.monotonically_increasing_id()).select("entry_id", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                found = file_lines(data, charset, key)
                for start in range(0, len(found), 10_000):
                    part = found[start : start + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(range(start, start + len(part)), pa.int64()), pa.array(part, pa.string())], schema=SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, LINES)
