"""Whitening of embeddings by an exact scatter in residue numbers.

Components are whole numbers, so their scatter is one too.  It is not summed in
floating point: every partition multiplies its centred rows modulo a few primes
below 2 ** 21, where a product of up to ``ROWS`` rows is exact in double
precision; residues are added across partitions, and the Chinese remainder
theorem gives the exact scatter, for as many primes as its bound needs.  With
``n`` vectors and sums ``S``, rows are centred before they are multiplied by
taking ``n * x - S``, which keeps whole numbers.  The eigenvectors of the
covariance, rounded once from the exact value, come from a double-precision
decomposition on the driver, which holds nothing but matrices of the dimension.

A task holds one Arrow batch and, for each prime, a matrix of the dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm._common import materialize

SCALE, SHIFT, MOST = 64, 1_000_000, 16
#: Primes are below 2 ** PRIME_BITS; so many rows have exact sums of products in 53 bits.
PRIME_BITS = 21
ROWS = 2 ** (53 - 2 * PRIME_BITS)
SUMS = "i int, total decimal(38,0), low bigint, high bigint, n bigint"


def primes() -> Iterator[int]:
    """Primes below 2 ** PRIME_BITS, the largest first."""
    for p in range(2**PRIME_BITS - 1, 2, -2):
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            yield p


def basis(bound: int) -> list[int]:
    """Primes whose product exceeds twice ``bound``, so that residues tell all whole numbers of that size, with sign."""
    found, product = [], 1
    for p in primes():
        if product > 2 * bound:
            break
        found.append(p)
        product *= p
    return found


def reconstruct(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Whole numbers (objects) from residues ``(moduli, ...)``, the smallest in size."""
    product = math.prod(moduli)
    total = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


def scatter_residues(x: np.ndarray, n: int, sums: list[int], moduli: list[int]) -> np.ndarray:
    """``(moduli, d, d)``: the scatter of ``n * x - sums`` over the rows of ``x``, modulo each prime."""
    out = np.zeros((len(moduli), x.shape[1], x.shape[1]), np.int64)
    for k, p in enumerate(moduli):
        off = np.array([s % p for s in sums], np.int64)
        for at in range(0, len(x), ROWS):
            y = ((x[at : at + ROWS] % p * (n % p) - off) % p).astype(np.float64)
            out[k] = (out[k] + (y.T @ y).astype(np.int64) % p) % p
    return out


@dataclass
class Whitening:
    """What a fit found: ``n`` distinct vectors with ``sums``, components as columns with their eigenvalues, the trace, the error of identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    #: Largest size of a component of ``n * x - sums``.
    most: int
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, as 64-bit whole numbers where they fit, else as objects."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums)) < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened components of rows of :meth:`deviations`."""
        return (y.astype(np.float64) / self.n) @ self.components / np.sqrt(self.values)


def valid(vector: Column) -> Column:
    """Not null and not empty, without null or non-finite entries, or such as are no 64-bit whole number when scaled."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**62 / SCALE))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole(vector: Column) -> Column:
    """Each entry as the whole number ``floor(64 * c) + 1000000``."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("bigint"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def column_sums(fitted: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, sums, minima and maxima of ``x`` by dimension: one row for each partition and dimension is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, low, high = None, 0, None, None
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("x"))
                part = [int(c) for c in x.astype(object).sum(0)] if np.abs(x).max() >= 2**62 // len(x) else x.sum(0).tolist()
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                low, high = (x.min(0), x.max(0)) if low is None else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
                n += len(x)
        if total is not None:
            columns = [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low), pa.array(high), pa.array([n] * len(total), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "total", "low", "high", "n"])

    found = fitted.select("x").mapInArrow(run, SUMS).groupBy("i").agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    rows = found.orderBy("i").collect()  # one row a dimension
    return (int(rows[0]["n"]) if rows else 0), [int(r["total"]) for r in rows], [r["low"] for r in rows], [r["high"] for r in rows]


def exact_scatter(fitted: DataFrame, n: int, sums: list[int], most: int) -> np.ndarray:
    """The scatter of ``n * x - sums`` (objects), whose entries are at most ``n * most ** 2``."""
    moduli = basis(n * most * most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = scatter_residues(matrix(batch.column("x")), n, sums, moduli)
                total = part if total is None else (total + part) % np.array(moduli)[:, None, None]
        if total is not None:
            d = len(sums)
            names = [np.repeat(np.arange(len(moduli)), d), np.tile(np.arange(d), len(moduli))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in names], pa.array(total.reshape(-1, d).tolist(), pa.list_(pa.int64()))], ["k", "i", "row"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = moduli[key[0].as_py()]
        total = np.zeros(len(sums), np.int64)
        for batch in batches:
            total = (total + matrix(batch.column("row")).sum(0)) % p
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["k", "i", "row"])

    parts = fitted.select("x").mapInArrow(run, "k int, i int, row array<bigint>")
    rows = parts.groupBy("k", "i").applyInArrow(add, "k int, i int, row array<bigint>").collect()  # a matrix for each prime
    residues = np.zeros((len(moduli), len(sums), len(sums)), np.int64)
    for r in rows:
        residues[r["k"], r["i"]] = r["row"]
    return reconstruct(residues, moduli)


def identity_error(fitted: DataFrame, fit: Whitening) -> float:
    """The largest entry of the covariance of whitened fit rows less the identity."""
    spark: SparkSession = fitted.sparkSession
    k = len(fit.values)
    shared = spark.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if len(batch):
                own = shared.value
                z = own.project(own.deviations(matrix(batch.column("x"))))
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = fitted.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    rows = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # k * k rows
    covariance = np.zeros((k, k))
    for r in rows:
        covariance[r["i"], r["j"]] = r["value"] / fit.n
    return float(np.abs(covariance - np.eye(k)).max()) if k else 0.0


def fit_whitening(fitted: DataFrame, most: int = MOST) -> Whitening | None:
    """Fit on ``fitted (x)``, a stored table of distinct whole-number vectors of one length; None without any.

    Components whose eigenvalue is no more than rounding noise have no whitened
    form and are left out, so data of lower rank have fewer.
    """
    n, sums, low, high = column_sums(fitted)
    if not n:
        return None
    bound = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums, strict=True))
    scatter = exact_scatter(fitted, n, sums, bound)
    covariance = (scatter / n**3).astype(np.float64) if n else scatter  # whole numbers divide with one rounding
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(int(np.trace(scatter)) / n**3)
    order = order[values[order] > trace * len(sums) * np.finfo(np.float64).eps]
    fit = Whitening(n, sums, np.ascontiguousarray(vectors[:, order]), values[order], trace, bound)
    fit.identity_error = identity_error(fitted, fit)
    return fit


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries, or
    entries of 2 ** 56 and more, are left out, as are those of another length
    than the most common one (the longest of such).  Repeated rows and null ids are whitened like others;
    equal vectors count once in the fit.  ``deviation`` is the exact
    ``sum((n * x - S) ** 2)``, a decimal of 38 digits, null where it has more.
    Without usable rows, or where all are alike, the result is empty.
    """
    spark: SparkSession = vectors.sparkSession
    rows = vectors.filter(valid(F.col(vector_col))).select(F.col(id_col).alias("_id"), whole(F.col(vector_col)).alias("x"))
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    usual = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    kind = vectors.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fit_whitening(distinct.filter(F.size("x") == usual["d"]), most) if usual else None
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = shared.value
                k = len(own.values)
                y = own.deviations(matrix(batch.column("x")))
                square = (y * y).sum(1) if len(own.sums) * int(np.abs(y).max()) ** 2 < 2**62 else (y.astype(object) ** 2).sum(1)
                deviation = [Decimal(s) if s < 10**38 else None for s in map(int, square)]
                repeat = np.repeat(np.arange(len(y)), k)
                columns = [
                    batch.column("_id").take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(len(repeat), own.n), pa.int64()),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(repeat)), pa.array(own.project(y).ravel()), pa.array(np.tile(own.values / own.trace, len(y))), pa.array(np.full(len(repeat), own.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == usual["d"]).mapInArrow(run, schema)
