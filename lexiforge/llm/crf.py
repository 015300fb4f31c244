"""Document quality from a linear-chain conditional random field over lines.

Each line that holds a word is labelled good or bad.  Its features describe the
line itself, its two neighbours and its place; transitions tie neighbouring
labels.  With two labels, messages are log-odds: forward and backward passes
are one number a line.  A document's score is the mean marginal of "good",
weighted by line length.

A document's label is evidence for each of its lines, not their label: lines are
latent in training.  The field is fitted so that its marginals, free of the
document's label, meet those under it, where every line's log-odds are shifted by
``EVIDENCE`` towards the document's label.  So a bad document may hold good lines, and
transitions learn how labels change from line to line.

Training runs on a bounded sample: ``TRAIN_DOCS`` labelled documents by hash of id
and text, and of each at most ``TRAIN_CHAINS`` chains of ``CHAIN`` lines, spread over
it.  Every text is scored whole.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiforge.llm._common import limit_batches

TRAIN_DOCS, TRAIN_CHAINS, CHAIN, EPOCHS, RATE, RIDGE, EVIDENCE = 3000, 4, 64, 150, 0.05, 1e-3, 2.0
CLASSES = ("lower", "upper", "digit", "symbol", "bang", "space", "mark")
OWN = (*CLASSES, "length", "word_length", "words", "distinct", "adjacent", "closed", "capital", "twice", "again")
#: Features that a line also has of the lines before and after it.
SEEN = tuple(OWN.index(f) for f in ("upper", "symbol", "bang", "length", "distinct", "adjacent", "twice"))
WIDTH = len(OWN) + 2 * len(SEEN) + 3


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Number of the class of each code point; other characters have none (255)."""
    table = np.full(sys.maxunicode + 1, 255, np.uint8)
    for code in range(0x3000):
        char, kind = chr(code), unicodedata.category(chr(code))
        if kind in ("Lu", "Lt"):
            table[code] = 1
        elif kind[0] in "LM":
            table[code] = 0
        elif kind[0] == "N":
            table[code] = 2
        elif char in "#*$%&|<>":
            table[code] = 3
        elif char in "!?":
            table[code] = 4
        elif char.isspace():
            table[code] = 5
        elif kind[0] in "PS":
            table[code] = 6
    return table


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, WIDTH) and lengths of the lines that hold a word."""
    lines = [line for line in text.split("\n") if line.strip()]
    if not lines:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    lengths = np.array([len(line) for line in lines], np.float64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    kinds = class_table()[codes]
    own = np.zeros((len(lines), len(OWN)), np.float32)
    for c in range(len(CLASSES)):
        own[:, c] = np.add.reduceat(kinds == c, starts, dtype=np.int64) / lengths
    times, before = Counter(lines), ""
    for row, line in zip(own, lines, strict=True):
        words = line.split()
        many = len(words)
        row[7:] = (
            math.log1p(len(line)),
            min(len(line) / many, 40) / 10,
            math.log1p(many),
            len(set(words)) / many,
            sum(map(eq, words, words[1:])) / many,
            line.rstrip()[-1] in ".!?:;\"'",
            words[0][0].isupper(),
            times[line] > 1,
            line == before,
        )
        before = line
    around = np.zeros((len(lines), 2 * len(SEEN) + 3), np.float32)
    around[1:, : len(SEEN)] = own[:-1, SEEN]
    around[:-1, len(SEEN) : -3] = own[1:, SEEN]
    around[0, -3], around[-1, -2], around[:, -1] = 1, 1, 1
    return np.hstack([own, around]), lengths


@dataclass
class Field:
    """Weights of the good label over the bad one, and transitions from (row) to (column) with 1 for good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    def score(self, text: str | None) -> float:
        x, lengths = line_features(text or "")
        if not len(lengths):
            return 0.0
        unary = (((x - self.mean) / self.scale) @ self.weights).tolist()
        (a00, a01), (a10, a11) = self.transitions.tolist()
        forward, message = [], None
        for u in unary:
            message = u if message is None else u + carry(message, a00, a01, a10, a11)
            forward.append(message)
        total, message = 0.0, 0.0
        for at in range(len(unary) - 1, -1, -1):
            odds = forward[at] + message
            total += lengths[at] / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            message = carry(unary[at] + message, a00, a10, a01, a11)
        return float(min(1.0, max(0.0, total / lengths.sum())))


def carry(z: float, a00: float, a01: float, a10: float, a11: float) -> float:
    """Log-odds of the next label, given log-odds z of this one."""
    return soft(a11 + z, a01) - soft(a10 + z, a00)


def soft(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def expectations(u: np.ndarray, t: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains of log-odds u: marginals of good, expected transitions, and log partition of each chain.

    ``there`` marks the lines of a chain; they come first.
    """
    longest = u.shape[1]
    forward, backward, scale = np.zeros_like(u), np.zeros_like(u), np.zeros_like(u)
    forward[:, 0] = u[:, 0]
    for i in range(1, longest):
        z = forward[:, i - 1]
        bad = np.logaddexp(t[1, 0] + z, t[0, 0])
        forward[:, i] = u[:, i] + np.logaddexp(t[1, 1] + z, t[0, 1]) - bad
        scale[:, i] = np.where(there[:, i], bad, 0)
    for i in range(longest - 2, -1, -1):
        z = u[:, i + 1] + backward[:, i + 1]
        backward[:, i] = np.where(there[:, i + 1], np.logaddexp(t[1, 1] + z, t[1, 0]) - np.logaddexp(t[0, 1] + z, t[0, 0]), 0)
    good = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    left, right = forward[:, :-1], (u + backward)[:, 1:]
    joint = np.stack([np.broadcast_to(t[0, 0], left.shape), t[0, 1] + right, t[1, 0] + left, t[1, 1] + left + right])
    joint = np.exp(joint - joint.max(0))
    joint = joint / joint.sum(0) * there[:, 1:]
    last = there.sum(1) - 1
    partition = scale.sum(1) + np.logaddexp(0, forward[np.arange(len(u)), last])
    return good * there, joint.sum((1, 2)), partition


def slope(theta: np.ndarray, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the documents' labels up to a constant, and its gradient: marginals under the labels less free ones."""
    w, t = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    u = x @ w
    shift = EVIDENCE * (2 * y[:, None] - 1)
    free, free_moves, free_total = expectations(u, t, there)
    held, held_moves, held_total = expectations(u + shift, t, there)
    gradient = np.concatenate([np.tensordot(held - free, x, ((0, 1), (0, 1))), held_moves - free_moves])
    return float((held_total - free_total).sum()), gradient


def fit(chains: list[tuple[np.ndarray, int]]) -> Field:
    """Maximum likelihood with a ridge, by Adam over all chains at once; ``chains`` are (features, document's label)."""
    everything = np.concatenate([x for x, _ in chains]).astype(np.float64)
    mean, scale = everything.mean(0), everything.std(0)
    mean[scale < 1e-9] = 0
    scale[scale < 1e-9] = 1
    mean[-1], scale[-1] = 0, 1  # the constant feature
    cut = [((x[i : i + CHAIN] - mean) / scale, y) for x, y in chains for i in range(0, len(x), CHAIN)]
    longest = max(len(x) for x, _ in cut)
    x = np.zeros((len(cut), longest, WIDTH), np.float32)
    there = np.zeros((len(cut), longest), bool)
    for row, (own, _) in enumerate(cut):
        x[row, : len(own)] = own
        there[row, : len(own)] = True
    y = np.array([label for _, label in cut])
    theta, first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for epoch in range(1, EPOCHS + 1):
        gradient = slope(theta, x, y, there)[1] / there.sum() - RIDGE * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return Field(mean, scale, theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def spread_chains(x: np.ndarray, most: int = TRAIN_CHAINS) -> np.ndarray:
    """The lines of at most ``most`` chains, evenly spread over a document."""
    if len(x) <= most * CHAIN:
        return x
    starts = np.linspace(0, len(x) - CHAIN, most).astype(int)
    return np.concatenate([x[s : s + CHAIN] for s in starts])


def train(docs: DataFrame, labels: DataFrame, docs_bound: int = TRAIN_DOCS) -> Field | None:
    """Fit on ``docs (doc_id, text)`` with ``labels (doc_id, label)`` 0 or 1; None where no labelled text has a line.

    The labelled ids with the least hashes are taken, at most ``docs_bound``,
    and of their rows the ``docs_bound`` with the least hashes of id and text: an
    id that repeats has no more weight than its hash gives it.  Null ids and
    labels are left out; of several labels of one id the greatest counts.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_bound)
    order = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(order.alias("order"), F.col("label").cast("int").alias("label"), "text")
    # The limit applies in each task first; a row then holds at most TRAIN_CHAINS chains of numbers.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("order"))).filter(F.col("place") <= docs_bound).drop("place")

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spread_chains(line_features(t.as_py() or "")[0]).astype("<f4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["order", "label", "x"])

    limit_batches(docs.sparkSession)
    sample = rows.mapInArrow(described, "order bigint, label int, x binary").orderBy("order").limit(docs_bound).toArrow()
    chains = [(np.frombuffer(x, "<f4").reshape(-1, WIDTH), int(label)) for label, x in zip(sample.column(1).to_pylist(), sample.column(2).to_pylist(), strict=True) if x]
    chains.sort(key=lambda c: (c[1], len(c[0]), c[0].tobytes()))  # in an order that partitions cannot change
    return fit(chains) if chains else None


def score(docs: DataFrame, model: Field | None) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1; other columns pass through (one named score is replaced).

    Null texts and texts without lines score 0, as does everything without a
    model.  Repeated rows and equal texts score alike, whatever their ids.
    """
    docs = docs.drop("score")
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [own.score(t.as_py()) if own is not None else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(judge, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
