"""Nearest neighbours by multiprobe p-stable hashing with exact reranking.

A table hashes a vector by ``floor((a . x + b) / width)`` for a few Gaussian
directions ``a``; Gaussian sums are 2-stable, so near vectors fall into the
same or neighbouring buckets.  A query visits, besides its own bucket, those
that differ by one step in some directions, in falling order of estimated
success: the sum of squared distances to the borders to be crossed, taken from
a heap.  The candidates of all tables are reranked by exact distance.

The index is fitted on a bounded sample (``SAMPLE`` vectors by hash of their
id): the mean, the spread that sets the width, and the number of probes, which
grows until the sample's own true neighbours are found at ``TARGET`` recall.
Every vector is indexed.  Structured data need few probes; isotropic data need
many.  Where ``MOST_PROBES`` do not reach the target, probing is given up and all
queries are answered by an exact scan, in blocks.

Buckets are dealt to cells, whose number follows the input.  A query travels
once to each cell that holds a bucket it probes, meets the members bucket by
bucket as a matrix product, and leaves with its best few; candidate pairs never
become rows.  Equal vectors are one entry with their smallest ids.  The fullest
bucket sets over how many cells the entries of a bucket spread, and queries come
in as many waves as keep those that meet in a cell few; so neither copies nor a
full bucket nor many queries fill a task.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import buckets_for, materialize

TABLES, DIRECTIONS, WIDTH = 4, 8, 2.0
SAMPLE, SAMPLE_QUERIES, TARGET, MOST_PROBES = 4096, 128, 0.95, 1024
#: Entries of a cell, entries of one bucket in a cell, and queries that meet in a cell.
CELL_ENTRIES, BUCKET_ENTRIES, CELL_QUERIES = 40_000, 10_000, 20_000
#: Queries that one exact scan answers, and those of a matrix product.
SCAN_QUERIES, SCAN_ROWS = 10_000, 500
RESULT = "query_id bigint, vec_id bigint, score double"


@dataclass
class Index:
    mean: np.ndarray
    directions: np.ndarray  # (tables, dimension, directions)
    shift: np.ndarray
    width: float
    #: 0 where no number of probes reaches the target.
    probes: int

    def places(self, x: np.ndarray) -> np.ndarray:
        """Real-valued positions (tables, vectors, directions), in units of the width."""
        return (np.einsum("nd,tdk->tnk", x - self.mean, self.directions) + self.shift[:, None, :]) / self.width

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """A 64-bit key of whole-number positions (..., directions)."""
        key = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
        for k in range(cells.shape[-1]):
            key = (key ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        return key


def probe_steps(place: np.ndarray, probes: int) -> np.ndarray:
    """The first ``probes`` step vectors (-1, 0, 1 in each direction) for a position, likeliest first."""
    part = place - np.floor(place)
    k = len(part)
    cost = np.concatenate([part, 1 - part]) ** 2
    order = np.argsort(cost, kind="stable").tolist()
    z = cost[order].tolist()
    found, heap = [()], [(z[0], (0,))]
    while heap and len(found) < probes:
        total, chosen = heapq.heappop(heap)
        crossed = [order[c] for c in chosen]
        if len({c % k for c in crossed}) == len(crossed):
            found.append(tuple(crossed))
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - z[last] + z[last + 1], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + z[last + 1], chosen + (last + 1,)))
    steps = np.zeros((len(found), k), np.int64)
    for row, crossed in enumerate(found):
        for c in crossed:
            steps[row, c % k] = -1 if c < k else 1
    return steps


def fit(sample: np.ndarray, seed: int = 5, tables: int = TABLES, directions: int = DIRECTIONS) -> Index:
    """Fit on sampled vectors; the sample is thinner than the input, so its neighbours are farther and recall there is a cautious estimate.

    A sample too small to tell gives 0 probes: an exact scan is cheap there.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    a = rng.standard_normal((tables, sample.shape[1], directions))
    spread = float(np.std(np.einsum("nd,tdk->tnk", sample - mean, a))) or 1.0
    index = Index(mean, a, rng.random((tables, directions)) * WIDTH * spread, WIDTH * spread, 1)
    queries = min(SAMPLE_QUERIES, len(sample))
    if len(sample) < 12:
        index.probes = 0
        return index
    centred = sample - mean
    q = centred[:queries]
    apart = (q**2).sum(1)[:, None] + (centred**2).sum(1) - 2 * q @ centred.T
    apart[np.arange(queries), np.arange(queries)] = np.inf
    near = np.argpartition(apart, 10, axis=1)[:, :10]
    places = index.places(sample)
    whole = np.floor(places).astype(np.int64)
    base = 3 ** np.arange(directions)
    first = np.full(near.shape, MOST_PROBES, np.int64)  # the probe at which each neighbour is met
    for t in range(tables):
        for i in range(queries):
            step = whole[t, near[i]] - whole[t, i]
            codes = {c: n for n, c in reversed(list(enumerate(((probe_steps(places[t, i], MOST_PROBES) + 1) * base).sum(1).tolist())))}
            for j in np.flatnonzero((np.abs(step) <= 1).all(1)):
                first[i, j] = min(first[i, j], codes.get(int(((step[j] + 1) * base).sum()), MOST_PROBES))
    index.probes = 1
    while index.probes and (first < index.probes).mean() < TARGET:
        index.probes = min(int(index.probes * 1.5) + 1, MOST_PROBES) if index.probes < MOST_PROBES else 0
    return index


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)``: distinct rows with an id and a finite non-zero vector without nulls."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def best(query_ids: np.ndarray, q: np.ndarray, entries: list[np.ndarray], x: np.ndarray, keep: int, centre: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The nearest ``keep`` ids of each query among entries.

    A centred matrix product rules out only what lies farther than the
    ``keep + 1`` nearest by more than its rounding error; exact differences decide.
    """
    y, p = x - centre, q - centre
    norms = (y**2).sum(1)
    rough = norms - 2 * (p @ y.T)
    if len(x) > keep + 1:
        error = 4 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt((p**2).sum(1)) + np.sqrt(norms.max())) ** 2
        least = np.partition(rough, keep, axis=1)[:, keep] + error
    else:
        least = np.full(len(q), np.inf)
    for row, query_id in enumerate(query_ids.tolist()):
        near = np.flatnonzero(rough[row] <= least[row])
        exact = np.sqrt(((x[near] - q[row]) ** 2).sum(1))
        found = sorted((s, i) for s, at in zip(exact.tolist(), near.tolist(), strict=True) for i in entries[at].tolist() if i != query_id)[:keep]
        for score, vec_id in found:
            yield query_id, vec_id, score


def cell_best(rows: pd.DataFrame, keep: int, centre: np.ndarray) -> pd.DataFrame:
    members = rows[rows["members"].notna()]
    asking = rows[rows["members"].isna()]
    found: dict[int, dict[int, float]] = defaultdict(dict)
    if len(members) and len(asking):
        x = np.stack(members["v"].to_numpy())
        q = np.stack(asking["v"].to_numpy())
        ids = asking["query_id"].to_numpy(np.int64)
        entries = members["members"].tolist()
        bucket = np.array([b[0] for b in members["buckets"]], np.int64)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        probing: dict[int, list[int]] = defaultdict(list)
        for row, own in enumerate(asking["buckets"]):
            for b in own:
                probing[int(b)].append(row)
        for name, start, end in zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if visitors := probing.get(name):
                at = order[start:end]
                for query_id, vec_id, score in best(ids[visitors], q[visitors], [entries[i] for i in at], x[at], keep, centre):
                    own = found[query_id]
                    own[vec_id] = score
                    if len(own) > 8 * keep:
                        found[query_id] = dict(sorted(own.items(), key=lambda e: (e[1], e[0]))[:keep])
    out = [(query_id, vec_id, score) for query_id, own in found.items() for score, vec_id in sorted((s, i) for i, s in own.items())[:keep]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each row of ``queries`` among the other rows of ``vectors``.

    Ties go to the smaller id; if there are no more than k others, all are
    found.  Rows without an id or with a vector that is null, empty, zero or
    not finite take no part.  Repeated rows count once.  Vectors of another
    dimension than the most common one, queries that meet fewer than k
    candidates, and all queries where probing cannot reach its target are
    answered by an exact scan among the vectors of their dimension.
    """
    spark: SparkSession = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # Of equal vectors, only the k + 1 smallest ids can be among a query's k nearest; the limit applies before the shuffle.
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = rows.withColumn("_place", place).filter(F.col("_place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("members"))
    entries = materialize(entries, "entries")
    asked = materialize(usable(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id").distinct(), "asked")
    sizes = entries.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("members")).alias("ids")).orderBy(F.desc("n"), "d").head()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    usual = F.size("v") == sizes["d"]
    sample = entries.filter(usual).orderBy(F.xxhash64(F.get("members", F.lit(0)))).limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
    index = fit(np.array([r["v"] for r in sample]), seed)
    found = probed(entries.filter(usual), asked.filter(usual), index, sizes["n"], k) if index.probes else None
    left = asked
    if found is not None:
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id")
        left = asked.filter(~usual).unionByName(asked.filter(usual).join(enough, "query_id", "left_anti"))
    exact = scanned(entries, materialize(left, "left"), k)
    found = found.unionByName(exact).distinct() if found is not None and exact is not None else exact if found is None else found
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def probed(entries: DataFrame, asked: DataFrame, fitted: Index, n: int, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: each cell's nearest of each query that visits it."""
    spark = entries.sparkSession
    index = spark.sparkContext.broadcast(fitted)
    cells = buckets_for(TABLES * n, CELL_ENTRIES, spark.sparkContext.defaultParallelism)

    def bucketed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = index.value
                keys = own.keys(np.floor(own.places(np.stack(batch["v"].to_numpy()))))
                yield pd.DataFrame({"bucket": keys.view(np.int64).ravel()})

    fullest = entries.select("v").mapInPandas(bucketed, "bucket bigint").groupBy("bucket").count().agg(F.max("count").alias("most"))
    spread = -(-materialize(fullest, "fullest").head()["most"] // BUCKET_ENTRIES)
    meeting = asked.count() * min(1.0, TABLES * fitted.probes * spread / cells)
    waves = max(1, math.ceil(meeting / CELL_QUERIES))

    def cell_of(key: np.ndarray, part: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(17)) * np.uint64(0x94D049BB133111EB) + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(cells)

    def indexed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index.value
        for batch in batches:
            if len(batch):
                keys = own.keys(np.floor(own.places(np.stack(batch["v"].to_numpy()))))
                part = np.array([m[0] % spread for m in batch["members"]], np.uint64)
                for key in keys:
                    cell, buckets = cell_of(key, part).astype(np.int64), [[k] for k in key.view(np.int64).tolist()]
                    for wave in range(waves):
                        yield pd.DataFrame({"cell": cell * waves + wave, "query_id": None, "members": batch["members"], "buckets": buckets, "v": batch["v"]})

    def probing(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index.value
        for batch in batches:
            for query_id, v in zip(batch["query_id"].tolist(), batch["v"], strict=True):
                places = own.places(v[None, :])[:, 0]
                visits: dict[int, list[int]] = defaultdict(list)
                for t in range(len(places)):
                    keys = own.keys(np.floor(places[t]).astype(np.int64) + probe_steps(places[t], own.probes))
                    for part in range(spread):
                        for cell, key in zip(cell_of(keys, np.full(len(keys), part, np.uint64)).tolist(), keys.view(np.int64).tolist(), strict=True):
                            visits[cell * waves + query_id % waves].append(key)
                yield pd.DataFrame({"cell": list(visits), "query_id": query_id, "members": None, "buckets": list(visits.values()), "v": [v] * len(visits)})

    schema = "cell bigint, query_id bigint, members array<bigint>, buckets array<bigint>, v array<double>"
    dealt = entries.mapInPandas(indexed, schema).unionByName(asked.mapInPandas(probing, schema))
    return materialize(dealt.groupBy("cell").applyInPandas(lambda rows: cell_best(rows, k, index.value.mean), RESULT).distinct(), "found")


def scanned(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """Exact neighbours of the given queries (a stored table), SCAN_QUERIES of them against all entries at a time; None without queries."""
    spark = entries.sparkSession
    blocks = -(-asked.count() // SCAN_QUERIES)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(max(1, blocks))))
    found = []
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).select("query_id", "v").collect()  # SCAN_QUERIES rows, more or less
        by_size: dict[int, list] = defaultdict(list)
        for r in rows:
            by_size[len(r["v"])].append(r)
        queries = {d: (np.array([r["query_id"] for r in own], np.int64), np.array([r["v"] for r in own])) for d, own in by_size.items()}
        shared = spark.sparkContext.broadcast(queries)

        def scan(batches: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                lengths = batch["v"].map(len)
                for d, (ids, q) in shared.value.items():
                    own = batch[lengths == d]
                    if len(own):
                        x, members = np.stack(own["v"].to_numpy()), own["members"].tolist()
                        for at in range(0, len(ids), SCAN_ROWS):
                            part = slice(at, at + SCAN_ROWS)
                            yield pd.DataFrame(best(ids[part], q[part], members, x, k, x.mean(0)), columns=["query_id", "vec_id", "score"])

        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        nearest_few = entries.select("members", "v").mapInPandas(scan, RESULT).distinct().withColumn("place", place).filter(F.col("place") <= k).drop("place")
        found.append(materialize(nearest_few, "scanned"))
    return reduce(DataFrame.unionByName, found) if found else None
