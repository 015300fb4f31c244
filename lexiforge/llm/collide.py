"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Unit vectors are projected on ``PROJECTIONS`` Gaussian directions.  On each, the
vectors of a cell are sorted and a query collides with those in a window around
its own value, ``REACH`` times as wide to each side as a pair at the threshold
is apart on average.  Collisions are counted for each pair; pairs with at least
``least`` of them are verified by their cosine in double precision.  ``least``
is calibrated on pairs planted exactly at the threshold, one from every vector:
the largest count that ``RECALL`` of them reach.

A pair that misses at most ``PROJECTIONS - least`` windows collides in all of at
least one of ``PROJECTIONS - least + 1`` groups of projections.  So vectors are
dealt, once for each group, into cells of a grid over that group's projections,
and a query visits the cells that its windows touch: nothing that passes the
count is lost, and only neighbours in some grid are ever compared.  The grid has
as many dimensions as the largest label needs for its cells to fit a task; a
small one needs none.  Cells that are full all the same are dealt into blocks
of members by blocks of queries.

A pair is judged where the query meets the member's own cell in the first group
in which all windows collide: in one place, so links are counted and never
become rows.  A task hands on each query's number of links and the few edges
that hold its components together.  Equal vectors of a label are one entry with
a count; rows are compared with no others.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm._common import materialize
from lexiforge.llm.components import connected_components

PROJECTIONS, REACH, RECALL = 24, 3.2, 0.999
SEED = 13
#: Vectors from which pairs are planted together.
TOGETHER = 2048
#: Vectors of a cell or block.
CELL = 5_000
NODE = "struct<vec_id:bigint,a:bigint,b:bigint>"
ROLES = "array<struct<m:int,q:int,member:boolean,query:boolean>>"


@dataclass(frozen=True)
class Plan:
    """The threshold cosine, half a window, collisions that a pair needs, and the dimensions of a grid."""

    cosine: float
    window: float
    least: int = PROJECTIONS - 2
    grid: int = 0

    @property
    def groups(self) -> list[np.ndarray]:
        """The projections of each group; a pair that passes the count collides in all of one of them."""
        return np.array_split(np.arange(PROJECTIONS), min(PROJECTIONS, PROJECTIONS - self.least + 1))


@lru_cache(maxsize=64)
def directions(d: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).standard_normal((d, PROJECTIONS))


def units(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest entry, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def planted(vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and each turned towards another of them until their cosine is the given one."""
    x = units(vectors)
    other = np.roll(x, 1, axis=0) + 1e-3 * np.random.default_rng(SEED).standard_normal(x.shape)
    side = other - (other * x).sum(1, keepdims=True) * x
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * units(side)


def reached(vectors: np.ndarray, plan: Plan) -> np.ndarray:
    """How many of the pairs planted from vectors, two dimensions or more, collide 0, 1, ... PROJECTIONS times."""
    x, y = planted(vectors, plan.cosine)
    a = directions(vectors.shape[1])
    return np.bincount((np.abs(x @ a - y @ a) <= plan.window).sum(1), minlength=PROJECTIONS + 1)


def settled(many: np.ndarray, plan: Plan) -> Plan:
    """The plan whose count RECALL of planted pairs reach; without pairs, two misses are allowed."""
    total = int(many.sum())
    if not total:
        return plan
    return Plan(plan.cosine, plan.window, max(1, int(np.searchsorted(np.cumsum(many), int((1 - RECALL) * total), "right"))))


def open_plan(cosine: float) -> Plan:
    return Plan(cosine, REACH * math.sqrt(2 - 2 * cosine))


def calibrate(vectors: np.ndarray, cosine: float) -> Plan:
    """The plan for vectors that are at hand."""
    plan = open_plan(cosine)
    return settled(reached(vectors, plan), plan) if len(vectors) > 1 and vectors.shape[1] > 1 else plan


def matrix(rows: pa.Table) -> np.ndarray:
    return rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def calibrate_all(entries: DataFrame, cosine: float) -> Plan:
    """The plan for all of ``entries``, by a pair planted from each vector of two dimensions or more.

    Vectors are dealt by their names, so the plan depends on nothing but them.
    """
    plan = open_plan(cosine)
    able = entries.filter("d > 1")
    buckets = -(-able.count() // TOGETHER)
    if not buckets:
        return plan

    def count(rows: pa.Table) -> pa.Table:
        found = reached(matrix(rows.sort_by([("a", "ascending"), ("b", "ascending")])), plan)
        return pa.table({"hits": pa.array(np.flatnonzero(found)), "many": pa.array(found[found > 0])})

    dealt = able.select("d", F.col("node")["a"].alias("a"), F.col("node")["b"].alias("b"), "v", F.pmod(F.xxhash64(F.col("node")["a"], F.col("node")["b"]), F.lit(buckets)).alias("bucket"))
    counts = dealt.groupBy("d", "bucket").applyInArrow(count, "hits bigint, many bigint").groupBy("hits").agg(F.sum("many").alias("many")).collect()  # at most PROJECTIONS + 1 rows
    many = np.zeros(PROJECTIONS + 1, np.int64)
    for r in counts:
        many[r["hits"]] = r["many"]
    return settled(many, plan)


def grid_size(entries: DataFrame, plan: Plan, largest: int) -> int:
    """Dimensions of the grid, where the largest label has ``largest`` vectors: the fewest for which its fullest cell fits a task."""
    if largest <= CELL:
        return 0
    group = plan.groups[0]

    def cells(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            unit = units(np.asarray(v, np.float64)[None, :])
            at = np.floor((unit @ directions(unit.shape[1]))[0][group] / (4 * plan.window)).astype(np.int64).tolist()
            out.append([hash(tuple(at[:dims])) for dims in range(1, len(at) + 1)])
        return pd.Series(out)

    each = entries.select("label", "d", F.posexplode(F.pandas_udf(cells, "array<bigint>")("v")).alias("at", "cell"))
    fullest = each.groupBy("label", "d", "at", "cell").agg(F.count(F.lit(1)).alias("many")).groupBy("at").agg(F.max("many").alias("most"))
    fit = [r["at"] + 1 for r in fullest.filter(F.col("most") <= CELL).collect()]  # at most PROJECTIONS rows
    return min(fit, default=len(group))


def visits(place: np.ndarray, plan: Plan, group: np.ndarray) -> list[int]:
    """Numbers of the cells of a group's grid that a query's windows touch, its own first; each once, should two have one number."""
    at = place[group[: plan.grid]]
    own, low, high = (np.floor(x / (4 * plan.window)).astype(np.int64).tolist() for x in (at, at - plan.window, at + plan.window))
    options = [[o, *(c for c in (lo, hi) if c != o)] for o, lo, hi in zip(own, low, high, strict=True)]
    return list(dict.fromkeys(hash(cell) for cell in itertools.product(*options)))


def visited_cells(vectors: pd.Series, plan: Plan) -> pd.Series:
    """For each vector and each group the cells to visit."""
    out = []
    for v in vectors:
        unit = units(np.asarray(v, np.float64)[None, :])
        place = (unit @ directions(unit.shape[1]))[0]
        out.append([visits(place, plan, g) for g in plan.groups])
    return pd.Series(out)


def collisions(sorts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How often each member is in a query's windows, given as places ``low..high`` in the sort by each projection."""
    counts = np.zeros(len(sorts[0]), np.int8)
    for order, start, end in zip(sorts, low.tolist(), high.tolist(), strict=True):
        counts[order[start:end]] += 1
    return counts


def cell_links(rows: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of one cell: rows that are queries, the copies that each is linked with here, and edges that join what is linked."""
    v = units(matrix(rows))
    is_member, is_query = rows["member"].to_numpy(), rows["query"].to_numpy()
    members, queries = np.flatnonzero(is_member), np.flatnonzero(is_query)
    size = rows["size"].to_numpy()
    group = rows["group"][0].as_py()
    places = v @ directions(v.shape[1])
    groups = plan.groups
    sorts, lows, highs = [], np.empty((PROJECTIONS, len(queries)), np.int64), np.empty((PROJECTIONS, len(queries)), np.int64)
    for k in range(PROJECTIONS):
        order = np.argsort(places[members, k], kind="stable")
        values = places[members[order], k]
        lows[k] = np.searchsorted(values, places[queries, k] - plan.window, "left")
        highs[k] = np.searchsorted(values, places[queries, k] + plan.window, "right")
        sorts.append(order)
    links = np.zeros(len(queries), np.int64)
    part = np.arange(len(rows))  # the component of each row, as far as it is known here
    edges: list[tuple[int, int]] = []
    for i, q in enumerate(queries.tolist()):
        near = members[collisions(sorts, lows[:, i], highs[:, i]) >= plan.least]
        near = near[near != q]
        if plan.grid and len(near):
            inside = np.abs(places[near] - places[q]) <= plan.window
            first = np.argmax(np.stack([inside[:, g].all(1) for g in groups]), axis=0)
            near = near[first == group]
        near = near[(v[near] * v[q]).sum(1) >= plan.cosine]
        if len(near):
            links[i] = size[near].sum()
            known, at = np.unique(part[near], return_index=True)
            fresh = known != part[q]
            if fresh.any():
                edges += [(q, int(m)) for m in near[at[fresh]]]
                part[np.isin(part, known)] = part[q]
    return queries, links, edges


def key(*parts: Column) -> list[Column]:
    """Two 64-bit hashes that name a vector of a label."""
    return [F.xxhash64(*parts, F.lit(1)), F.xxhash64(F.lit(2), *parts)]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors of one label and one length are linked where their cosine is at
    least ``cosine``; equal ones always are.  Null labels or ids, and vectors
    that are null, empty, zero or hold null or non-finite entries link with
    nothing: they are components of their own and kept.  Rows that repeat an id
    are vectors each, with the component of their own vector.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark: SparkSession = vectors.sparkSession
    number = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0), F.lit(False))
    able = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine
    a, b = key(F.col(label_col), F.col(vector_col))
    named = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.when(able, a).alias("a"), F.when(able, b).alias("b"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")
    )
    entries = named.filter("a IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("v").alias("v"))
    entries = materialize(entries.select("label", F.size("v").alias("d"), "size", F.struct("vec_id", "a", "b").alias("node"), "v"), "entries")
    found = judged(entries, cosine)
    parts = connected_components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    # Only what is linked or has copies needs to be told to its rows.
    told = entries.select("node", "size").join(links, "node", "left").join(parts.select("node", "part"), "node", "left")
    told = told.filter("size > 1 OR links > 0").select(
        F.col("node")["a"].alias("a"), F.col("node")["b"].alias("b"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce(F.col("part")["vec_id"], F.col("node")["vec_id"]).alias("component_id")
    )
    told = materialize(told, "told")
    rows = named.select("vec_id", "a", "b").join(told, ["a", "b"], "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("vec_id", id_col)


def judged(entries: DataFrame, cosine: float) -> DataFrame:
    """``(node, links, other)``, written: rows with ``other`` are edges, the rest count a query's links in one cell."""
    largest = entries.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0
    plan = calibrate_all(entries, cosine)
    plan = Plan(plan.cosine, plan.window, plan.least, grid_size(entries, plan, largest))
    dealt = entries.withColumns({"group": F.lit(0), "cell": F.lit(0).cast("bigint"), "own": F.lit(True)})
    if plan.grid:
        cells = F.pandas_udf(lambda v: visited_cells(v, plan), "array<array<bigint>>")
        visited = entries.select("*", F.posexplode(cells("v")).alias("group", "cells")).select("*", F.posexplode("cells").alias("at", "cell"))
        dealt = materialize(visited.withColumn("own", F.col("at") == 0).drop("cells", "at"), "dealt")
    # A full cell is dealt into blocks of its members by blocks of its queries.
    place = ["label", "d", "group", "cell"]
    full = dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select(*place, F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    blocked = dealt.join(full, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_query = F.transform(every, lambda m: F.struct(m.alias("m"), block.alias("q"), (F.col("own") & (m == block)).alias("member"), F.lit(True).alias("query")))
    as_member = F.transform(F.filter(every, lambda q: F.col("own") & (q != block)), lambda q: F.struct(block.alias("m"), q.alias("q"), F.lit(True).alias("member"), F.lit(False).alias("query")))
    placed = blocked.select(*place, "size", "node", "v", F.inline(F.concat(as_query, as_member).cast(ROLES)))

    def judge(rows: pa.Table) -> pa.Table:
        queries, links, edges = cell_links(rows, plan)
        hit = queries[links > 0]
        nodes = rows["node"]
        of = [*hit.tolist(), *[a for a, _ in edges]]
        other = [*[None] * len(hit), *[b for _, b in edges]]
        return pa.table({"node": nodes.take(pa.array(of, pa.int64())), "links": pa.array([*links[links > 0].tolist(), *[0] * len(edges)], pa.int64()), "other": nodes.take(pa.array(other, pa.int64()))})

    return materialize(placed.groupBy(*place, "m", "q").applyInArrow(judge, f"node {NODE}, links bigint, other {NODE}"), "judged")
