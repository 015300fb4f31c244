"""A Merkle manifest of a dataset, with an authentication path for every row.

Each group of rows (a language) is a tree of arity 8 over its leaves in order;
the groups' roots are the leaves of one more tree.  A tree is cut into aligned
blocks of ``8 ** BLOCK_LEVELS`` leaves.  Within a block, paths come from a
fractal traversal: the block's levels are stacked subtrees of ``SUBTREE``
levels; of each layer the existing subtree, which holds the present leaf's
path, and the desired one after it are kept, and the desired one grows by one
leaf for every path that is emitted, so that it is ready when its turn comes.
A task holds one block's digests and these subtrees, whatever the input.

Above blocks there is one digest a block.  Runs of eight are joined level by
level in DataFrames, and the siblings met on the way are handed down again, so
each block learns its upper path.  Texts are hashed where they are read and
never shuffled.

Rows alike in group, order, leaf and claim are one row with a count until their
block emits them, so copies meet in no single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import materialize
from lexiforge.llm.shard import number_rows

ARITY, BLOCK_LEVELS, SUBTREE = 8, 4, 2
BLOCK = ARITY**BLOCK_LEVELS
STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row, in lower-case hexadecimal."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(n: int) -> int:
    """Levels between ``n`` leaves and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Subtree:
    """A subtree of one layer, grown leaf by leaf.

    ``rows[k]`` are its nodes ``k`` levels above its lowest row.  Below that row
    only the open run of each level is held.
    """

    def __init__(self, leaves: list[str], layer: int, number: int, levels: int):
        self.leaves, self.low, self.top = leaves, layer * SUBTREE, min((layer + 1) * SUBTREE, levels)
        span = ARITY ** ((layer + 1) * SUBTREE)
        self.at, self.end = number * span, min((number + 1) * span, len(leaves))
        self.rows: list[list[str]] = [[] for _ in range(self.top - self.low + 1)]
        self.open: list[list[str]] = [[] for _ in range(self.top)]

    def grow(self) -> None:
        """Take in one more leaf, if there is one."""
        if self.at < self.end:
            self.put(0, self.leaves[self.at])
            self.at += 1

    def put(self, level: int, digest: str) -> None:
        if level >= self.low:
            self.rows[level - self.low].append(digest)
        if level < self.top:
            self.open[level].append(digest)
            if len(self.open[level]) == ARITY:
                self.close(level)

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.put(level + 1, joined(run))

    def finished(self) -> Subtree:
        while self.at < self.end:
            self.grow()
        for level in range(self.top):  # short runs at the end of the block
            if self.open[level]:
                self.close(level)
        return self


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[list[str], list[str]]]]:
    """For each leaf in turn its siblings before and after it, level by level."""
    layers = -(-levels // SUBTREE)
    existing = [Subtree(leaves, s, 0, levels).finished() for s in range(layers)]
    desired = [Subtree(leaves, s, 1, levels) for s in range(layers - 1)]
    number = [0] * layers
    for at in range(len(leaves)):
        path = []
        for level in range(levels):
            layer = level // SUBTREE
            tree = existing[layer]
            own = at // ARITY**level - number[layer] * ARITY ** ((layer + 1) * SUBTREE - level)
            first = own - own % ARITY
            row = tree.rows[level - tree.low]
            path.append((row[first:own], row[own + 1 : first + ARITY]))
        yield path
        for layer in range(layers - 1):
            desired[layer].grow()
            if (at + 1) % ARITY ** ((layer + 1) * SUBTREE) == 0:
                number[layer] += 1
                existing[layer] = desired[layer].finished()
                desired[layer] = Subtree(leaves, layer, number[layer] + 1, levels)


def block_root(leaves: list[str], levels: int) -> str:
    for _ in range(levels):
        leaves = [joined(leaves[i : i + ARITY]) for i in range(0, len(leaves), ARITY)]
    return leaves[0]


def fold(digest: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a digest and the siblings of its path lead to."""
    for before, after in path:
        digest = joined([*before, digest, *after])
    return digest


def spread_out(rows: pa.Table) -> tuple[pa.Table, int]:
    """A block's rows in order, one for each copy, and the levels of the block."""
    rows = rows.sort_by("_start")
    rows = rows.take(pa.array(np.repeat(np.arange(len(rows)), rows["_many"].to_numpy())))
    return rows, min(BLOCK_LEVELS, height(rows["_n"][0].as_py()))


def block_roots(rows: pa.Table) -> pa.Table:
    rows, levels = spread_out(rows)
    return pa.table({"tree": [rows["_tree"][0].as_py()], "idx": [rows["_block"][0].as_py()], "digest": [block_root(rows["_leaf"].to_pylist(), levels)]})


def number_leaves(rows: DataFrame) -> DataFrame:
    """``rows (_group, _order, _leaf, _claim, _copies)`` with ``_tree``, ``_n`` and ``_first``: the group's number and size, and the place in it.

    Rows are dealt into key ranges; a place is the copies before it in its range
    and those of its group in the ranges before.
    """
    order = [F.col(c).asc_nulls_first() for c in ("_order", "_leaf", "_claim")]
    ranged = materialize(rows.repartitionByRange(F.col("_group").asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id()), "leaves")
    sizes = ranged.groupBy("_group", "_range").agg(F.sum("_copies").alias("_size"))
    # At most one row for each range and each group.
    own = Window.partitionBy("_group")
    before = sizes.select("_group", "_range", (F.sum("_size").over(own.orderBy("_range")) - F.col("_size")).alias("_before"), F.sum("_size").over(own).alias("_n"))
    trees, _ = number_rows(sizes.select("_group").distinct(), ["_group"], "_tree")
    trees = trees.withColumnRenamed("_group", "_named")
    before = before.join(trees, F.col("_group").eqNullSafe(F.col("_named"))).drop("_named")
    before = materialize(before.withColumnsRenamed({"_group": "_of", "_range": "_in"}), "groups")
    running = F.sum("_copies").over(Window.partitionBy("_group", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies")
    placed = ranged.withColumn("_running", running).join(before, F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    return placed.withColumn("_first", F.col("_running") + F.col("_before")).drop("_of", "_in", "_range", "_running", "_before")


def levels_above(n: Column, least: int) -> Column:
    """Levels of a tree of ``n`` leaves above the lowest ``least``: ``height(n) - least``, or 0."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(21)])
    return F.greatest(F.size(F.filter(powers, lambda p: p < n)) - least, F.lit(0))


def climb(nodes: DataFrame) -> DataFrame:
    """``(tree, idx, root, steps)`` of each of ``nodes (tree, idx, digest, up)``, a stored table; ``up`` levels lead to its tree's root.

    ``steps`` are the joined siblings before and after it on each level.  Every
    level is one aggregation to an eighth of the rows, written, so the work is a
    few passes over one row a block.
    """
    most = nodes.agg(F.max("up").alias("up")).head()["up"] or 0
    current, runs = nodes, []
    for k in range(most):
        kids = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        run = current.filter(F.col("up") > k).groupBy("tree", "up", F.floor(F.col("idx") / ARITY).alias("parent")).agg(kids.alias("kids"))
        run = materialize(run.withColumn("digest", F.sha2(F.array_join(F.col("kids")["digest"], ""), 256)), "runs")
        runs.append(run)
        current = run.select("tree", F.col("parent").alias("idx"), "digest", "up").unionByName(current.filter(F.col("up") <= k))
    ended = current.select("tree", F.lit(0).cast("bigint").alias("idx"), F.col("digest").alias("root"), F.array().cast(STEPS).alias("steps"), "up")
    paths = ended.filter(F.col("up") == most)
    for k in reversed(range(most)):
        each = runs[k].select("tree", "parent", F.posexplode("kids").alias("at", "kid"), "kids")
        side = lambda start, many: F.array_join(F.slice(F.col("kids")["digest"], start, many), "")
        step = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.size("kids")).alias("after"))
        above = paths.withColumnsRenamed({"idx": "parent"})
        below = each.select("tree", "parent", F.col("kid")["idx"].alias("idx"), step.alias("step")).join(above, ["tree", "parent"])
        below = below.select("tree", "idx", "root", F.concat(F.array("step"), "steps").alias("steps"), "up")
        paths = below.unionByName(ended.filter(F.col("up") == k))
    return paths.drop("up")


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf", claim: str | None = None, siblings: bool = False) -> DataFrame:
    """``(group, order, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row for each row; with ``siblings`` also the path itself.

    Leaves ascend by ``order``, nulls first, ties by leaf digest.  Groups
    ascend, null first.  ``claim`` is a column with the digest that a holder of
    the row brings forward (the leaf itself if null or not given):
    ``folded_root`` is what it leads to with the row's siblings, ``verified``
    whether that is the root.  ``proof_sha256`` is the digest of the joined
    siblings, of nothing for a row that is alone.  Repeated rows are leaves each;
    other columns are ignored; an empty table gives an empty manifest.
    """
    own = F.col(leaf)
    claimed = F.coalesce(F.col(claim), own) if claim else own
    alike = rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), own.alias("_leaf"), F.when(claimed != own, claimed).alias("_claim"))
    alike = alike.groupBy("_group", "_order", "_leaf", "_claim").agg(F.count(F.lit(1)).alias("_copies"))
    placed = number_leaves(alike)
    last = F.col("_first") + F.col("_copies") - 1
    floor = lambda x: F.floor(x / F.lit(BLOCK)).cast("bigint")
    dealt = placed.select("*", F.explode(F.sequence(floor(F.col("_first")), floor(last))).alias("_block"))
    start = F.greatest("_first", F.col("_block") * BLOCK)
    dealt = dealt.withColumns({"_start": start, "_many": F.least(last, F.col("_block") * BLOCK + BLOCK - 1) - start + 1}).drop("_first", "_copies")
    dealt = materialize(dealt, "dealt")

    blocks = dealt.select("_tree", "_block", "_start", "_many", "_n", "_leaf").groupBy("_tree", "_block").applyInArrow(block_roots, "tree bigint, idx bigint, digest string")
    sizes = dealt.groupBy(F.col("_tree").alias("tree")).agg(F.max("_n").alias("n"))
    blocks = materialize(blocks.join(sizes, "tree").select("tree", "idx", "digest", levels_above(F.col("n"), BLOCK_LEVELS).alias("up")), "blocks")
    in_tree = materialize(climb(blocks), "upper")
    roots = in_tree.filter("idx = 0").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("digest"))
    roots = materialize(roots.withColumn("up", levels_above(F.lit(roots.count()), 0)), "subroots")
    at_top = climb(roots).select(F.col("idx").alias("tree"), F.col("root").alias("top"), F.col("steps").alias("last_steps"))
    upper = in_tree.join(at_top, "tree").select(F.col("tree").alias("_tree"), F.col("idx").alias("_block"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("steps", "last_steps").alias("steps"))
    upper = materialize(upper, "upper-paths")

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, levels = spread_out(rows)
        above = above.to_pylist()[0]
        steps = [([s["before"]], [s["after"]]) for s in above["steps"]]
        upper_text = "".join(s["before"] + s["after"] for s in above["steps"])
        upper_list = [upper_text[i : i + 64] for i in range(0, len(upper_text), 64)]
        proofs, folded, paths = [], [], []
        leaves, claims = rows["_leaf"].to_pylist(), rows["_claim"].to_pylist()
        for path, leaf, claim in zip(traverse(leaves, levels), leaves, claims, strict=True):
            own = [d for before, after in path for part in (before, after) for d in part]
            proofs.append(joined([*own, upper_text]))
            folded.append(fold(fold(leaf if claim is None else claim, path), steps))
            if siblings:
                paths.append(own + upper_list)
        n = len(rows)
        out = [rows["_group"], rows["_order"], rows["_leaf"], [above["subroot"]] * n, [above["root"]] * n, proofs, folded, [f == above["root"] for f in folded]]
        names = [group, order, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table([*out, pa.array(paths, pa.list_(pa.string()))] if siblings else out, [*names, "siblings"] if siblings else names)

    kinds = {f.name: f.dataType.simpleString() for f in alike.schema}
    schema = f"`{group}` {kinds['_group']}, `{order}` {kinds['_order']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return dealt.groupBy("_tree", "_block").cogroup(upper.groupBy("_tree", "_block")).applyInArrow(prove, schema + (", siblings array<string>" if siblings else ""))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, leaf, claim)`` of documents; the claim of those whose id's CRC-32 is a multiple of 3 is that of a text in lower case (A-Z alone)."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return docs.select("doc_id", "lang", digest(F.col("text")).alias("leaf"), F.when(tampered, digest(lowered)).alias("claim"))
