"""Exact Jaccard self-join of word shingles with adaptive multi-match prefixes.

Two documents link when their shingle sets' Jaccard similarity reaches a
threshold.  If both order their shingles alike, linked sets share at least L
shingles within their first ``n - ceil(t * n) + L`` ones, for any L (the
L-prefix).  Which order is free, so rare shingles come first: by heat (the
binary logarithm of document frequency, 0 for the rare majority) and then by
hash.  Heat is read from a table of fixed size, in which a collision only moves
a shingle in the order of all documents alike and so cannot lose a link.

L adapts to each document.  One whose prefix holds frequent shingles would meet
many candidates; its prefix is lengthened while that lowers the estimated cost,
and a pair is a candidate only if it shares min(L, L') prefix shingles.

No group of copies is expanded into pairs:

1. documents with equal sets are one node;
2. within each prefix shingle's group, all nodes are compared with the group's
   first node (a star); found links are joined into components;
3. the same is done around another member of each group that still holds
   several components;
4. then only pairs of different components are compared, and of those at least
   one lies outside the group's largest component.  A parity bitmap of each set
   bounds the symmetric difference from below and ends most comparisons inside
   the join.

What is compared exactly carries its whole set of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import materialize, release
from lexiforge.llm.components import connected_components, joined_components

#: Entries of the heat table (one byte each), and the most that may be filled.
HEAT_BITS = 24
HEAT_FILL = 1 << (HEAT_BITS - 3)
#: The least document frequency that counts as warm, over the first COUNTED times a prefix of each document.
WARM, COUNTED = 2, 1.5
#: L is at most this, or this part of the prefix that any document needs.
LONGEST_L, LONGEST_PART = 12, 1 / 3
#: Costs of indexing a shingle, of reading a list entry and of comparing a candidate of 50 shingles, relative to each other.
COST = (1.0, 0.25, 4.0)
#: Candidates expected of a shingle that is not known to be warm.
EXPECTED = 0.05
BITMAP_WORDS = 8
#: Shingles are counted and grouped in as many slices by hash, one after the other, so that the disk holds the shuffle of one.
SLICES = 4
#: Shingles up to which one slice holds all: each slice is a query, which the driver plans and keeps.
ONE_SLICE = 4_000_000
#: Pairs of a shingle's group that meet in one task.
TASK_PAIRS = 1_000_000
#: Documents whose ids are broadcast to fetch their sets (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - width + 1 + i])
    return np.unique(total)


def need(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any partner: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def described(batches: Iterable[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, key, node, n, bitmap words and the first shingles by hash, whose frequency is counted."""
    for batch in batches:
        nodes, sizes, maps, prefixes, ends = [], [], [], [], [0]
        for text in batch.column(1):
            own = shingle_set(text.as_py(), k)
            n = len(own)
            nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
            sizes.append(n)
            parity = np.bincount((own >> np.uint64(20)).astype(np.int64) & (64 * BITMAP_WORDS - 1), minlength=64 * BITMAP_WORDS) & 1
            maps.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            prefixes.append(own[: min(n, int(COUNTED * (n - need(n, percent))) + 2)])
            ends.append(ends[-1] + len(prefixes[-1]))
        if not nodes:
            continue
        columns = np.stack(maps)
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(prefixes))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), *[pa.array(np.ascontiguousarray(columns[:, i])) for i in range(BITMAP_WORDS)], tokens],
            ["doc_id", "key", "node", "n", *[f"b{i}" for i in range(BITMAP_WORDS)], "tokens"],
        )


def adapted(warmth: np.ndarray, n: int, percent: int) -> int:
    """The L of least estimated cost; ``warmth`` is heat in prefix order.

    Comparing costs as much as the document is long, so long documents ask for
    more shared shingles.
    """
    base = n - need(n, percent)
    most = min(max(LONGEST_L, int(LONGEST_PART * base)), need(n, percent))
    heat = warmth[: base + most].astype(np.float64)
    lists = np.cumsum(np.where(heat > 0, np.exp2(heat), EXPECTED))
    levels = np.arange(1, most + 1)
    read = lists[base + levels - 1]
    return int(levels[np.argmin(COST[0] * (base + levels) + COST[1] * read + COST[2] * n / 50 * read / levels)])


def prefix_lists(batches: Iterable[pa.RecordBatch], k: int, percent: int, heat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """node, l, and the prefix shingles: those known to be warm apart from the others."""
    seen: set[bytes] = set()  # a shortcut for copies within a task; others are dropped later
    mask = np.uint64(len(heat) - 1)
    empty = np.empty(0, np.uint64)
    for batch in batches:
        nodes, levels, lists, ends = [], [], ([], []), ([0], [0])
        for text in batch.column(0):
            own = shingle_set(text.as_py(), k)
            n = len(own)
            if not n:
                continue
            node = xxhash.xxh3_128_digest(own.tobytes())
            if node in seen:
                continue
            if len(seen) < 100_000:
                seen.add(node)
            warmth = heat[(own & mask).astype(np.int64)]
            order = np.argsort(warmth, kind="stable")
            warmth = warmth[order]
            level = adapted(warmth, n, percent)
            length = n - need(n, percent) + level
            first, cold = own[order[:length]], int(np.searchsorted(warmth[:length], 1))
            nodes.append(node)
            levels.append(level)
            for part, tokens, end in zip((first[:cold], first[cold:]), lists, ends, strict=True):
                tokens.append(part)
                end.append(end[-1] + len(part))
        if nodes:
            columns = [pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(signed(np.concatenate([*tokens, empty])))) for tokens, end in zip(lists, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(levels, pa.int32()), *columns], ["node", "l", "cold", "warm"])


def whole_sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py(), k) for text in batch.column(0)]
        nodes, sizes, maps = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [len(s) for s in sets], [parity_map(s).tobytes() for s in sets]
        owns = pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), owns], ["node", "n", "map", "own"])


def parity_map(own: np.ndarray) -> np.ndarray:
    """Bytes of a parity bitmap with 4 to 8 bits a shingle; XOR of its halves is the map of half the size."""
    bits = max(64, 4 << len(own).bit_length())
    parity = np.bincount((own >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8))


def near(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose maps, folded to one size, don't rule a link out."""
    for batch in batches:
        keep = []
        for x, y, total in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            while len(a) != len(b):
                half = max(len(a), len(b)) // 2
                a, b = (m if len(m) <= half else m[:half] ^ m[half:] for m in (a, b))
            keep.append(int(np.bitwise_count(a ^ b).sum()) * (100 + percent) <= total.as_py() * (100 - percent))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def linked(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def slices(rows: DataFrame, many: int) -> list[DataFrame]:
    if many == 1:
        return [rows]
    return [rows.filter(F.pmod(F.col("token"), F.lit(many)) == i) for i in range(many)]


def heat_table(described_docs: DataFrame, sliced: int) -> np.ndarray:
    """Binary logarithms of document frequency, by the low bits of the shingle's hash.

    At most HEAT_FILL shingles are entered: the frequency from which a shingle
    counts as warm doubles until they fit.
    """
    counts = [rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= WARM) for rows in slices(described_docs.select(F.explode("tokens").alias("token")), sliced)]
    first, *more = [c.select("token", F.floor(F.log2("df")).cast("int").alias("heat")) for c in counts]
    warm = materialize(first, "warm", *more)
    by_heat = {r["heat"]: r["many"] for r in warm.groupBy("heat").agg(F.count(F.lit(1)).alias("many")).collect()}  # at most 64 rows
    least = min(by_heat, default=0)
    while sum(many for heat, many in by_heat.items() if heat >= least) > HEAT_FILL:
        least += 1
    slot = F.col("token").bitwiseAND(F.lit((1 << HEAT_BITS) - 1))
    found = warm.filter(F.col("heat") >= least).groupBy(slot.alias("slot")).agg(F.max("heat").alias("heat")).toArrow()  # at most HEAT_FILL rows
    release(warm)
    table = np.zeros(1 << HEAT_BITS, np.uint8)
    table[found.column("slot").to_numpy()] = found.column("heat").to_numpy()
    return table


def possible(percent: int, a: str, b: str) -> Column:
    """False only where sizes or bitmaps rule a link out."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}b{i}").bitwiseXOR(F.col(f"{b}b{i}"))) for i in range(BITMAP_WORDS)), F.lit(0))
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    # |A ^ B| <= (100 - p) / (100 + p) * (|A| + |B|)
    return sizes & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def side(df: DataFrame, prefix: str, columns: list[str], *cell: Column) -> DataFrame:
    return df.select("token", *[c.alias("cell") for c in cell], *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, spent: list[DataFrame] | None = None) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that link, by their whole sets.

    Maps of a size in proportion to the set go first, so that few sets are sent
    to pairs that don't link.  ``spent`` tables are released once the pairs are
    written.  Without pairs nothing more is planned.
    """
    pairs = materialize(pairs, "pairs")
    release(*spent or [])
    if pairs.isEmpty():
        return pairs
    parts = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    found = wanted = materialize(nodes.join(parts, "node").select(F.col("first_id").alias("_wanted")), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(lambda it: whole_sets(it, k), "node binary, n int, map binary, own binary"), "sets")  # repeated ids repeat links, no more

    def beside(left: DataFrame, end: str, *columns: str) -> DataFrame:
        return left.join(sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)

    mapped = beside(beside(pairs, "a", "n", "map"), "b", "n", "map").select("a", "b", "a_map", "b_map", (F.col("a_n") + F.col("b_n")).alias("total"))
    close = materialize(mapped.mapInArrow(lambda it: near(it, percent), "a binary, b binary"), "near")
    both = beside(beside(close, "a", "own"), "b", "own").select("a", "b", "a_own", "b_own")
    links = materialize(both.mapInArrow(lambda it: linked(it, percent), "a binary, b binary"), "links")
    release(pairs, found, sets, close)
    return links


def similar_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each row of ``docs (doc_id, text)``.

    component_id is the smallest doc_id reachable by links.  Null texts and
    texts without words have no shingles and stand alone, with their own
    doc_id.  Rows with equal sets link, repeated rows too; null doc_ids take
    the smallest other id of their component, or null.  An empty table gives an
    empty result.
    """
    rows = component_rows(docs, k, percent, F.lit(None).cast("bigint"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def component_rows(docs: DataFrame, k: int, percent: int, key: Column) -> DataFrame:
    """``(doc_id, key, n_shingles, lead)`` of each row of ``docs (doc_id, text)``.

    ``key`` is a bigint made of the text that tells the rows of one id apart.
    ``lead`` is the struct (no_id, doc_id, key) of the component's first row: by
    doc_id, null last, then by key.  It is null where there are no shingles.
    """
    spark: SparkSession = docs.sparkSession
    keyed, docs = docs.select("doc_id", "text", key.alias("key")), docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = ", ".join(f"b{i} bigint" for i in range(BITMAP_WORDS))
    known = materialize(keyed.mapInArrow(lambda it: described(it, k, percent), f"doc_id {kind}, key bigint, node binary, n int, {words}, tokens array<bigint>"), "described")
    shingles = known.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    sliced = SLICES if shingles > ONE_SLICE else 1
    heat = spark.sparkContext.broadcast(heat_table(known, sliced))
    bits = [f"b{i}" for i in range(BITMAP_WORDS)]
    nodes = materialize(
        known.filter("n > 0")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first_row"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in bits]),
        "nodes",
    )
    own_ids = materialize(known.select("doc_id", "key", "node", F.col("n").cast("bigint").alias("n_shingles")), "ids")
    release(known)

    # Each text is hashed once for its prefix, stored as two lists of 8 bytes a shingle.
    prefixes = materialize(docs.select("text").mapInArrow(lambda it: prefix_lists(it, k, percent, heat.value), "node binary, l int, cold array<bigint>, warm array<bigint>"), "prefixes")
    heat.destroy()

    # A shingle's group counts if it has two nodes.  Groups of rare shingles are
    # small; those of warm ones are counted before they meet.  A group of two rows
    # is one pair: it becomes one row, whose token is null.
    by_token = Window.partitionBy("token")
    ends_of = {"lead": F.min("node"), "last": F.max("node"), "least": F.min("l"), "many": F.count(F.lit(1))}
    two = F.col("many") == 2
    counted = ~two | (F.col("node") == F.col("lead"))
    row = [F.when(~two, F.col("token")).alias("token"), "node", F.when(two, F.col("least")).otherwise(F.col("l")).alias("l"), "lead", F.when(two, F.col("last")).alias("last")]
    parts = []
    for cold, warm in zip(slices(prefixes.select("node", "l", F.explode("cold").alias("token")), sliced), slices(prefixes.select("node", "l", F.explode("warm").alias("token")), sliced), strict=True):
        cold = cold.select("*", *[of.over(by_token).alias(c) for c, of in ends_of.items()]).filter(F.col("lead") < F.col("last"))
        ends = warm.groupBy("token").agg(*[of.alias(c) for c, of in ends_of.items()]).filter(F.col("lead") < F.col("last"))
        # Dealt by both keys, so that a frequent shingle's rows may be split before; the rare ones lie as they are needed.
        met = warm.join(ends, "token").filter(counted).repartition("token", "node")
        parts.append(cold.filter(counted).dropDuplicates(["token", "node"]).select(*row).unionByName(met.dropDuplicates(["token", "node"]).select(*row)))
    found = materialize(parts[0], "shared", *parts[1:])
    release(prefixes)
    # Texts that share a passage share many groups of two, so these are added up a pair.
    twos = materialize(found.filter(F.col("token").isNull()).groupBy(F.col("lead").alias("a"), F.col("last").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min("l").alias("least")), "twos")
    shared = found.filter(F.col("token").isNotNull()).select("token", "node", "l", "lead")

    # Stars: every node against the first node of each of its groups.
    facts = ["node", "n", *bits]
    # Only those that share enough groups with the same first node; the others are left to the pairs below.
    lead_l = shared.filter(F.col("node") == F.col("lead")).select("token", F.col("l").alias("lead_l"))
    met = shared.filter(F.col("node") > F.col("lead")).join(lead_l, "token")
    met = met.groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.least(F.min("l"), F.min("lead_l")).alias("least"))

    def enough(rows: DataFrame) -> DataFrame:
        return rows.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).filter(F.col("shared") >= F.col("least")).select("a", "b")

    def possible_pairs(pairs: DataFrame) -> DataFrame:
        columns = pairs.columns
        for s in ("a", "b"):
            pairs = pairs.join(nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in facts]), F.col(s) == F.col(f"{s}_node"))
        return pairs.filter(possible(percent, "a_", "b_")).select(*columns)

    # A pair that is compared here, or ruled out, is settled and met no more.
    settled = materialize(enough(met.unionByName(twos)), "settled")
    links = verified(possible_pairs(settled), docs, nodes, k, percent)
    parts = connected_components(links)
    release(links)

    def open_groups(parts: DataFrame, tag: str) -> DataFrame:
        """Members of groups that still hold several components, with each group's largest one."""

        def of(rows: DataFrame) -> DataFrame:
            known_parts = rows.select("token", "node", "l").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
            tally = known_parts.groupBy("token", "part").agg(F.count(F.lit(1)).alias("many"))
            pairs = (F.sum("many") - F.max("many")) * F.sum("many")
            cells = F.least(F.ceil(pairs / F.lit(TASK_PAIRS)), F.sum("many") - F.max("many")).cast("int").alias("cells")
            main = tally.groupBy("token").agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.count(F.lit(1)).alias("parts"), cells).filter("parts > 1").drop("parts")
            return known_parts.join(main, "token").join(nodes.select(*facts), "node")

        first, *more = map(of, slices(shared, sliced))
        return materialize(first, tag, *more)

    # A second round of stars, around another member in each group: who is not near the first node
    # is mostly near some other member, and one found link is enough.  Groups of two have no other member.
    left = open_groups(parts, "open-stars")
    around = left.groupBy("token").agg(F.min(F.struct(F.xxhash64("token", "node").alias("order"), "node", "part", "n", *bits)).alias("c"))
    around = around.select("token", *[F.col(f"c.{c}").alias(f"a_{c}") for c in ("node", "part", "n", *bits)])
    tried = side(left, "b_", ["node", "part", "n", *bits]).join(around, "token").filter((F.col("a_part") != F.col("b_part")) & possible(percent, "a_", "b_"))
    tried = tried.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    tried = materialize(tried.join(settled, ["a", "b"], "left_anti"), "tried")
    parts = joined_components(parts, verified(tried, docs, nodes, k, percent, spent=[left]))

    # The rest: pairs of different components that share enough prefix shingles.  A group of many
    # pairs is dealt into cells: who is outside the main component into one each, everybody into all.
    left = open_groups(parts, "open")
    apart = twos.join(settled, ["a", "b"], "left_anti")
    for s in ("a", "b"):
        apart = apart.join(parts.select(F.col("node").alias(s), F.col("part").alias(f"{s}_part")), s, "left")
    apart = apart.filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b", "shared", "least")
    apart = materialize(possible_pairs(apart), "apart")
    release(found, twos)
    columns = ["node", "l", "part", "n", *bits]
    outside = side(left.filter(F.col("part") != F.col("main")), "a_", columns, F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    inside = side(left, "b_", [*columns, "main"], F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cross = outside.join(inside, ["token", "cell"]).filter(
        (F.col("a_part") != F.col("b_part")) & ((F.col("b_part") == F.col("b_main")) | (F.col("a_node") < F.col("b_node"))) & possible(percent, "a_", "b_")
    )
    least = F.least(F.min("a_l"), F.min("b_l"))
    ordered = cross.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), "a_l", "b_l")
    crossed = ordered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), least.alias("least"))
    candidates = enough(crossed.unionByName(apart)).join(settled.unionByName(tried), ["a", "b"], "left_anti")
    parts = joined_components(parts, verified(candidates, docs, nodes, k, percent, spent=[left, apart, settled, tried]))

    labeled = nodes.select("node", "first_row").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    first = labeled.groupBy("part").agg(F.min("first_row").alias("lead"))
    by_node = labeled.join(first, "part").select("node", "lead")
    # A node's id may be that of a third of all rows: its side is the small one, and the large side is split where skewed.
    return own_ids.join(by_node, "node", "left").select("doc_id", "key", "n_shingles", "lead")
