"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  Within a source, a document's
expected number of copies is proportional to its measure, the bit length of its
size, up to the limit; what the limit cuts off goes to the others, so that the
expected words are the target.  The whole part is allocated with certainty.
Its fraction is the document's inclusion probability: documents are ranked by
random odds over inclusion odds and taken in that order until the source's
remaining words are met.

The ranking never sorts a source in one task.  The rank key is mapped to
[0, 1) and cut into bins; word counts by source and bin tell how many words lie
before a bin, and only within a bin are documents ordered.  All that is kept of a
source is a row for each measure, some forty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import WORD, buckets_for, materialize, md5_int, release

WEIGHTS = (3, 1, 2)
#: The least number of bins of a source's ranking, and documents to a bin where there are many.
BINS, BIN_ROWS = 4096, 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float, limit: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target words of each source: ``(source, source_size, target)``.

    ``share`` times all words are dealt by weight; a target stops at ``limit``
    times its source's size and the excess goes to the others by weight until
    none is above.  The fixed point has one water level: sources whose ratio of
    limit to weight is below it are full, the others hold level times weight.
    Sources are one row each here; the window runs over them alone.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full_before"),
        F.sum("weight").over(rest).alias("weight_rest"),
    ).withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    found = leveled.withColumn("water", level)
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return found.select("source", "source_size", target.alias("target"))


def measure(size: Column) -> Column:
    """What a document's inclusion probability is proportional to: the bit length of its words plus one."""
    return F.length(F.bin(size + 1))


def clipped(odds: Column) -> Column:
    return F.least(F.greatest(odds, F.lit(1e-9)), F.lit(1 - 1e-9))


def rank_key(doc_id: Column, text_hash: Column, odds: Column, seed: int) -> Column:
    """Random odds over inclusion odds; rows of one id are told apart by their texts."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    u = (md5_int(F.lit(seed), named(doc_id), named(text_hash)) + F.lit(0.5)) / F.lit(float(16**13))
    p = clipped(odds)
    return (u / (1 - u)) / (p / (1 - p))


def shares(sized: DataFrame, goal: DataFrame, limit: float) -> DataFrame:
    """``(source, measure, source_size, target, whole, odds, remaining)``: certain copies and inclusion probability by source and measure.

    The expected copies ``min(limit, level * measure)`` have one level a source,
    found as for targets: from the largest measure down, the first at which the
    level that spends the rest of the target keeps it within the limit.
    ``remaining`` are the source's words beyond the certain copies.
    """
    by_measure = sized.groupBy("source", measure(F.col("size")).alias("measure")).agg(F.sum("size").alias("words"))
    goal = goal.withColumnRenamed("source", "_source")
    known = by_measure.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    down = Window.partitionBy("source").orderBy(F.desc("measure"))
    whole_source = Window.partitionBy("source")
    spent = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(limit))
    rest = F.sum(F.col("words") * F.col("measure")).over(down.rowsBetween(0, Window.unboundedFollowing))
    known = known.withColumn("level", F.try_divide(F.col("target") - spent, rest.cast("double")))
    fits = F.when(F.col("level") * F.col("measure") <= F.lit(float(limit)), F.struct((-F.col("measure")).alias("m"), "level"))
    known = known.withColumn("level", F.min(fits).over(whole_source)["level"])
    copies = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("level").isNull(), F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), F.col("level") * F.col("measure")))
    known = known.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("int"))
    remaining = F.greatest(F.col("target") - F.sum(F.col("words") * F.col("whole")).over(whole_source), F.lit(0.0))
    return known.select("source", "measure", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("odds"), remaining.alias("remaining"))


def sample_copies(sized: DataFrame, share: DataFrame, max_copies: int = 2, seed: int = 23) -> DataFrame:
    """``(doc_id, source, size, text_hash, source_size, target, whole, odds, copies)`` of ``sized (doc_id, source, size, text_hash)``, a stored table.

    Rows alike in id, size and text are interchangeable.  Sources without words
    have target 0 and no copies.
    """
    docs = sized.withColumn("measure", measure(F.col("size"))).withColumnRenamed("source", "_source")
    docs = docs.join(share.withColumnRenamed("measure", "_measure"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("measure") == F.col("_measure"))).drop("_source", "_measure")
    docs = docs.withColumn("q", rank_key(F.col("doc_id"), F.col("text_hash"), F.col("odds"), seed))
    # Within a source, scaling by its common odds keeps the order and spreads the bins evenly.
    bins = buckets_for(sized.count(), BIN_ROWS, BINS)
    common = clipped(F.when(F.col("source_size") > 0, F.col("remaining") / F.col("source_size")).otherwise(F.lit(0.0)))
    docs = docs.withColumn("scaled", F.col("q") * common / (1 - common))
    docs = docs.withColumn("bin", F.least(F.floor(F.col("scaled") / (1 + F.col("scaled")) * F.lit(bins)), F.lit(bins - 1)).cast("int"))
    keyed = docs.withColumns({"no_source": F.col("source").isNull(), "named": F.coalesce("source", F.lit(""))})
    binned = keyed.groupBy("no_source", "named", "bin").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("no_source", "named").orderBy("bin")
    binned = binned.withColumn("before", F.sum("words").over(up) - F.col("words")).drop("words")
    ranked = keyed.join(binned, ["no_source", "named", "bin"])
    within = Window.partitionBy("no_source", "named", "bin").orderBy("q", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = F.when((F.col("whole") < max_copies) & (F.col("size") > 0) & (start + F.col("size") / 2 <= F.col("remaining")), 1).otherwise(0)
    return ranked.select("doc_id", "source", "size", "text_hash", "source_size", "target", "whole", "odds", (F.col("whole") + extra).alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("text_hash")), "sized")


def draw(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 23) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows not taken are absent.

    The rows taken beyond the certain copies are a prefix of their source's
    ranking, so each source's last place decides every document where it stands
    and texts are not shuffled.  A place is rank key, id, size and text hash:
    rows of one id are told apart by their texts, and those of equal text are
    taken alike.  Columns pass through whatever their names.
    """
    sized = sizes(docs)
    by_measure = materialize(shares(sized, targets(sized, share, limit, weights), limit), "shares")
    mixed = sample_copies(sized, by_measure, int(limit), seed)
    place = lambda doc_id, odds, size, text_hash: F.struct(rank_key(doc_id, text_hash, odds, seed).alias("q"), doc_id.alias("doc_id"), size.alias("size"), text_hash.alias("text_hash"))
    taken = F.when(F.col("copies") > F.col("whole"), place(F.col("doc_id"), F.col("odds"), F.col("size"), F.col("text_hash")))
    last = mixed.groupBy("source").agg(F.max(taken).alias("last"))
    last = materialize(last.withColumnRenamed("source", "source_of"), "last")
    known = materialize(by_measure.join(last, F.col("source").eqNullSafe(F.col("source_of"))).select("source", "measure", "whole", "odds", "last"), "known")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"size": word_count(F.col("row.text")), "text_hash": F.md5(F.col("row.text").cast("binary"))})
    met = rows.join(known, F.col("row.source").eqNullSafe(F.col("source")) & (measure(F.col("size")) == F.col("measure")))
    own = place(F.col("row.doc_id"), F.col("odds"), F.col("size"), F.col("text_hash"))
    more = (F.col("last").isNotNull() & (F.col("size") > 0) & (F.col("whole") < int(limit)) & (own <= F.col("last"))).cast("int")
    counted = met.select("row", (F.col("whole") + more).alias("copies")).filter("copies > 0")
    release(sized)
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_sources(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 23) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of each document.

    A null text has size 0; a null source is a source of its own, ordered last.
    """
    sized = sizes(docs)
    mixed = sample_copies(sized, shares(sized, targets(sized, share, limit, weights), limit), int(limit), seed)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
