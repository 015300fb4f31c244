"""Changes to a lexicon, each giving a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.sources.affix import AffixConfig
from lexiforge.sources.dictionary import lexicon


def add(current: DataFrame, words: DataFrame, config: AffixConfig) -> DataFrame:
    """Add ``(word[, flag_text][, morph])``: words that are there lose a forbidden flag, others become entries."""
    named = words.select(F.col("word").alias("_word")).distinct()
    cleared = current.join(named.withColumn("_added", F.lit(True)), F.col("word") == F.col("_word"), "left")
    cleared = cleared.withColumn("flags", F.when(F.col("_added"), F.array_remove("flags", config.forbidden)).otherwise(F.col("flags"))).drop("_word", "_added")
    shown = current.filter("NOT hidden").select(F.col("word").alias("_word")).distinct()
    fresh = words.join(shown, F.col("word") == F.col("_word"), "left_anti").dropDuplicates(["word"])
    fresh = lexicon(fresh.withColumn("entry_id", F.xxhash64("word").bitwiseOR(F.lit(1 << 62))), config)
    return with_entries(cleared, fresh)


def with_entries(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both lexicons in one: visible entries take the place of hidden ones spelled alike, in whichever they stand."""
    shown = F.max(~F.col("hidden")).over(Window.partitionBy("word"))
    return current.unionByName(fresh).withColumn("_shown", shown).filter(~(F.col("hidden") & F.col("_shown"))).drop("_shown")


def add_with_affix(current: DataFrame, pairs: DataFrame, config: AffixConfig) -> DataFrame:
    """Add ``(word, example)`` with the example's flags; pairs whose example is absent or has no flags change nothing."""
    models = current.filter("NOT hidden").filter(F.size("flags") > 0).groupBy("word").agg(F.min_by("flags", "entry_id").alias("_flags")).withColumnRenamed("word", "example")
    found = pairs.select("word", "example").distinct().join(models, "example").select("word", "_flags").dropDuplicates(["word"])
    bare = lexicon(found.select("word", F.xxhash64("word").bitwiseOR(F.lit(1 << 62)).alias("entry_id")), config).filter("NOT hidden")
    return current.unionByName(bare.join(found, "word").withColumn("flags", F.col("_flags")).select(*current.columns))


def remove(current: DataFrame, words: DataFrame, config: AffixConfig) -> DataFrame:
    """Mark every homonym of the given words as forbidden."""
    named = words.select(F.col("word").alias("_word")).distinct().withColumn("_gone", F.lit(True))
    marked = current.join(named, F.col("word") == F.col("_word"), "left")
    return marked.withColumn("flags", F.when(F.col("_gone"), F.array_union("flags", F.array(F.lit(config.forbidden)))).otherwise(F.col("flags"))).drop("_word", "_gone")


def number_homonyms(current: DataFrame) -> DataFrame:
    """Add ``homonym_no``: the place of an entry among those spelled alike; hidden ones come last."""
    order = Window.partitionBy("word").orderBy("dict_no", "hidden", "entry_id")
    return current.withColumn("homonym_no", F.row_number().over(order) - 1)
