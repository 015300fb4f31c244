"""Replacement rules applied to words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Place of replacements in the order of generators.
REPLACE = 1


def _to(n: Column) -> Column:
    """1..n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def replaced(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``(w, op, i, j, candidate)``: each occurrence of each rule's pattern replaced, in the order of rules and positions.

    Rules meet words on the pattern's first character, not on all pairs.
    """
    starts = words.select("w", F.explode(F.array_distinct(F.filter(F.split("w", ""), lambda c: c != ""))).alias("c"))
    keyed = rules.filter("pattern <> ''").withColumn("c", F.substring("pattern", 1, 1))
    met = starts.join(keyed, "c").filter(F.contains(F.col("w"), F.col("pattern")))
    n, size = F.length("w"), F.length("pattern")
    fits = lambda i: (F.substr(F.col("w"), i, size) == F.col("pattern")) & (~F.col("at_start") | (i == 1)) & (~F.col("at_end") | (i + size == n + 1))
    each = met.select("*", F.explode(F.filter(_to(n - size + 1), fits)).alias("at"))
    out = F.concat(F.expr("left(w, at - 1)"), F.col("replacement"), F.substr(F.col("w"), F.col("at") + size))
    return each.select("w", F.lit(REPLACE).alias("op"), F.col("rule_no").alias("i"), F.col("at").alias("j"), out.alias("candidate"))
