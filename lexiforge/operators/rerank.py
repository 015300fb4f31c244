"""What is shown for a word: automatic replacement, priorities and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import GREEK_VOWELS, distance, fold, lower_cp, syllables

#: Edit distance below which a transliterated word is replaced, and text length beyond which one slot fewer is shown (fixed values).
NEAR, LONG_TEXT = 3.0, 5


def should_replace(text: Column, native: Column, guess: Column, vowels: str = GREEK_VOWELS) -> Column:
    """Whether a guess may replace what was typed.

    Native text only gains accents: two syllables or more, equal without
    accents, none in the text and some in the guess; a guess with capitals is
    compared without case.  Transliterated text is replaced by anything near.
    """
    bare, bare_guess = fold(text), fold(guess)
    accented = bare_guess != guess
    cased = (lower_cp(bare) == lower_cp(bare_guess)) & accented & (lower_cp(bare) == lower_cp(text))
    exact = (bare == bare_guess) & accented & (bare == text)
    in_native = (syllables(text, vowels) >= 2) & F.when(guess != lower_cp(guess), cased).otherwise(exact)
    return F.when(text == native, in_native).otherwise(distance(guess, native) < NEAR)


def rerank(suggestions: DataFrame, common: DataFrame, vowels: str = GREEK_VOWELS) -> DataFrame:
    """``(text, native, priority, second, listed)`` from ``(text, native, rank, suggestion)``.

    Native text: the first suggestion that may replace it has priority.
    Transliterated text: the first common word has, unless a later perfect
    match takes its place and makes it second.  ``common (word)`` are distinct.
    """
    marked = suggestions.join(common.select(F.col("word").alias("_common")).distinct(), lower_cp(F.col("suggestion")) == F.col("_common"), "left")
    compared = F.when(syllables(F.col("native"), vowels) < 2, lower_cp(F.col("suggestion"))).otherwise(fold(lower_cp(F.col("suggestion"))))
    at = F.struct("rank", "suggestion")
    native = F.col("text") == F.col("native")
    found = marked.groupBy("text", "native").agg(
        F.min(F.when(native & should_replace(F.col("text"), F.col("native"), F.col("suggestion"), vowels), at))["suggestion"].alias("accent"),
        F.min(F.when(~native & F.col("_common").isNotNull(), at))["suggestion"].alias("frequent"),
        F.min(F.when(~native & (lower_cp(F.col("native")) == compared), at))["suggestion"].alias("perfect"),
        F.transform(F.array_sort(F.collect_list(at)), lambda s: s["suggestion"]).alias("listed"),
    )
    second = F.when(F.col("perfect").isNotNull() & (F.col("frequent") != F.col("perfect")), F.col("frequent"))
    return found.select("text", "native", F.coalesce("accent", "perfect", "frequent").alias("priority"), second.alias("second"), "listed")


def slots(reranked: DataFrame, vowels: str = GREEK_VOWELS) -> DataFrame:
    """``(text, slot, shown, verbatim, will_replace)``: what was typed, then two or three suggestions without repeats."""
    most = F.when(F.length("text") > LONG_TEXT, 2).otherwise(3)
    wanted = F.array_distinct(F.filter(F.concat(F.array("priority", "second"), "listed"), lambda s: s.isNotNull()))
    shown = reranked.select("text", "native", F.concat(F.array("text"), F.slice(wanted, F.lit(1), F.least(most, F.size("listed")))).alias("all"))
    each = shown.select("text", "native", F.posexplode("all").alias("slot", "shown"))
    replace = (F.col("slot") == 1) & should_replace(F.col("text"), F.col("native"), F.col("shown"), vowels)
    return each.select("text", "slot", "shown", (F.col("slot") == 0).alias("verbatim"), replace.alias("will_replace"))


def first_words(turns: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """Words of running text with ``first``: whether a word opens a sentence; each row starts one."""
    sentences = turns.select(*key, order, F.posexplode(F.split(text, "[.!?…]")).alias("sentence", "part"))
    words = sentences.select(*key, order, "sentence", F.posexplode(F.regexp_extract_all("part", F.lit(r"\p{L}+"), F.lit(0))).alias("place", "word"))
    return words.withColumn("first", F.col("place") == 0)


def top_common(tokens: DataFrame, most: int) -> DataFrame:
    """The most frequent words, ties by spelling: ``(word, n)``."""
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(most)
