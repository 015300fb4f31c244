"""Dictionaries: lexicon tables from word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import ALLCAP, HUHCAP, HUHINITCAP, captype, decode_flags, field, init_upper, lower_cp
from lexiforge.sources.affix import ONLY_UPCASE, AffixConfig
from lexiforge.sources.lines import read_lines


def read_dictionary(spark: SparkSession, path: str, config: AffixConfig, dict_no: int = 0, key: str | None = None) -> DataFrame:
    """A lexicon from a dictionary file: a count line, then ``word[/flags][ fields]``.

    The first line is the count and no entry; entries may begin with a digit.
    ``\\/`` is a slash within a word.  Entries keep the order of the file, which
    is in the affix file's character set and may be compressed, under ``key``.
    """
    return parse_entries(read_lines(spark, path, config.charset, key), config, dict_no)


def parse_entries(lines: DataFrame, config: AffixConfig, dict_no: int = 0) -> DataFrame:
    """A lexicon from ``(entry_id, value)`` lines; line 0 is left out if it begins with a number, as the count does."""
    line = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "[\r\n]+$", "")
    split = r"^((?:\\/|[^/\t ]| (?!\S{2}:))+)(?:/(\S*))?(?:[\t ]+(.*))?$"
    part = lambda k: F.regexp_extract(line, split, k)
    count = (F.col("entry_id") == 0) & F.regexp_like(line, F.lit(r"^\s*\d"))
    rows = lines.filter(~count & ~F.regexp_like(line, F.lit(r"^\s*$"))).select(
        "entry_id", F.replace(F.trim(part(1)), F.lit("\\/"), F.lit("/")).alias("word"), part(2).alias("flag_text"), F.trim(part(3)).alias("morph")
    )
    return lexicon(rows.filter("word <> ''"), config, dict_no)


def lexicon(rows: DataFrame, config: AffixConfig, dict_no: int = 0) -> DataFrame:
    """Complete ``(entry_id, word[, flag_text][, morph])`` to a lexicon table.

    Characters that the affix file ignores are left out of words.  Mixed-case
    words, and all-capitals ones with flags, are also stored with an initial
    capital only, for words in capitals.
    """
    if ignored := config.texts.get("IGNORE"):
        rows = rows.withColumn("word", F.translate("word", ignored, ""))
    text = F.col("flag_text") if "flag_text" in rows.columns else F.lit("")
    if config.flag_aliases:
        table = F.array(*[F.array(*[F.lit(f) for f in a]).cast("array<int>") for a in config.flag_aliases])
        flags = F.coalesce(F.get(table, F.try_to_number(text, F.lit("99999")).cast("int") - 1), F.array().cast("array<int>"))
    else:
        flags = decode_flags(text, config.flag_mode)
    morph = F.coalesce(F.col("morph"), F.lit("")) if "morph" in rows.columns else F.lit("")
    base = rows.select(F.col("entry_id").cast("bigint").alias("entry_id"), F.lit(dict_no).alias("dict_no"), "word", F.length("word").alias("clen"), captype(F.col("word")).alias("captype"), flags.alias("flags"), morph.alias("morph"), F.lit(False).alias("hidden"))
    hides = F.col("captype").isin(HUHCAP, HUHINITCAP) | ((F.col("captype") == ALLCAP) & (F.size("flags") > 0))
    plain = ~F.array_contains("flags", config.forbidden)
    hidden = base.filter(hides & plain).withColumns({"word": init_upper(lower_cp(F.col("word"))), "flags": F.array_append("flags", ONLY_UPCASE), "hidden": F.lit(True)})
    shown = base.select(F.col("word").alias("_word")).distinct()
    hidden = hidden.join(shown, F.col("word") == F.col("_word"), "left_anti").withColumn("captype", captype(F.col("word")))
    return base.unionByName(hidden)


def phonetic_replacements(lexicon_df: DataFrame) -> DataFrame:
    """Replacement rows from ``ph:`` fields: ``(pattern, replacement)``; ``a->b`` is a pair, a trailing ``*`` drops the last letter of both."""
    each = lexicon_df.select("word", F.explode(field(F.col("morph"), "ph")).alias("ph"))
    pair = F.split("ph", "->", 2)
    arrow = F.size(pair) == 2
    star = ~arrow & F.endswith(F.col("ph"), F.lit("*"))
    cut = lambda w, k: F.substr(w, F.lit(1), F.greatest(F.length(w) - k, F.lit(0)))
    pattern: Column = F.when(arrow, F.get(pair, F.lit(0))).when(star, cut(F.col("ph"), 2)).otherwise(F.col("ph"))
    out: Column = F.when(arrow, F.get(pair, F.lit(1))).when(star, cut(F.col("word"), 1)).otherwise(F.col("word"))
    return each.select(pattern.alias("pattern"), out.alias("replacement")).filter("pattern <> '' AND pattern <> replacement").distinct()


def union_dictionaries(*lexicons: DataFrame) -> DataFrame:
    """Several dictionaries under one affix file, searched in order."""
    found = lexicons[0].withColumn("dict_no", F.lit(0))
    for number, more in enumerate(lexicons[1:], 1):
        found = found.unionByName(more.withColumn("dict_no", F.lit(number)))
    return found
