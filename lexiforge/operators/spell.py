"""Spelling verdicts: case cascade, numbers, break points and forbidden words, as joins on surface forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import ALLCAP, HUHCAP, HUHINITCAP, INITCAP, captype, clean_word, convert, fits, init_lower, init_upper, is_number, lower_cp, sharp_forms
from lexiforge.operators import compound
from lexiforge.sources.affix import ONLY_UPCASE, AffixConfig


def numbered(*forms: tuple[int, Column, Column | None]) -> Column:
    """``array<struct<variant_no, form>>`` of ``(number, form, condition)``; forms whose condition does not hold are left out."""
    every = [F.struct(F.lit(n).alias("variant_no"), form.alias("form")) if when is None else F.when(when, F.struct(F.lit(n).alias("variant_no"), form.alias("form"))) for n, form, when in forms]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


#: Variants up to this one have the word's own capitals.
AS_TYPED = 1


def case_variants(word: Column, sharps: bool = False, dots: Column | None = None) -> Column:
    """``array<struct<variant_no, form>>`` to try for a word, by its capitals.

    Where ``dots`` were cut from its end, forms are tried with a dot too, as
    abbreviations have.  With ``sharps``, SS in capitals may stand for sharp s.
    """
    kind = captype(word)
    low = lower_cp(word)
    capital = init_upper(low)
    dotted = lambda w: F.concat(w, F.lit("."))
    cut = F.lit(False) if dots is None else dots > 0
    after = F.locate("'", word)
    apostrophe = F.concat(F.substr(low, F.lit(1), after), init_upper(F.substr(low, after + 1)))
    own = [(0, word, None), (AS_TYPED, dotted(word), cut)]
    lowered = [(5, low, None), (6, dotted(low), cut), (7, dotted(capital), cut)]
    whole = numbered(*own, (2, apostrophe, after > 0), (3, init_upper(apostrophe), after > 0), (4, capital, None), *lowered)
    if sharps:
        read = sharp_forms(low)
        read = F.concat(read, F.transform(read, init_upper))
        read = F.concat(read, F.when(cut, F.transform(read, dotted)).otherwise(F.array().cast("array<string>")))
        whole = F.concat(whole, F.transform(read, lambda f, i: F.struct((i + 8).alias("variant_no"), f.alias("form"))))
    return F.when(kind == ALLCAP, whole).when(kind == INITCAP, numbered(own[0], *lowered)).otherwise(numbered(*own))


def suggestion_variants(word: Column, dotted: Column) -> Column:
    """``array<struct<variant_no, form>>`` for which suggestions are sought: as typed, with other capitals and, for an abbreviation in lower case, with its dot."""
    kind = captype(word)
    low = lower_cp(word)
    listed = lambda *forms: numbered(*[(i, f, None) for i, f in enumerate(forms)])
    return (
        F.when(kind == INITCAP, listed(word, low))
        .when(kind == ALLCAP, listed(low, init_upper(low)))
        .when(kind == HUHINITCAP, listed(word, init_lower(word), low, init_upper(low)))
        .when(kind == HUHCAP, listed(word, low))
        .otherwise(numbered((0, word, None), (1, init_upper(word), None), (2, F.concat(word, F.lit(".")), dotted)))
    )


def lookups(distinct: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For distinct ``(_w)``: all as cleaned, the best ``hit`` of those that have one, and those with a forbidden entry."""
    cleaned = distinct.withColumn("_c", cleaned_word(F.col("_w"), config)).select("_w", F.col("_c")["word"].alias("_clean"), F.col("_c")["dots"].alias("_dots"))
    forms_of = case_variants(F.col("_clean"), "CHECKSHARPS" in config.switches, F.col("_dots"))
    tried = cleaned.filter(fits(F.col("_clean")) & (F.col("_clean") != "")).select("_w", captype(F.col("_clean")).alias("_case"), F.inline(forms_of))
    usable = forms.select("surface", F.col("root").alias("_root"), F.col("kind").alias("_kind"), F.col("flags").alias("_flags"), "priority", "entry_id", "dict_no")
    hits = tried.join(usable, F.col("form") == F.col("surface")).filter(~F.array_contains("_flags", ONLY_UPCASE) | (F.col("_case") == ALLCAP))
    if config.flag("KEEPCASE"):
        hits = hits.filter((F.col("variant_no") <= AS_TYPED) | ~F.array_contains("_flags", config.flag("KEEPCASE")))
    if config.flag("ONLYINCOMPOUND"):
        hits = hits.filter(~F.array_contains("_flags", config.flag("ONLYINCOMPOUND")))
    if compound.enabled(config):
        left = tried.join(hits.select("_w").distinct(), "_w", "left_anti").withColumn("capital", F.col("_case").isin(INITCAP, ALLCAP))
        whole = compound.compounds(left.select(F.col("form").alias("word"), "capital"), forms, config).withColumnRenamed("word", "form")
        made = left.join(whole, ["form", "capital"]).select(
            "_w", "_case", "variant_no", "form", F.col("form").alias("surface"), F.get("roots", F.lit(0)).alias("_root"), F.lit("compound").alias("_kind"),
            F.array().cast("array<int>").alias("_flags"), F.lit(9).alias("priority"), "entry_id", F.lit(0).alias("dict_no"),
        )
        hits = hits.unionByName(made)
    best = hits.groupBy("_w").agg(F.min(F.struct("variant_no", "priority", "dict_no", "entry_id", "_root", "_kind", "_flags")).alias("hit"))
    barred = lexicon.filter(F.array_contains("flags", config.forbidden)).select(F.col("word").alias("form")).distinct()
    bad = tried.filter("variant_no = 0").join(barred, "form", "left_semi").select("_w", F.lit(True).alias("_bad"))
    return cleaned, best, bad


def noted(texts: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """``(text, ok, forbidden)`` of :func:`check` for those of distinct texts that are right or forbidden; the rest, often nearly all, are not joined back."""
    cleaned, best, bad = lookups(texts.select(F.col("text").alias("_w")), forms, lexicon, config)
    warned = F.array_contains(F.col("hit._flags"), config.flag("WARN")) if config.flag("WARN") and "FORBIDWARN" in config.switches else F.lit(False)
    kinds = best.select("_w", (~warned).alias("ok"), warned.alias("no")).unionByName(bad.select("_w", F.lit(False).alias("ok"), F.lit(True).alias("no")).withColumn("bad", F.lit(True)), True)
    kinds = kinds.unionByName(cleaned.filter(is_number(F.col("_clean"))).select("_w", F.lit(True).alias("ok"), F.lit(False).alias("no")), True)
    found = kinds.groupBy(F.col("_w").alias("text")).agg((F.max("ok") & ~F.max("no")).alias("ok"), F.coalesce(F.max("bad"), F.lit(False)).alias("forbidden"))
    return found.filter("ok OR forbidden")


def check(words: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig, column: str = "word") -> DataFrame:
    """``words`` with ``ok``, ``root``, ``kind``, ``forbidden`` and ``warn``.

    Words pass the input conversion and lose what the affix file ignores; those
    that end in dots are right without and, as abbreviations, with one.
    Numbers are right; null, empty and overlong words are wrong.  The first
    case variant that is a form decides the root; entries for words in capitals
    only count where the word is in capitals.  A word of which any exact entry
    is forbidden is wrong whatever else it could be.  Words without a form may be
    compounds (``kind`` compound, ``root`` of the first part).  Where the affix
    file forbids words with a warning, they are wrong.
    """
    words = words.drop("ok", "root", "kind", "forbidden", "warn")
    cleaned, best, bad = lookups(words.select(F.col(column).alias("_w")).filter("_w IS NOT NULL").distinct(), forms, lexicon, config)
    judged = cleaned.join(best, "_w", "left").join(bad, "_w", "left")
    verdict = judged.select(
        "_w",
        (~F.coalesce("_bad", F.lit(False)) & (F.col("hit").isNotNull() | is_number(F.col("_clean")))).alias("ok"),
        F.when(F.col("_bad").isNull(), F.col("hit._root")).alias("root"),
        F.when(F.col("_bad").isNull(), F.col("hit._kind")).alias("kind"),
        F.coalesce("_bad", F.lit(False)).alias("forbidden"),
        (F.array_contains(F.col("hit._flags"), config.flag("WARN")) if config.flag("WARN") else F.lit(False)).alias("warn"),
    )
    joined = words.join(verdict, F.col(column) == F.col("_w"), "left").drop("_w")
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    if "FORBIDWARN" in config.switches:
        joined = joined.withColumn("ok", F.col("ok") & ~F.col("warn"))
    return joined.select(*words.columns, false("ok"), "root", "kind", false("forbidden"), false("warn"))


def cleaned_word(word: Column, config: AffixConfig) -> Column:
    """``struct(word, dots)`` after input conversion, without ignored characters."""
    return clean_word(convert(word, config.input_conversion), config.texts.get("IGNORE", ""))


def break_pattern(breaks: list[str]) -> str:
    """A regular expression for the break points within a word."""
    inner = [b for b in breaks if not b.startswith("^") and not b.endswith("$")]
    return "|".join(f"\\Q{b}\\E" for b in sorted(inner, key=len, reverse=True))


#: The name of a word's whole stretch; the others are named by their ends.
WHOLE = 0


def check_with_breaks(words: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig, column: str = "word") -> DataFrame:
    """``(word, ok)`` of distinct words: right as a whole, or broken into right parts.

    A stretch of a word between break points is right if it is a form, if it is
    right without a break point that may be taken off its start or end, or if
    both sides of a break are.  A break is made at the first or second place of
    its kind in the stretch.  Ten or more break points are not tried.  Stretches
    (at most 55 a word) are judged as words, shorter before longer; the whole
    word is one of them, and each distinct one is looked up once.
    """
    distinct = words.select(F.col(column).alias("word")).filter("word IS NOT NULL").distinct()
    pattern = break_pattern(config.breaks)
    starts, ends = ([b.strip("^$") for b in config.breaks if (b.startswith("^") if at_start else b.endswith("$")) and len(b) > 1] for at_start in (True, False))
    if not pattern:
        pattern = "|".join(f"\\Q{b}\\E" for b in {*starts, *ends}) or "(?!)"
    known = F.col("word")
    cut = lambda df: df.select("*", F.split(known, pattern, -1).alias("parts"), F.regexp_extract_all(known, F.lit(pattern), F.lit(0)).alias("marks")).withColumn("n", F.size("parts"))
    breakable = (F.size("marks") > 0) & (F.size("marks") < 10)
    # Stretches i..j of parts, by length; a number names each.
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), lambda d: F.transform(F.sequence(F.lit(0), F.col("n") - d), lambda i: F.struct(i.alias("i"), (i + d).alias("j")))))
    between = F.flatten(F.zip_with("parts", "marks", lambda p, m: F.array(p, F.coalesce(m, F.lit("")))))
    text = lambda x: F.array_join(F.slice(between, 2 * x["i"] + 1, 2 * (x["j"] - x["i"]) - 1), "")
    name = lambda i, j: i * 16 + j
    whole = F.struct(F.lit(WHOLE).alias("name"), known.alias("text"))
    named = F.filter(F.transform(spans, lambda x: F.struct(name(x["i"], x["j"]).alias("name"), text(x).alias("text"))), lambda x: x["name"] != F.col("n"))
    stretches = cut(distinct).select("word", F.inline(F.when(breakable, F.concat(F.array(whole), named)).otherwise(F.array(whole))))
    judged = noted(stretches.select("text").distinct(), forms, lexicon, config)
    right = stretches.join(judged, "text").groupBy("word").agg(F.collect_set(F.when(F.col("ok"), F.col("name"))).alias("right"), F.max(F.col("forbidden") & (F.col("name") == WHOLE)).alias("barred"))
    mark = lambda b: F.get("marks", b - 1)

    def settle(found: Column, x: Column) -> Column:
        i, j = x["i"], x["j"]
        has = lambda a, b: F.array_contains(found, name(a, b))
        empty = lambda at: F.get("parts", at) == ""
        listed = lambda m, of: m.isin(of) if of else F.lit(False)
        off = (j - i > 1) & ((empty(i) & listed(mark(i + 1), starts) & has(i + 1, j)) | (empty(j - 1) & listed(mark(j - 1), ends) & has(i, j - 1)))
        inside = F.filter(F.sequence(F.lit(0), F.col("n")), lambda b: (b > i) & (b < j))
        filled = lambda a, b: (b - a > 1) | ~empty(a)
        early = lambda b: F.size(F.filter(inside, lambda c: (c < b) & (mark(c) == mark(b)))) <= 1
        broken = F.exists(inside, lambda b: has(i, b) & has(b, j) & filled(i, b) & filled(b, j) & early(b))
        return F.when(~has(i, j) & (off | broken), F.array_append(found, name(i, j))).otherwise(found)

    judged_words = cut(distinct.join(right, "word", "left"))
    settled = F.aggregate(spans, F.col("right"), settle)
    parts_ok = F.when(breakable & ~F.col("barred") & (F.size("right") > 0), F.array_contains(settled, name(F.lit(0), F.col("n"))))
    return judged_words.select("word", F.coalesce(F.array_contains("right", WHOLE) | F.coalesce(parts_ok, F.lit(False)), F.lit(False)).alias("ok"))


def unknown_words(words: DataFrame, forms: DataFrame, column: str = "word") -> DataFrame:
    """Distinct words that are no form as they stand."""
    distinct = words.select(column).filter(F.col(column).isNotNull()).distinct()
    return distinct.join(forms.select(F.col("surface").alias(column)).distinct(), column, "left_anti")


def first_dictionary(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(word, dict_no, entry_id)``: the entry of the first dictionary that has the word."""
    hits = words.select("word").distinct().join(lexicon.select("word", "dict_no", "entry_id"), "word")
    return hits.groupBy("word").agg(F.min(F.struct("dict_no", "entry_id")).alias("hit")).select("word", "hit.dict_no", "hit.entry_id")
