"""Surface forms: a lexicon expanded by affix rules.

The generation side of affix analysis.  Every form is computed once, with the
rules that made it; lookup, spelling, analysis and suggestion are then
equi-joins on the surface.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.sources.affix import ONLY_UPCASE, AffixConfig, mirrored

FORM_COLUMNS = ("surface", "entry_id", "dict_no", "root", "flags", "morph", "kind", "pfx_rule", "sfx_rule", "sfx2_rule", "pfx_append", "sfx_append", "pfx_morph", "sfx_morph", "cont_flags", "priority")
#: Rules are broadcast up to this many; a rule is some 200 bytes.
BROADCAST_RULES = 50_000


def suffixed(word: Column, strip: Column, append: Column) -> Column:
    return F.concat(F.substr(word, F.lit(1), F.length(word) - F.length(strip)), append)


def prefixed(word: Column, strip: Column, append: Column) -> Column:
    return F.concat(append, F.substr(word, F.length(strip) + 1))


def applies(word: Column, rule: str, suffix: bool, full_strip: bool) -> Column:
    """Whether a rule fits: its condition holds, what it strips is there, and something is left."""
    strip, regex = F.col(f"{rule}.strip"), F.col(f"{rule}.cond_regex")
    there = F.endswith(word, strip) if suffix else F.startswith(word, strip)
    left = F.length(word) >= F.length(strip) if full_strip else F.length(word) > F.length(strip)
    return left & there & ((regex == "") | F.regexp_like(word, regex))


def rule_table(rules: DataFrame, kind: str, name: str) -> DataFrame:
    picked = rules.filter(F.col("kind") == kind)
    return picked.select(F.col("flag").alias(f"{name}_flag"), F.struct("rule_no", "cross", "strip", "append", "cond_regex", "cont_flags", "morph").alias(name))


def rule_count(config: AffixConfig) -> int:
    return len(config.rules)


def expand(lexicon: DataFrame, rules: DataFrame, config: AffixConfig) -> DataFrame:
    """Roots, one-suffix, one-prefix, prefix-and-suffix, and continuation forms.

    Constraints on combinations are applied here: roots and rules that need an
    affix, halves of a circumfix that must meet each other, cross products that
    both sides allow.  ``priority`` orders analyses of one surface: root,
    prefix, suffix, prefix and suffix, two suffixes, prefix and two suffixes.
    With complex prefixes, where two prefixes but one suffix may meet, words and
    rules are expanded backwards; ``sfx2_rule`` is then the outer prefix.
    """
    if "COMPLEXPREFIXES" in config.switches:
        back = mirrored(config)
        turned = expand(lexicon.withColumn("word", F.reverse("word")), back.rules_df(lexicon.sparkSession), back)
        return turned_back(turned)
    small = F.broadcast if rule_count(config) <= BROADCAST_RULES else (lambda df: df)
    full = "FULLSTRIP" in config.switches
    need, circumfix = F.lit(config.flag("NEEDAFFIX")), F.lit(config.flag("CIRCUMFIX"))
    has = lambda rule, flag: F.array_contains(F.col(f"{rule}.cont_flags"), flag) & (flag != 0)
    roots = lexicon.filter(~F.array_contains("flags", config.forbidden))
    empty = F.array().cast("array<int>")

    def form(df: DataFrame, surface: Column, kind: str, priority: int, pfx: str | None = None, sfx: str | None = None, sfx2: str | None = None) -> DataFrame:
        number = lambda r: F.col(f"{r}.rule_no") if r else F.lit(None).cast("int")
        text = lambda r, c: F.col(f"{r}.{c}") if r else F.lit("")
        last = sfx2 or sfx or pfx
        return df.select(
            surface.alias("surface"), "entry_id", "dict_no", F.col("word").alias("root"), "flags", "morph", F.lit(kind).alias("kind"),
            number(pfx).alias("pfx_rule"), number(sfx).alias("sfx_rule"), number(sfx2).alias("sfx2_rule"),
            text(pfx, "append").alias("pfx_append"), F.concat(text(sfx, "append"), text(sfx2, "append")).alias("sfx_append"),
            text(pfx, "morph").alias("pfx_morph"), F.trim(F.concat_ws(" ", text(sfx, "morph"), text(sfx2, "morph"))).alias("sfx_morph"),
            (F.col(f"{last}.cont_flags") if last else empty).alias("cont_flags"), F.lit(priority).alias("priority"),
        )

    bare = form(roots.filter(~(F.array_contains("flags", need) & (need != 0))), F.col("word"), "root", 0)
    flagged = roots.withColumn("flag", F.explode("flags"))
    w = F.col("word")
    sfx = flagged.join(small(rule_table(rules, "SFX", "s")), F.col("flag") == F.col("s_flag")).filter(applies(w, "s", True, full)).drop("flag", "s_flag")
    stem = suffixed(w, F.col("s.strip"), F.col("s.append"))
    pfx = flagged.join(small(rule_table(rules, "PFX", "p")), F.col("flag") == F.col("p_flag")).filter(applies(w, "p", False, full)).drop("flag", "p_flag")
    one_suffix = form(sfx.filter(~has("s", need) & ~has("s", circumfix)), stem, "suffix", 2, sfx="s")
    one_prefix = form(pfx.filter(~has("p", need) & ~has("p", circumfix)), prefixed(w, F.col("p.strip"), F.col("p.append")), "prefix", 1, pfx="p")

    # A cross product's prefix flag stands at the root or continues the suffix.
    open_sfx = sfx.filter("s.cross").withColumns({"_stem": stem, "flag": F.explode(F.array_distinct(F.concat("flags", "s.cont_flags")))})
    crossed = open_sfx.join(small(rule_table(rules, "PFX", "p")), F.col("flag") == F.col("p_flag")).filter(F.col("p.cross") & applies(w, "p", False, full))
    crossed = crossed.filter((has("s", circumfix) == has("p", circumfix)) & ~(has("s", need) & has("p", need)))
    both = form(crossed, prefixed(F.col("_stem"), F.col("p.strip"), F.col("p.append")), "prefix_suffix", 3, pfx="p", sfx="s")

    again = sfx.withColumns({"_stem": stem, "flag": F.explode("s.cont_flags")}).join(small(rule_table(rules, "SFX", "t")), F.col("flag") == F.col("t_flag"))
    again = again.filter(applies(F.col("_stem"), "t", True, full) & ~has("t", need)).withColumn("_twice", suffixed(F.col("_stem"), F.col("t.strip"), F.col("t.append")))
    two = form(again.filter(~has("t", circumfix)), F.col("_twice"), "two_suffixes", 4, sfx="s", sfx2="t")
    open_two = again.filter("s.cross AND t.cross").drop("flag").withColumn("flag", F.explode(F.array_distinct(F.concat("flags", "s.cont_flags", "t.cont_flags"))))
    pfx_two = open_two.join(small(rule_table(rules, "PFX", "p")), F.col("flag") == F.col("p_flag")).filter(F.col("p.cross") & applies(w, "p", False, full))
    pfx_two = pfx_two.filter(has("t", circumfix) == has("p", circumfix))
    three = form(pfx_two, prefixed(F.col("_twice"), F.col("p.strip"), F.col("p.append")), "prefix_two_suffixes", 5, pfx="p", sfx="s", sfx2="t")
    forms = bare.unionByName(one_suffix).unionByName(one_prefix)
    if any(r[1] == "PFX" for r in config.rules):
        forms = forms.unionByName(both)
    if any(r[8] for r in config.rules):
        forms = forms.unionByName(two).unionByName(three)
    return forms.dropDuplicates(["surface", "entry_id", "dict_no", "pfx_rule", "sfx_rule", "sfx2_rule"])


def turned_back(forms: DataFrame) -> DataFrame:
    """Forms that were made of words read backwards, the right way round: their prefixes are suffixes and the other way."""
    kinds = {"prefix": "suffix", "suffix": "prefix", "two_suffixes": "two_prefixes", "prefix_two_suffixes": "two_prefixes_suffix"}
    swapped = {f"{a}_{c}": F.col(f"{b}_{c}") for a, b in (("pfx", "sfx"), ("sfx", "pfx")) for c in ("rule", "morph")}
    swapped |= {f"{a}_append": F.reverse(f"{b}_append") for a, b in (("pfx", "sfx"), ("sfx", "pfx"))}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("kind")), F.col("kind"))
    return forms.withColumns({**swapped, "surface": F.reverse("surface"), "root": F.reverse("root"), "kind": kind})


def suggestible(forms: DataFrame, config: AffixConfig) -> DataFrame:
    """Forms that may be suggested: not of entries hidden, kept from suggestions or used in compounds only."""
    barred = [f for f in (ONLY_UPCASE, config.flag("NOSUGGEST"), config.flag("ONLYINCOMPOUND")) if f]
    carries = F.concat("flags", "cont_flags")
    return forms.filter(~F.arrays_overlap(carries, F.array(*[F.lit(f) for f in barred])))


def suffix_suggest(forms: DataFrame, roots: DataFrame) -> DataFrame:
    """All one-suffix forms of the given ``(word)`` roots."""
    return forms.filter("kind = 'suffix'").join(roots.select(F.col("word").alias("root")).distinct(), "root", "left_semi").select("root", "surface", "sfx_rule")
