"""Forms of given words by stripping affixes: for dictionaries whose forms are too many to store.

Rules are indexed by what they append.  A word is looked up under each of its
endings and beginnings that some rule appends, which undoes the rule: the
append goes, what was stripped comes back, and the rule's condition must hold
for the result.  A prefix and up to two suffixes are undone; what is left is
joined with the lexicon, where the entry's flags and those that rules carry must
allow the chain.  The work grows with the words asked for and the few rules that
fit each, not with roots times rules.

The result has the rows and columns of :func:`lexiforge.operators.expand.expand`
for these words, so spelling, analysis and generation take it in place of the
stored forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.expand import BROADCAST_RULES, FORM_COLUMNS, prefixed, rule_count, suffixed, turned_back
from lexiforge.sources.affix import RULES, AffixConfig, mirrored

RULE = "struct<rule_no:int,flag:int,cross:boolean,strip:string,append:string,cond_regex:string,cont_flags:array<int>,morph:string>"


def rule_index(config: AffixConfig, rules: DataFrame, kind: str, name: str) -> tuple[DataFrame, list[int]]:
    """Rules of a kind as ``(append, <name>)``, and the lengths of what they append."""
    picked = rules.filter(F.col("kind") == kind)
    lengths = sorted({len(r[5]) for r in config.rules if r[1] == kind})
    indexed = picked.select("append", F.struct("rule_no", "flag", "cross", "strip", "append", "cond_regex", "cont_flags", "morph").cast(RULE).alias(name))
    return (F.broadcast(indexed) if rule_count(config) <= BROADCAST_RULES else indexed), lengths


def undone(rows: DataFrame, column: str, index: tuple[DataFrame, list[int]], name: str, suffix: bool, full_strip: bool, out: str) -> DataFrame:
    """Rows with each rule ``name`` that may have made ``column``, and ``out``, what it was made of."""
    rules, lengths = index
    w = F.col(column)
    ends = F.transform(F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.length(w)), lambda k: F.right(w, k) if suffix else F.left(w, k))
    met = rows.withColumn("append", F.explode(ends)).join(rules, "append").drop("append")
    strip, append, regex = (F.col(f"{name}.{c}") for c in ("strip", "append", "cond_regex"))
    base = suffixed(w, append, strip) if suffix else prefixed(w, append, strip)
    met = met.withColumn(out, base)
    left = F.length(out) >= F.length(strip) if full_strip else F.length(out) > F.length(strip)
    held = (regex == "") | F.regexp_like(out, regex)
    # A prefix's condition is one on the root, which a suffix may still hide.
    return met.filter(left & held) if suffix else met.filter(left)


def forms_of(surfaces: DataFrame, lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """The rows of ``expand`` whose surface is among the distinct ``surfaces (surface)``; forms of no other word are made.

    Null surfaces have none.
    """
    asked = surfaces.select("surface").filter("surface IS NOT NULL").distinct()
    if "COMPLEXPREFIXES" in config.switches:
        return turned_back(forms_of(asked.select(F.reverse("surface").alias("surface")), lexicon.withColumn("word", F.reverse("word")), mirrored(config)))
    rules = asked.sparkSession.createDataFrame(config.rules, RULES)
    full = "FULLSTRIP" in config.switches
    none = F.lit(None).cast(RULE)
    sfx, again, pfx = (rule_index(config, rules, kind, name) for kind, name in (("SFX", "s"), ("SFX", "t"), ("PFX", "p")))
    begun = asked.select("surface", none.alias("p"), F.col("surface").alias("rest"))
    if pfx[1]:
        begun = begun.unionByName(undone(asked, "surface", pfx, "p", False, full, "rest"))
    chains = begun.select("surface", "p", none.alias("s"), none.alias("t"), F.col("rest").alias("word"))
    if sfx[1]:
        once = undone(begun, "rest", sfx, "s", True, full, "word")
        chains = chains.unionByName(once.select("surface", "p", "s", none.alias("t"), "word"))
        if any(r[8] for r in config.rules):
            outer = undone(begun, "rest", again, "t", True, full, "between")
            twice = undone(outer, "between", sfx, "s", True, full, "word").filter(F.array_contains("s.cont_flags", F.col("t.flag")))
            chains = chains.unionByName(twice.select("surface", "p", "s", "t", "word"))
    roots = lexicon.filter(~F.array_contains("flags", config.forbidden))
    return allowed(chains.join(roots, "word"), config, full)


def allowed(chains: DataFrame, config: AffixConfig, full_strip: bool) -> DataFrame:
    """Chains of rules that flags, cross products and the constraints on combinations permit, as forms."""
    need, circumfix = config.flag("NEEDAFFIX"), config.flag("CIRCUMFIX")
    is_set = lambda r: F.col(f"{r}.rule_no").isNotNull()
    has = lambda r, flag: F.coalesce(F.array_contains(F.col(f"{r}.cont_flags"), flag), F.lit(False)) if flag else F.lit(False)
    own = lambda r: F.array_contains("flags", F.col(f"{r}.flag"))
    carried = lambda r, by: F.coalesce(F.array_contains(F.col(f"{by}.cont_flags"), F.col(f"{r}.flag")), F.lit(False))
    word, p, s, t = F.col("word"), is_set("p"), is_set("s"), is_set("t")
    regex, strip = F.col("p.cond_regex"), F.col("p.strip")
    long_enough = F.length(word) >= F.length(strip) if full_strip else F.length(word) > F.length(strip)
    prefix_fits = ~p | (long_enough & F.startswith(word, strip) & ((regex == "") | F.regexp_like(word, regex)))
    bare = ~p & ~s & ~(F.array_contains("flags", F.lit(need)) if need else F.lit(False))
    one_prefix = p & ~s & own("p") & ~has("p", need) & ~has("p", circumfix)
    one_suffix = ~p & s & ~t & own("s") & ~has("s", need) & ~has("s", circumfix)
    crossed = p & s & F.col("p.cross") & F.col("s.cross") & own("s")
    both = crossed & ~t & (own("p") | carried("p", "s")) & (has("s", circumfix) == has("p", circumfix)) & ~(has("s", need) & has("p", need))
    two = s & t & own("s") & ~has("t", need)
    two_suffixes = two & ~p & ~has("t", circumfix)
    three = two & crossed & F.col("t.cross") & (own("p") | carried("p", "s") | carried("p", "t")) & (has("t", circumfix) == has("p", circumfix))
    kinds = ((bare, "root", 0), (one_prefix, "prefix", 1), (one_suffix, "suffix", 2), (both, "prefix_suffix", 3), (two_suffixes, "two_suffixes", 4), (three, "prefix_two_suffixes", 5))
    told = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(n).alias("priority"))) for c, k, n in kinds]), lambda x: x.isNotNull())
    told = chains.filter(prefix_fits).select("*", F.inline(told))
    text = lambda r, c: F.coalesce(F.col(f"{r}.{c}"), F.lit(""))
    number: dict[str, Column] = {f"{name}_rule": F.col(f"{r}.rule_no") for r, name in (("p", "pfx"), ("s", "sfx"), ("t", "sfx2"))}
    out = told.withColumns({
        **number, "root": word, "pfx_append": text("p", "append"), "sfx_append": F.concat(text("s", "append"), text("t", "append")), "pfx_morph": text("p", "morph"),
        "sfx_morph": F.trim(F.concat_ws(" ", text("s", "morph"), text("t", "morph"))),
        "cont_flags": F.coalesce(F.col("t.cont_flags"), F.col("s.cont_flags"), F.col("p.cont_flags"), F.array().cast("array<int>")),
    }).select(*FORM_COLUMNS)
    return out.dropDuplicates(["surface", "entry_id", "dict_no", "pfx_rule", "sfx_rule", "sfx2_rule"])
