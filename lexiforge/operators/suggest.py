"""Suggestions: edit candidates, their ranking, and a similarity fallback.

Candidates that need no alphabet are generated as arrays and joined with the
forms.  Candidates that would try every character of an alphabet at every
position are found the other way round: words and forms meet on the keys left
by deleting one character, and the pair tells which edit it was.  The order of
generation is the order of suggestions, so every candidate carries it as
``(variant_no, op, i, j)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import phonetic
from lexiforge.functions.similarity import ANY_MISMATCH, LONGER_WORSE, WEIGHTED, common_positions, common_prefix, is_swap, lcs_length, ngram_batched
from lexiforge.functions.text import ALLCAP, HUHCAP, HUHINITCAP, INITCAP, MOST_BYTES, NOCAP, captype, convert, init_upper, lower_cp, upper_cp
from lexiforge.operators import compound, root_index
from lexiforge.operators.expand import suggestible
from lexiforge.operators.rewrite import REPLACE, _to, replaced
from lexiforge.operators.spell import check, cleaned_word, suggestion_variants
from lexiforge.sources.affix import ONLY_UPCASE, AffixConfig
from lexiforge.sources.dictionary import phonetic_replacements
from lexiforge.store import written

CAPITALS, MAP, SWAP, LONG_SWAP, KEY, EXTRA, FORGOT, MOVE, WRONG, DOUBLE_PAIR, TWO_WORDS, NGRAM, PHONETIC, COMPOUND = (0, *range(2, 15))
#: A pair of words that is an entry.
LISTED = -1
OPS = ("capitals", "replace", "map", "swap", "long_swap", "key", "extra", "forgot", "move", "wrong", "double_pair", "two_words", "ngram", "phonetic", "compound")
# Limits that are part of the semantics.
MOST_SUGGESTIONS, MOST_DISTANCE, MOST_ROOTS, MOST_EXPANSIONS, MOST_GUESSES, MOST_NGRAM, LENGTH_BAND = 15, 4, 100, 100, 200, 4, 4
MOST_PHONETIC, MOST_COMPOUND, SOUND_BAND, LEAST_SOUND_SCORE = 2, 3, 3, 2

#: Words whose candidates and keys (some hundred of 70 bytes each) are broadcast to the forms, and forms that are broadcast to words; more are shuffled.
BROADCAST_WORDS, BROADCAST_FORMS = 5_000, 500_000

CANDIDATES = "array<struct<op:int,i:int,j:int,candidate:string>>"


def _one(op: int, i: Column, j: Column, candidate: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), i.cast("int").alias("i"), j.cast("int").alias("j"), candidate.alias("candidate"))


def _cut(w: Column, start: Column, end: Column) -> Column:
    """Characters start..end (1-based, inclusive); empty if end < start."""
    return F.substr(w, start, F.greatest(end - start + 1, F.lit(0)))


def _at(f: Callable[[Column, int], Column], d: int) -> Callable[[Column], Column]:
    return lambda i: f(i, d)


def capitals(w: Column) -> Column:
    return F.array(_one(CAPITALS, F.lit(0), F.lit(0), upper_cp(w)))


def swaps(w: Column) -> Column:
    """Neighbours exchanged; in words of four or five characters also two pairs at once."""
    n = F.length(w)
    one = F.transform(_to(n - 1), lambda i: _one(SWAP, i, F.lit(0), F.concat(_cut(w, F.lit(1), i - 1), F.substr(w, i + 1, F.lit(1)), F.substr(w, i, F.lit(1)), F.substr(w, i + 2))))
    at = lambda k: F.substring(w, k, 1)
    last = F.concat(F.substr(w, n, F.lit(1)), F.substr(w, n - 1, F.lit(1)))
    ends = _one(SWAP, F.lit(100), F.lit(0), F.concat(at(2), at(1), F.when(n == 5, at(3)).otherwise(F.lit("")), last))
    inner = _one(SWAP, F.lit(101), F.lit(0), F.concat(at(1), at(3), at(2), last))
    more = F.when(n == 4, F.array(ends)).when(n == 5, F.array(ends, inner)).otherwise(F.array().cast(CANDIDATES))
    return F.concat(one, more)


def long_swaps(w: Column) -> Column:
    """Characters two to four places apart exchanged."""

    def pair(i: Column, d: int) -> Column:
        j = i + d
        out = F.concat(_cut(w, F.lit(1), i - 1), F.substr(w, j, F.lit(1)), _cut(w, i + 1, j - 1), F.substr(w, i, F.lit(1)), F.substr(w, j + 1))
        return _one(LONG_SWAP, i, F.lit(d), out)

    return F.concat(*[F.transform(_to(F.length(w) - d), _at(pair, d)) for d in range(2, MOST_DISTANCE + 1)])


def key_slips(w: Column, keyboard: str) -> Column:
    """Each character in upper case, then replaced by its neighbours in the keyboard's rows."""
    near: dict[str, list[str]] = {}
    for row in keyboard.split("|"):
        for at, c in enumerate(row):
            near.setdefault(c, []).extend([x for x in (row[at - 1] if at else "", row[at + 1] if at + 1 < len(row) else "") if x])
    pairs = [x for c, found in near.items() for x in (F.lit(c), F.array(*[F.lit(f) for f in found]))]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")

    def at(i: Column) -> Column:
        c = F.substr(w, i, F.lit(1))
        others = F.concat(F.array(upper_cp(c)), F.coalesce(F.try_element_at(table, c), F.array().cast("array<string>")))
        return F.transform(F.filter(others, lambda o: o != c), lambda o, j: _one(KEY, i, j, F.concat(_cut(w, F.lit(1), i - 1), o, F.substr(w, i + 1))))

    return F.flatten(F.transform(_to(F.length(w)), at))


def deletions(w: Column) -> Column:
    """One character left out, from right to left."""
    n = F.length(w)
    return F.transform(_to(n), lambda k: _one(EXTRA, k, F.lit(0), F.concat(_cut(w, F.lit(1), n - k), F.substr(w, n - k + 2))))


def insertions(w: Column, alphabet: str) -> Column:
    """One character of the alphabet put in: by character, then from right to left."""
    n = F.length(w)
    tried = F.array(*[F.lit(c) for c in alphabet]).cast("array<string>")
    return F.flatten(F.transform(tried, lambda c, t: F.transform(F.sequence(F.lit(0), n), lambda k: _one(FORGOT, t, k, F.concat(_cut(w, F.lit(1), n - k), c, F.substr(w, n - k + 1))))))


def substitutions(w: Column, alphabet: str) -> Column:
    """One character replaced by another of the alphabet: by character, then from right to left."""
    n = F.length(w)
    tried = F.array(*[F.lit(c) for c in alphabet]).cast("array<string>")
    each = F.flatten(F.transform(tried, lambda c, t: F.transform(_to(n), lambda k: _one(WRONG, t, k, F.concat(_cut(w, F.lit(1), n - k), c, F.substr(w, n - k + 2))))))
    return F.filter(each, lambda x: x["candidate"] != w)


def moves(w: Column) -> Column:
    """One character moved two to four places: to the right, then to the left."""
    n = F.length(w)

    def right(i: Column, d: int) -> Column:
        return _one(MOVE, i, F.lit(d), F.concat(_cut(w, F.lit(1), i - 1), _cut(w, i + 1, i + d), F.substr(w, i, F.lit(1)), F.substr(w, i + d + 1)))

    def left(k: Column, d: int) -> Column:
        i = n - k + 1
        return _one(MOVE, k + 1000, F.lit(d), F.concat(_cut(w, F.lit(1), i - d - 1), F.substr(w, i, F.lit(1)), _cut(w, i - d, i - 1), F.substr(w, i + 1)))

    return F.concat(*[F.transform(_to(n - d), _at(f, d)) for f in (right, left) for d in range(2, MOST_DISTANCE + 1)])


def double_pairs(w: Column) -> Column:
    """A pair typed twice, taken out once, in words of five or more characters."""
    n = F.length(w)
    same = lambda i: F.substr(w, i, F.lit(1)) == F.substr(w, i - 2, F.lit(1))
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, i: Column) -> Column:
        run = s["run"] + 1
        hit = (run == 3) | ((run == 2) & (i >= 5))
        yes = F.when(hit, F.struct(F.lit(0).alias("run"), F.array_append(s["found"], i).alias("found"))).otherwise(F.struct(run.alias("run"), s["found"].alias("found")))
        return F.when(same(i), yes).otherwise(F.struct(F.lit(0).alias("run"), s["found"].alias("found")))

    ends = F.when(n >= 5, F.aggregate(F.filter(_to(n), lambda i: i >= 3), start, step, lambda s: s["found"])).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: _one(DOUBLE_PAIR, i, F.lit(0), F.concat(_cut(w, F.lit(1), i - 2), F.substr(w, i + 1))))


def splits(w: Column) -> Column:
    """``array<struct<i, head, tail>>`` of all cuts in two."""
    return F.transform(_to(F.length(w) - 1), lambda i: F.struct(i.alias("i"), F.substr(w, F.lit(1), i).alias("head"), F.substr(w, i + 1).alias("tail")))


def class_keys(w: Column, classes: list[list[str]]) -> Column:
    """All ways to read a word as a sequence of equivalence classes, ``array<struct<key, path>>``.

    A character counts as itself where no class member starts.  The path holds
    class and member at each class read.
    """
    members = [(m, number, place) for number, group in enumerate(classes) for place, m in enumerate(group) if m not in group[:place]]
    state = "array<struct<at:int,key:array<string>,path:array<struct<c:int,m:int>>>>"

    def advance(open_: Column, i: Column) -> Column:
        here = F.filter(open_, lambda s: s["at"] == i)
        rest = F.filter(open_, lambda s: s["at"] != i)

        def onward(s: Column) -> Column:
            reach = lambda m, number, place: F.struct(
                (i + len(m)).cast("int").alias("at"),
                F.array_append(s["key"], F.lit(f"class {number}")).alias("key"),
                F.array_append(s["path"], F.struct(F.lit(number).alias("c"), F.lit(place).alias("m"))).alias("path"),
            )
            taken = [F.when(F.substr(w, i, F.lit(len(m))) == m, reach(m, number, place)) for m, number, place in members]
            found = F.filter(F.array(*taken), lambda x: x.isNotNull()) if taken else F.array().cast(state)
            plain = F.array(F.struct((i + 1).cast("int").alias("at"), F.array_append(s["key"], F.substr(w, i, F.lit(1))).alias("key"), s["path"].alias("path")))
            return F.when(F.size(found) > 0, found).otherwise(plain)

        return F.array_distinct(F.concat(rest, F.flatten(F.transform(here, onward))))

    start = F.array(F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("key"), F.array().cast("array<struct<c:int,m:int>>").alias("path"))).cast(state)
    return F.transform(F.aggregate(_to(F.length(w)), start, advance), lambda s: F.struct(s["key"].alias("key"), s["path"].alias("path")))


def map_matches(words: DataFrame, surfaces: DataFrame, classes: list[list[str]]) -> DataFrame:
    """``(w, op, i, j, candidate)``: forms that read as the same sequence of classes as a word.

    ``i`` is the order in which replacing class by class would come to them: at
    the first place where readings differ, by class, then by the member that the
    word has there, then by the member put in its place.
    """
    if not classes:
        return words.select("w", F.lit(MAP).alias("op"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("w").alias("candidate")).limit(0)
    left = words.select("w", F.inline(class_keys(F.col("w"), classes))).withColumnRenamed("path", "own")
    right = surfaces.select("surface", F.inline(class_keys(F.col("surface"), classes)))
    steps = F.zip_with("own", "path", lambda a, b: F.struct(a["c"].alias("c"), a["m"].alias("m"), b["m"].alias("put")))
    pairs = left.join(right, "key").filter(F.col("w") != F.col("surface")).groupBy("w", "surface").agg(F.min(steps).alias("steps"))
    order = F.row_number().over(Window.partitionBy("w").orderBy("steps", "surface"))
    return pairs.select("w", F.lit(MAP).alias("op"), order.alias("i"), F.lit(0).alias("j"), F.col("surface").alias("candidate"))


def broadcast_up_to(rows: DataFrame, most: int) -> Callable[[DataFrame], DataFrame]:
    """What is to be done with a table made of ``rows``: broadcast, if these are no more than ``most``."""
    return F.broadcast if rows.limit(most + 1).count() <= most else (lambda df: df)


def met(words: DataFrame, free: DataFrame, surfaces: DataFrame, dashes: bool) -> DataFrame:
    """The surfaces that candidates of few words are made of; all of them where the words are many.  One pass over the surfaces, and no shuffle."""
    if words.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        return surfaces
    cut = words.select(F.inline(splits(F.col("w"))))
    marks = [" ", "-"] if dashes else [" "]
    asked = cut.select(F.explode(F.array("head", "tail", *[F.concat_ws(m, "head", "tail") for m in marks])).alias("surface"))
    asked = asked.union(free.select("candidate")).union(free.select(F.explode(F.split("candidate", " ")))).distinct()
    return written(surfaces.join(F.broadcast(asked), "surface", "left_semi"), "met")


def deletion_keys(w: Column) -> Column:
    n = F.length(w)
    return F.array_distinct(F.concat(F.array(w), F.transform(_to(n), lambda i: F.concat(_cut(w, F.lit(1), i - 1), F.substr(w, i + 1)))))


def single_edits(words: DataFrame, surfaces: DataFrame, alphabet: str) -> DataFrame:
    """``(w, op, i, j, candidate)``: forms one deletion, insertion or substitution away.

    Inserted and substituting characters must be in the alphabet, whose order
    ranks them; positions count from the right.
    """
    left = broadcast_up_to(words, BROADCAST_WORDS)(words.select("w", F.explode(deletion_keys(F.col("w"))).alias("key")))
    right = surfaces.select("surface", F.explode(deletion_keys(F.col("surface"))).alias("key"))
    pairs = left.join(right, "key").select("w", "surface").distinct().filter(F.levenshtein("w", "surface", 1) == 1)
    w, s = F.col("w"), F.col("surface")
    shorter = F.least(F.length(w), F.length(s))
    back = lambda x, k: F.substr(x, F.length(x) - k + 1, F.lit(1))
    tail = F.aggregate(_to(shorter), F.lit(0), lambda a, k: F.when((a == k - 1) & (back(w, k) == back(s, k)), a + 1).otherwise(a))
    told = pairs.withColumn("tail", tail).withColumn("delta", F.length(s) - F.length(w))
    c = F.substr(s, F.length(s) - F.col("tail"), F.lit(1))
    place = F.instr(F.lit(alphabet), c)
    op = F.when(F.col("delta") == -1, EXTRA).when(F.col("delta") == 1, FORGOT).otherwise(WRONG)
    i = F.when(F.col("delta") == -1, F.col("tail") + 1).otherwise(place - 1)
    j = F.when(F.col("delta") == -1, 0).when(F.col("delta") == 1, F.col("tail")).otherwise(F.col("tail") + 1)
    return told.filter((F.col("delta") == -1) | (place > 0)).select("w", op.alias("op"), i.alias("i"), j.alias("j"), s.alias("candidate"))


def two_words(words: DataFrame, surfaces: DataFrame, dashes: bool = False) -> DataFrame:
    """``(w, op, i, j, candidate)``: cuts into two forms of words of three bytes or more.

    Pairs that are entries themselves are listed: they have an ``op`` of their own, the last cut first.
    """
    cut = words.filter(F.octet_length("w") >= 3).select("w", F.inline(splits(F.col("w"))))
    known = surfaces.select("surface")
    known = broadcast_up_to(known, BROADCAST_FORMS)(known)
    both = cut.join(known.withColumnRenamed("surface", "head"), "head").join(known.withColumnRenamed("surface", "tail"), "tail")
    apart = both.select("w", F.lit(TWO_WORDS).alias("op"), "i", F.lit(0).alias("j"), F.concat_ws(" ", "head", "tail").alias("candidate"))
    marks = [" ", "-"] if dashes else [" "]
    pairs = cut.select("w", "i", F.posexplode(F.array(*[F.concat_ws(m, "head", "tail") for m in marks])).alias("j", "candidate"))
    entries = pairs.join(known.withColumnRenamed("surface", "candidate"), "candidate", "left_semi").select("w", F.lit(LISTED).alias("op"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "candidate")
    more = pairs.filter("j = 1").join(both.select("w", "i"), ["w", "i"], "left_semi").select("w", F.lit(TWO_WORDS).alias("op"), "i", "j", "candidate")
    return apart.unionByName(entries).unionByName(more)


def generated(words: DataFrame, config: AffixConfig) -> DataFrame:
    """``(w, op, i, j, candidate)`` of the generators that need neither alphabet nor forms."""
    w = F.col("w")
    arrays = [capitals(w), swaps(w), long_swaps(w), key_slips(w, config.keyboard), moves(w), double_pairs(w)]
    return words.select("w", F.inline(F.concat(*arrays)))


def accepted_surfaces(forms: DataFrame, lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """``(surface)``: forms that may be suggested, and are no forbidden word."""
    barred = lexicon.filter(F.array_contains("flags", config.forbidden)).select(F.col("word").alias("surface"))
    return suggestible(forms, config).select("surface").distinct().join(barred, "surface", "left_anti")


def replacement_rules(lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """The affix file's replacements, then those that entries give for their pronunciation."""
    spoken = phonetic_replacements(lexicon).select(
        F.lit(len(config.replacements)).alias("rule_no"), "pattern", F.lit(False).alias("at_start"), F.lit(False).alias("at_end"), "replacement"
    )
    return config.replacements_df(lexicon.sparkSession).unionByName(spoken)


def candidates(words: DataFrame, surfaces: DataFrame, config: AffixConfig, rules: DataFrame | None = None) -> DataFrame:
    """``(w, op, i, j, candidate)``: accepted candidates of distinct words ``(w)``; ``surfaces (surface)`` are distinct forms.

    Where an upper-case form or a replacement is found, unlisted pairs of words are left out.
    """
    spark = words.sparkSession
    free = generated(words, config).unionByName(replaced(words, config.replacements_df(spark) if rules is None else rules))
    dashes = "-" in config.try_chars or "a" in config.try_chars
    every, surfaces = surfaces, met(words, free, surfaces, dashes)
    single = free.filter(~F.contains("candidate", F.lit(" "))).join(surfaces.withColumnRenamed("surface", "candidate"), "candidate", "left_semi")
    phrases = free.filter(F.contains("candidate", F.lit(" "))).withColumn("part", F.explode(F.split("candidate", " ")))
    known = phrases.join(surfaces.withColumn("known", F.lit(1)), F.col("part") == F.col("surface"), "left")
    spaced = known.groupBy("w", "op", "i", "j", "candidate").agg(F.bool_and(F.col("known").isNotNull()).alias("all")).filter("all").drop("all")
    found = single.unionByName(spaced).unionByName(map_matches(words, every, config.classes)).unionByName(single_edits(words, every, config.try_chars))
    if "NOSPLITSUGS" not in config.switches:
        found = found.unionByName(two_words(words, surfaces, dashes))
    good = F.max(F.col("op").isin(CAPITALS, REPLACE)).over(Window.partitionBy("w"))
    found = found.filter(F.col("candidate") != F.col("w")).withColumn("good", good)
    return found.filter(~F.col("good") | (F.col("op") != TWO_WORDS))


def compound_candidates(words: DataFrame, forms: DataFrame, config: AffixConfig) -> DataFrame:
    """``(w, op, i, j, candidate)``: edits of distinct words ``(w)`` that are compounds, in the order of generation."""
    spelled = F.concat(deletions(F.col("w")), insertions(F.col("w"), config.try_chars), substitutions(F.col("w"), config.try_chars))
    listed = spelled if config.try_chars else deletions(F.col("w"))
    every = generated(words, config).unionByName(replaced(words, config.replacements_df(words.sparkSession)))
    every = every.unionByName(words.select("w", F.inline(listed))).filter((F.col("candidate") != F.col("w")) & ~F.contains("candidate", F.lit(" ")))
    right = compound.compounds(every.select(F.col("candidate").alias("word")).distinct(), suggestible_parts(forms, config), config).select(F.col("word").alias("candidate"))
    order = F.row_number().over(Window.partitionBy("w").orderBy("op", "i", "j", "candidate"))
    return every.join(right, "candidate", "left_semi").select("w", F.lit(COMPOUND).alias("op"), order.alias("i"), F.lit(0).alias("j"), "candidate")


def suggestible_parts(forms: DataFrame, config: AffixConfig) -> DataFrame:
    barred = config.flag("NOSUGGEST")
    return forms.filter(~F.array_contains("flags", barred)) if barred else forms


def ranked(found: DataFrame, keys: list[str], most: int = MOST_SUGGESTIONS) -> DataFrame:
    """Keep each word's first occurrence of a suggestion and its ``most`` first suggestions, with ``rank`` from 1."""
    order = F.struct(*keys)
    first = found.groupBy("word", "suggestion").agg(F.min(F.struct(order.alias("order"), F.col("op").alias("op"))).alias("f"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("f.order", "suggestion"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select("word", "rank", "suggestion", F.col("f.op").alias("op"))


def likely_roots(lexicon: DataFrame, config: AffixConfig | None) -> DataFrame:
    """The entries that the similarity fallback may use."""
    if config is None:
        return lexicon
    barred = [f for f in (config.forbidden, ONLY_UPCASE, config.flag("NOSUGGEST"), config.flag("NONGRAMSUGGEST"), config.flag("ONLYINCOMPOUND")) if f]
    return lexicon.filter(~F.arrays_overlap("flags", F.array(*[F.lit(f) for f in barred])))


def scored_roots(words: DataFrame, lexicon: DataFrame, config: AffixConfig | None = None) -> DataFrame:
    """``(w, entry_id, root, low, clen, score)``: how like each word the roots within four characters of its length are, by three-grams.

    The length band is an equi-join on length.  Entries that ``config`` bars are
    left out, as are capitalised ones without a pronunciation for a word in lower
    case (``lower``, true if absent).
    """
    lexicon = likely_roots(lexicon, config)
    words = words.select("w", (F.col("lower") if "lower" in words.columns else F.lit(True)).alias("lower"))
    band = words.select("w", "lower", F.explode(F.sequence(F.length("w") - LENGTH_BAND, F.length("w") + LENGTH_BAND)).alias("clen"))
    # Lower case is a column of the smaller side, so that it is not computed for each pair.
    proper = (F.col("captype") == INITCAP) & ~F.contains("morph", F.lit("ph:"))
    roots = lexicon.select("entry_id", F.col("word").alias("root"), lower_cp(F.col("word")).alias("low"), "clen", proper.alias("proper"))
    met = band.join(roots, "clen").filter(~F.col("lower") | ~F.col("proper"))
    return met.select("w", "entry_id", "root", "low", "clen", (ngram_batched(3, LONGER_WORSE)(F.col("w"), F.col("low")) + common_prefix(F.col("w"), F.col("root"))).alias("score"))


def similar_roots(words: DataFrame, lexicon: DataFrame, config: AffixConfig | None = None, most: int = MOST_ROOTS, index: DataFrame | None = None) -> DataFrame:
    """``(w, entry_id, root, score, place)``: the roots most like each word; ties go to the smaller entry.

    ``index`` is :func:`root_index.index_roots` of :func:`likely_roots`, if it is at hand.
    """
    return root_index.similar_roots(words, likely_roots(lexicon, config), most, index)


def sounding_roots(words: DataFrame, lexicon: DataFrame, surfaces: DataFrame, config: AffixConfig, earlier: DataFrame, most: int = MOST_PHONETIC) -> DataFrame:
    """``(w, op, i, j, candidate)``: accepted roots whose phonetic code is most like the word's.

    Each root's code is computed once.  Roots that contain a suggestion made
    ``earlier (w, candidate)`` are left out.
    """
    code = phonetic.coder(config.phonetic)
    words = words.select("w", "lower").withColumn("code", code(upper_cp(F.col("w")))) if "lower" in words.columns else words.select("w", F.lit(True).alias("lower"), code(upper_cp(F.col("w"))).alias("code"))
    codes = lexicon.select(F.col("word").alias("root")).distinct().withColumn("root_code", code(upper_cp(F.col("root"))))
    near = scored_roots(words, lexicon, config).filter((F.col("score") > LEAST_SOUND_SCORE) & (F.abs(F.length("w") - F.col("clen")) <= SOUND_BAND))
    sound = near.join(words.select("w", "code"), "w").join(codes, "root").withColumn("sound", 2 * ngram_batched(3, LONGER_WORSE)(F.col("code"), F.col("root_code")))
    kept = sound.withColumn("place", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("sound"), "entry_id"))).filter(F.col("place") <= MOST_ROOTS)
    total = F.col("sound") + 2 * lcs_length("w", "low") - F.abs(F.length("w") - F.length("low")) + common_prefix(F.col("w"), F.col("low"))
    kept = kept.withColumn("total", total).join(surfaces.withColumnRenamed("surface", "root"), "root", "left_semi").dropDuplicates(["w", "root"])
    said = earlier.groupBy("w").agg(F.collect_set("candidate").alias("said"))
    fresh = kept.join(said, "w", "left").filter(~F.exists(F.coalesce("said", F.array().cast("array<string>")), lambda x: F.contains(F.col("root"), x)))
    ordered = fresh.withColumn("n", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("total"), "place"))).filter(F.col("n") <= most)
    return ordered.select("w", F.lit(PHONETIC).alias("op"), F.col("n").alias("i"), F.lit(0).alias("j"), F.col("root").alias("candidate"))


def similarity_threshold(w: Column) -> Column:
    """The mean score of the word against itself with every fourth character masked, less one."""

    def masked(start: int) -> Column:
        return F.array_join(F.transform(F.split(w, ""), lambda c, i: F.when((i >= start) & ((i - start) % 4 == 0), F.lit("*")).otherwise(c)), "")

    total = ngram_full(w, masked(1)) + ngram_full(w, masked(2)) + ngram_full(w, masked(3))
    return F.floor(total / 3).cast("int") - 1


def ngram_full(a: Column, b: Column) -> Column:
    """The n-gram score with as many levels as the word has characters."""
    return ngram_batched(MOST_BYTES, ANY_MISMATCH)(a, b)


def similar_forms(words: DataFrame, lexicon: DataFrame, forms: DataFrame, config: AffixConfig, most: int = MOST_NGRAM, index: DataFrame | None = None) -> DataFrame:
    """``(w, op, i, j, candidate)``: the similarity fallback for words without other suggestions.

    The best roots are expanded by affixes that the word shows too; expansions
    above the word's own threshold are scored again by subsequence, positions,
    swaps and weighted two-grams, and the best few are kept.
    """
    roots = similar_roots(words, lexicon, config, index=index)
    words = words.select("w").distinct()
    own = suggestible(forms, config).select("entry_id", "surface", lower_cp(F.col("surface")).alias("low"), "pfx_append", "sfx_append", F.coalesce("sfx_rule", F.lit(-1)).alias("rule"))
    grown = roots.join(own, "entry_id").filter(F.endswith(F.col("w"), F.col("sfx_append")) & F.startswith(F.col("w"), F.col("pfx_append")))
    grown = grown.withColumn("n", F.row_number().over(Window.partitionBy("w", "entry_id").orderBy("rule", "surface"))).filter(F.col("n") <= MOST_EXPANSIONS)
    w, low = F.col("w"), F.col("low")
    least = words.select("w", similarity_threshold(w).alias("least"))
    first = grown.join(least, "w").withColumn("guess", ngram_full(w, low) + common_prefix(w, F.col("surface"))).filter(F.col("guess") > F.col("least"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("guess"), "place", "surface"))).filter(F.col("n") <= MOST_GUESSES)
    kept = kept.withColumn("lcs", lcs_length("w", "low"))
    kept = kept.withColumn("two", ngram_batched(2, ANY_MISMATCH, WEIGHTED)(w, low) + ngram_batched(2, ANY_MISMATCH, WEIGHTED)(low, w)).withColumn("four", ngram_batched(4, ANY_MISMATCH)(w, low))
    two = F.col("two")
    factor = F.lit((10.0 - config.numbers["MAXDIFF"]) / 5.0 if "MAXDIFF" in config.numbers else 1.0)
    total = (
        2 * F.col("lcs") - F.abs(F.length(w) - F.length(low)) + common_prefix(w, low) + (common_positions(w, low) > 0).cast("int")
        + F.when(is_swap(w, low), 10).otherwise(0) + F.col("four") + two
        + F.when(two < (F.length(w) + F.length(low)) * factor, -1000).otherwise(0)
    )
    scored = kept.withColumn("total", F.when(w == low, total + 2000).otherwise(total))
    top = F.max("total").over(Window.partitionBy("w"))
    scored = scored.withColumn("top", top).filter((F.col("top") <= 1000) | (F.col("total") > 1000))
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("total"), "place", "surface"))
    scored = scored.dropDuplicates(["w", "surface"]).withColumn("n", place)
    only = "ONLYMAXDIFF" in config.switches
    scored = scored.filter((F.col("total") >= -100) | ((F.col("n") == 1) & F.lit(not only)))
    return scored.filter(F.col("n") <= config.numbers.get("MAXNGRAMSUGS", most)).select("w", F.lit(NGRAM).alias("op"), F.col("n").alias("i"), F.lit(0).alias("j"), F.col("surface").alias("candidate"))


#: Places of suggestions that are put first: parted at a dot, in lower case, with an initial capital; parts with their capitals come before all.
AT_DOT, LOWERED, CAPITALISED, PARTED = -2, -3, -4, -5
#: Suggestions that no generator made.
SPELLED = -2


def put_first(cased_words: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """Words ``(word, clean, case)`` of mixed capitals with what is suggested before all else.

    ``something.The`` in two, and the word in lower case or with an initial
    capital, if that is right; where the affix file keeps case, words in capitals
    in lower case too.  What comes later in this order stands first.
    """
    clean = F.col("clean")
    low = lower_cp(clean)
    dot = F.locate(".", clean)
    mixed = F.col("case").isin(HUHCAP, HUHINITCAP)
    keep = (F.col("case") == ALLCAP) & F.lit(bool(config.flag("KEEPCASE")))
    row = lambda place, form, when: F.when(when, F.struct(F.lit(place).alias("variant_no"), form.alias("candidate")))
    parted = F.concat(F.substr(clean, F.lit(1), dot), F.lit(" "), F.substr(clean, dot + 1))
    every = F.array(
        row(AT_DOT, parted, mixed & (dot > 0) & (captype(F.substr(clean, dot + 1)) == INITCAP)), row(LOWERED, low, mixed | keep), row(CAPITALISED, init_upper(low), F.col("case") == HUHINITCAP)
    )
    offered = cased_words.select("*", F.inline(F.filter(every, lambda x: x.isNotNull())))
    asked = offered.filter(F.col("variant_no") != AT_DOT).select("candidate").distinct()
    right = check(asked, forms, lexicon, config, "candidate").filter("ok").select("candidate")
    spelled = offered.filter(F.col("variant_no") != AT_DOT).join(right, "candidate", "left_semi")
    zero = F.lit(0)
    return offered.filter(F.col("variant_no") == AT_DOT).unionByName(spelled).withColumns({"w": clean, "op": F.lit(SPELLED), "i": zero, "j": zero, "good": F.lit(False)})


def capitals_of_parts(found: DataFrame) -> DataFrame:
    """Of words in mixed capitals, pairs suggested for their lower-case form get their second word's capital, unless the word ends that way, and go first."""
    space = F.locate(" ", F.col("candidate"))
    second = F.substr(F.col("candidate"), space + 1)
    size = F.length(second)
    from_low = ((F.col("case") == HUHCAP) & (F.col("variant_no") == 1)) | ((F.col("case") == HUHINITCAP) & (F.col("variant_no") >= 2))
    differs = (space > 0) & (size < F.length("clean")) & (F.substr(F.col("clean"), F.length("clean") - size + 1) != second)
    moved = from_low & differs
    # The later of those moved stands before the earlier.
    turned = {c: F.when(moved, -F.col(c)).otherwise(F.col(c)) for c in ("op", "i", "j")}
    return found.withColumns({
        **turned, "variant_no": F.when(moved, PARTED - F.col("variant_no")).otherwise(F.col("variant_no")),
        "candidate": F.when(moved, F.concat(F.substr(F.col("candidate"), F.lit(1), space), init_upper(second))).otherwise(F.col("candidate")),
    })


def suggest(words: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig, fallback: bool = True, most: int = MOST_SUGGESTIONS, index: DataFrame | None = None) -> DataFrame:
    """``(word, rank, suggestion, op)`` of distinct words.

    Case variants are tried in turn, and a word that ends in a dot also as an
    abbreviation; suggestions follow the word's capitals and occur once, in the
    order of (variant, generator, position).  Words left without any are handed
    to the similarity fallback.
    """
    word, clean = F.col("word"), F.rtrim(F.col("word"), F.lit("."))
    asked = words.select("word").filter("word IS NOT NULL").distinct().withColumns({"clean": clean, "dotted": clean != word}).filter("clean <> ''")
    cased_words = written(asked.withColumn("case", captype(F.col("clean"))), "asked")
    tried = written(cased_words.select("*", F.inline(suggestion_variants(F.col("clean"), F.col("dotted")))).withColumnRenamed("form", "w").drop("dotted"), "tried")
    cased_words = cased_words.drop("dotted")

    def cased(rows: DataFrame) -> DataFrame:
        big = upper_cp(F.col("candidate"))
        big = F.replace(big, F.lit("ß"), F.lit("SS")) if "CHECKSHARPS" in config.switches else big
        text = F.when(F.col("case") == ALLCAP, big).when(F.col("case").isin(INITCAP, HUHINITCAP), init_upper(F.col("candidate"))).otherwise(F.col("candidate"))
        return rows.withColumn("suggestion", text).filter((F.col("suggestion") != word) & (F.col("suggestion") != F.col("clean")))

    keys = ["variant_no", "op", "i", "j"]
    surfaces = written(accepted_surfaces(forms, lexicon, config), "surfaces")
    found = tried.join(candidates(tried.select("w").distinct(), surfaces, config, replacement_rules(lexicon, config)), "w")
    found = cased(capitals_of_parts(found).unionByName(put_first(cased_words, forms, lexicon, config)))
    # A listed pair clears what came before it, unless that was good.
    cleared = F.max(F.when((F.col("op") == LISTED) & ~F.col("good"), F.col("variant_no"))).over(Window.partitionBy("word"))
    kept = found.withColumn("cleared", cleared).filter(F.col("cleared").isNull() | (F.col("variant_no") > F.col("cleared")) | ((F.col("variant_no") == F.col("cleared")) & (F.col("op") == LISTED)))
    plain = ranked(kept, keys, most)
    if not fallback:
        return plain
    plain = written(plain, "edits")
    left = written(cased_words.join(plain.select("word").distinct(), "word", "left_anti").withColumns({"variant_no": F.lit(0), "w": lower_cp(F.col("clean"))}), "left")
    if compound.enabled(config):
        made = compound_candidates(left.select("w").distinct(), forms, config)
        joined = written(ranked(cased(tried.join(left.select("word").distinct(), "word", "left_semi").join(made, "w")), keys, config.numbers.get("MAXCPDSUGS", MOST_COMPOUND)), "compound-edits")
        plain = plain.unionByName(joined)
        left = left.join(joined.select("word").distinct(), "word", "left_anti")
    asked_low = left.select("w", (F.col("case") == NOCAP).alias("lower")).distinct()
    similar = similar_forms(asked_low, lexicon, forms, config, index=index)
    if config.phonetic:
        similar = written(similar, "similar")
        similar = similar.unionByName(sounding_roots(asked_low, lexicon, surfaces, config, similar.select("w", "candidate")))
    return plain.unionByName(ranked(cased(left.join(similar, "w")), keys, most))


def suggest_text(words: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """``(word, rank, suggestion)`` of words as typed: converted, cleaned, and corrected part by part around dashes.

    Of a word with dashes whose suggestions have none, the first wrong part is
    corrected and its suggestions, put in their place, come first.  Dots at the
    end come back where the affix file wants them.  With case or forbidden
    words to keep, suggestions for capitalised words that are wrong in that case
    are lowered or capitalised, or go.  Output conversion comes last.
    """
    asked = words.select("word").filter("word IS NOT NULL").distinct().withColumn("c", cleaned_word(F.col("word"), config))
    asked = asked.select("word", F.col("c.word").alias("clean"), F.col("c.dots").alias("dots")).filter("clean <> ''")
    asked = asked.withColumn("key", F.when(F.col("dots") > 0, F.concat("clean", F.lit("."))).otherwise(F.col("clean")))
    dashed = asked.filter(F.contains("clean", F.lit("-"))).select("clean").distinct()
    parts = dashed.select("clean", F.posexplode(F.split("clean", "-")).alias("at", "part")).filter("part <> ''")
    right = check(parts.select("part").distinct(), forms, lexicon, config, "part").filter("ok").select(F.col("part").alias("right"))
    wrong = parts.join(right, F.col("part") == F.col("right"), "left_anti").groupBy("clean").agg(F.min(F.struct("at", "part")).alias("first"))
    asked = written(asked, "asked")
    wrong = written(wrong.select("clean", F.col("first.at").alias("at"), F.col("first.part").alias("part")), "wrong-parts")
    every = asked.select(F.col("key").alias("word")).unionByName(wrong.select(F.col("part").alias("word"))).distinct()
    found = written(suggest(every, forms, lexicon, config).select(F.col("word").alias("asked"), "rank", "suggestion"), "suggestions")
    own = found.withColumnRenamed("asked", "key")
    with_dash = own.filter(F.contains("suggestion", F.lit("-"))).select("key").distinct()
    listed = wrong.join(asked.select("clean", "key").distinct(), "clean").join(with_dash, "key", "left_anti").join(found, F.col("part") == F.col("asked"))
    pieces = F.transform(F.split("clean", "-"), lambda p, i: F.when(i == F.col("at"), F.col("suggestion")).otherwise(p))
    mended = listed.select("key", (F.col("rank") - 1_000).alias("rank"), F.array_join(pieces, "-").alias("suggestion"))
    rows = asked.withColumn("case", captype(F.col("clean"))).join(own.unionByName(mended), "key")
    if "SUGSWITHDOTS" in config.switches:
        rows = rows.withColumn("suggestion", F.concat("suggestion", F.repeat(F.lit("."), F.col("dots"))))
    if config.flag("KEEPCASE") or "FORBIDDENWORD" in config.flags:
        low = lower_cp(F.col("suggestion"))
        forms_of = F.array(F.col("suggestion"), low, init_upper(low))
        tried = rows.select("suggestion", F.posexplode(forms_of).alias("try", "form")).distinct()
        fine = check(tried.select("form").distinct(), forms, lexicon, config, "form").filter("ok").select("form")
        best = tried.join(fine, "form").groupBy("suggestion").agg(F.min(F.struct("try", "form")).alias("best")).select("suggestion", F.col("best.form").alias("best"))
        free = F.contains("suggestion", F.lit(" ")) | ~F.col("case").isin(INITCAP, ALLCAP)
        rows = rows.join(best, "suggestion", "left").withColumn("suggestion", F.when(free, F.col("suggestion")).otherwise(F.col("best"))).filter("suggestion IS NOT NULL")
    rows = rows.groupBy("word", "suggestion").agg(F.min("rank").alias("order"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("order", "suggestion")))
    return rows.select("word", "rank", convert(F.col("suggestion"), config.output_conversion).alias("suggestion"))
