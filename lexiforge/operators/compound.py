"""Compound words: parts found by joining stretches of a word on forms, then a search for a lawful row of parts.

Stretches between any two places of a word meet the forms that may be a part
there.  What a word's stretches found is a small graph over its places (at most
a word's length times the longest part), searched in Arrow batches; nothing is
gathered beyond one word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.rewrite import replaced
from lexiforge.sources.affix import ONLY_UPCASE, AffixConfig

#: Fixed value: the format's least length of a part.
LEAST_PART = 3
OPTIONS = ("COMPOUNDFLAG", "COMPOUNDBEGIN", "COMPOUNDMIDDLE", "COMPOUNDEND")


def enabled(config: AffixConfig) -> bool:
    return bool(config.compound_rules) or any(config.flag(o) for o in OPTIONS)


def least_part(config: AffixConfig) -> int:
    return max(config.numbers.get("COMPOUNDMIN", LEAST_PART), 1)


def rule_tokens(rule: str, config: AffixConfig) -> list[tuple[int, str]]:
    """A rule's flags, each with ``*``, ``?`` or nothing; flags of several characters stand in parentheses."""
    found = re.findall(r"\(([^)]*)\)([*?]?)|([^()*?])([*?]?)", rule)
    return [(config.decode(wide or one)[0], mark or one_mark) for wide, mark, one, one_mark in found if config.decode(wide or one)]


@dataclass
class Laws:
    """What the search needs of an affix file."""

    switches: frozenset[str]
    most_parts: int
    rules: list[list[tuple[int, str]]]
    patterns: list[tuple[str, int, str, int]]
    root: int
    upper: int
    syllables: int
    vowels: str

    @staticmethod
    def of(config: AffixConfig) -> Laws:
        def half(text: str) -> tuple[str, int]:
            chars, _, flag = text.partition("/")
            return chars, (config.decode(flag) or [0])[0] if flag else 0

        most, vowels = config.syllables or (0, "")
        return Laws(
            frozenset(config.switches), config.numbers.get("COMPOUNDWORDMAX", 0), [rule_tokens(r, config) for r in config.compound_rules],
            [(*half(p[0]), *half(p[1])) for p in config.compound_patterns], config.flag("COMPOUNDROOT"), config.flag("FORCEUCASE"), most, vowels,
        )


def parts(forms: DataFrame, config: AffixConfig) -> DataFrame:
    """Forms that may stand in a compound: ``(surface, entry_id, root, morph, sfx_morph, carried, affixed, first, inner, last, listed)``.

    A flag may come from the entry or from an affix.  Suffixes before another
    part, and prefixes of the last, need the flag that permits them.  ``listed``
    forms are bare entries with a flag of some compound rule.
    """
    carried = F.array_distinct(F.concat("flags", "cont_flags"))
    has = lambda name: F.array_contains(carried, config.flag(name)) if config.flag(name) else F.lit(False)
    allowed = {name: [r[0] for r in config.rules if config.flag(name) in r[8]] if config.flag(name) else [] for name in ("COMPOUNDPERMITFLAG", "COMPOUNDFORBIDFLAG", "COMPOUNDEND")}
    rule_in = lambda c, name: F.coalesce(F.col(c).isin(allowed[name]), F.lit(False)) if allowed[name] else F.lit(False)
    affixed = F.col("kind") != "root"
    suffix_ok = F.col("sfx_rule").isNull() | rule_in("sfx_rule", "COMPOUNDPERMITFLAG")
    prefix_ok = F.col("pfx_rule").isNull() | rule_in("pfx_rule", "COMPOUNDPERMITFLAG")
    if "COMPOUNDMORESUFFIXES" not in config.switches:
        suffix_ok = suffix_ok & F.col("sfx2_rule").isNull()
    ends_only = rule_in("sfx_rule", "COMPOUNDEND") | rule_in("pfx_rule", "COMPOUNDEND")
    barred_rule = rule_in("sfx_rule", "COMPOUNDFORBIDFLAG") | rule_in("pfx_rule", "COMPOUNDFORBIDFLAG")
    # A bare entry so flagged may still come last.
    before = suffix_ok & ~ends_only & ~has("COMPOUNDFORBIDFLAG")
    wanted = sorted({flag for rule in config.compound_rules for flag, _ in rule_tokens(rule, config)})
    listed = ~affixed & (F.arrays_overlap("flags", F.array(*[F.lit(f) for f in wanted])) if wanted else F.lit(False))
    roles = forms.filter(~F.array_contains("flags", ONLY_UPCASE) & ~barred_rule).select(
        "surface", "entry_id", "root", "morph", "sfx_morph", carried.alias("carried"), affixed.alias("affixed"),
        ((has("COMPOUNDFLAG") | has("COMPOUNDBEGIN")) & before).alias("first"),
        ((has("COMPOUNDFLAG") | has("COMPOUNDMIDDLE")) & before).alias("inner"),
        ((has("COMPOUNDFLAG") | has("COMPOUNDEND")) & prefix_ok).alias("last"), listed.alias("listed"),
    )
    return roles.filter((F.col("first") | F.col("inner") | F.col("last") | F.col("listed")) & (F.length("surface") >= least_part(config)))


def readings(word: Column, config: AffixConfig) -> Column:
    """``array<struct<text, at>>``: the word itself (``at`` -1), then what a lost letter or a replaced joint stood for, which must divide at ``at``."""
    n = F.length(word)
    own = F.array(F.struct(word.alias("text"), F.lit(-1).alias("at")))
    inside = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda at: (F.substr(word, F.lit(1), at), F.substr(word, at + 1))
    more = []
    if "SIMPLIFIEDTRIPLE" in config.switches:
        doubled = F.filter(inside, lambda i: (i > 1) & (F.substr(word, i, F.lit(1)) == F.substr(word, i - 1, F.lit(1))))
        more.append(F.transform(doubled, lambda i: F.struct(F.concat(cut(i)[0], F.substr(word, i, F.lit(1)), cut(i)[1]).alias("text"), i.cast("int").alias("at"))))
    for pattern in config.compound_patterns:
        if len(pattern) == 3:
            left, right, joint = pattern[0].partition("/")[0], pattern[1].partition("/")[0], pattern[2]
            here = F.filter(inside, lambda i: F.startswith(F.substr(word, i + 1), F.lit(joint)))  # noqa: B023
            whole = lambda i: F.concat(cut(i)[0], F.lit(left + right), F.substr(word, i + len(joint) + 1))  # noqa: B023, E731
            more.append(F.transform(here, lambda i: F.struct(whole(i).alias("text"), (i + len(left)).cast("int").alias("at"))))  # noqa: B023
    return F.concat(own, *more) if more else own


@dataclass
class Search:
    """Lawful rows of parts of one reading of a word."""

    text: str
    at: int
    edges: list[dict]
    barred: frozenset[int]
    capital: bool
    laws: Laws
    starting: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.n = len(self.text)
        for k, edge in enumerate(self.edges):
            if not edge["s"] < self.at < edge["e"]:
                self.starting.setdefault(edge["s"], []).append(k)

    def joins(self, left: dict, right: dict, by_rule: bool) -> bool:
        text, i, switches = self.text, right["s"], self.laws.switches
        if left["s"] in self.barred:
            return False
        if not by_rule and i != self.at:
            a, b = text[i - 1], text[i]
            if "CHECKCOMPOUNDTRIPLE" in switches and a == b and ((i > 1 and text[i - 2] == a) or text[i + 1 : i + 2] == a):
                return False
            if "CHECKCOMPOUNDCASE" in switches and "-" not in (a, b) and (a.upper() == a or b.upper() == b):
                return False
        if "CHECKCOMPOUNDDUP" in switches and left["entry_id"] == right["entry_id"]:
            return False
        return i == self.at or not any(self.meets(p, left, right) for p in self.laws.patterns)

    def meets(self, pattern: tuple[str, int, str, int], left: dict, right: dict) -> bool:
        end, end_flag, begin, begin_flag = pattern
        if (end_flag and end_flag not in left["carried"]) or (begin_flag and begin_flag not in right["carried"]):
            return False
        after = self.text[right["s"] : right["s"] + len(begin)]
        if len(after) < len(begin) or any(p not in (".", c) for p, c in zip(begin, after)):
            return False
        return not left["affixed"] if end == "0" else self.text[: right["s"]].endswith(end)

    def lawful(self, row: list[int]) -> bool:
        """Limits on a whole row: how many parts or syllables, and capitals that the last part asks for."""
        laws, chosen = self.laws, [self.edges[k] for k in row]
        if laws.upper and laws.upper in chosen[-1]["carried"] and not self.capital:
            return False
        weight = len(chosen) + sum(bool(laws.root) and laws.root in e["carried"] for e in chosen)
        if laws.most_parts and weight > laws.most_parts:
            return bool(laws.syllables) and sum(c in laws.vowels for c in self.text) <= laws.syllables
        return True

    def rows(self, most: int | None) -> Iterator[list[int]]:
        """Rows by flags, of at most ``most`` parts; a place reached before in the same way is not tried again in vain."""
        dead: set[tuple[int, int]] = set()

        def weight(edge: dict) -> int:
            return 1 + (bool(self.laws.root) and self.laws.root in edge["carried"])

        def grow(row: list[int], used: int) -> Iterator[list[int]]:
            left = self.edges[row[-1]]
            if (row[-1], used) in dead:
                return
            any_found = False
            for k in self.starting.get(left["e"], ()):
                right = self.edges[k]
                if not self.joins(left, right, False):
                    continue
                if right["e"] == self.n:
                    if right["last"] and self.lawful([*row, k]):
                        any_found = True
                        yield [*row, k]
                elif right["inner"] and (most is None or len(row) + 2 <= most) and (self.laws.syllables or not self.laws.most_parts or used + weight(right) < self.laws.most_parts):
                    for whole in grow([*row, k], used + weight(right)):
                        any_found = True
                        yield whole
            if not any_found:
                dead.add((row[-1], used))

        for k in self.starting.get(0, ()):
            edge = self.edges[k]
            if edge["first"] and edge["e"] < self.n:
                yield from grow([k], weight(edge))

    def ruled(self) -> Iterator[list[int]]:
        """Rows by compound rules: the parts' flags in the order of a rule."""
        for tokens in self.laws.rules:
            dead: set[tuple[int, int, int]] = set()

            def match(place: int, row: list[int], tokens: list = tokens, dead: set = dead) -> Iterator[list[int]]:
                pos = self.edges[row[-1]]["e"] if row else 0
                if pos == self.n:
                    if len(row) > 1 and all(mark in ("*", "?") for _, mark in tokens[place:]) and self.lawful(row):
                        yield row
                    return
                if place == len(tokens) or (state := (place, row[-1] if row else -1, len(row))) in dead:
                    return
                flag, mark = tokens[place]
                any_found = False
                for k in self.starting.get(pos, ()):
                    edge = self.edges[k]
                    if edge["listed"] and flag in edge["carried"] and (not row or self.joins(self.edges[row[-1]], edge, True)):
                        for whole in match(place if mark == "*" else place + 1, [*row, k]):
                            any_found = True
                            yield whole
                if mark in ("*", "?"):
                    for whole in match(place + 1, row):
                        any_found = True
                        yield whole
                if not any_found:
                    dead.add(state)

            yield from match(0, [])

    def first(self) -> list[int] | None:
        return next(self.rows(None), None) or next(self.ruled(), None)


def with_parts(words: DataFrame, forms: DataFrame, config: AffixConfig) -> DataFrame:
    """``(word, capital, text, at, edges, barred)`` for readings of distinct ``(word, capital)`` with a part at both ends."""
    least = least_part(config)
    known = parts(forms, config)
    longest = known.agg(F.coalesce(F.max(F.length("surface")), F.lit(0))).first()[0]
    read = words.select("word", "capital").distinct().select("word", "capital", F.inline(readings(F.col("word"), config)))
    n = F.length("text")
    open_at = read.filter(n >= 2 * least).withColumn("s", F.explode(F.sequence(F.lit(0), n - least))).filter((F.col("s") == 0) | (F.col("s") >= least))
    spans = open_at.withColumn("e", F.explode(F.sequence(F.col("s") + least, F.least(n, F.col("s") + F.lit(max(longest, least)))))).filter((F.col("e") <= n) & ((F.col("e") == n) | (n - F.col("e") >= least)) & ((F.col("s") > 0) | (F.col("e") < n)))
    if pairs_only(config):
        spans = two_part_spans(read.filter(n >= 2 * least), known, least, longest)
    stretch = spans.withColumn("surface", F.substr("text", F.col("s") + 1, F.col("e") - F.col("s")))
    edge = F.struct("s", "e", "surface", "entry_id", "root", "morph", "sfx_morph", "carried", "affixed", "first", "inner", "last", "listed")
    keys = ["word", "capital", "text", "at"]
    grouped = stretch.join(known, "surface").groupBy(*keys).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    grouped = grouped.filter(F.exists("edges", lambda x: x["s"] == 0) & F.exists("edges", lambda x: x["e"] == F.length("text")))
    if not replaceable(config) and spaced(forms).isEmpty():
        return grouped.withColumn("barred", F.array().cast("array<int>"))
    tails = grouped.select(*keys, F.explode(F.array_distinct(F.transform("edges", lambda x: x["s"]))).alias("s")).withColumn("w", F.substr("text", F.col("s") + 1))
    return grouped.join(barred_tails(tails, forms, config, keys), keys, "left").withColumn("barred", F.coalesce("barred", F.array().cast("array<int>")))


def pairs_only(config: AffixConfig) -> bool:
    """Whether the affix file permits no compound of more than two parts, so that each part is at an end."""
    return config.numbers.get("COMPOUNDWORDMAX", 0) == 2 and not config.syllables


def two_part_spans(read: DataFrame, known: DataFrame, least: int, longest: int) -> DataFrame:
    """Both stretches of each place that divides a reading into two parts: ``s``, ``e``.

    A place goes on only if what is before it may come first and what is after it last.
    """
    n = F.length("text")
    low, high = F.greatest(F.lit(least), n - F.lit(longest)), F.least(n - least, F.lit(longest))
    cuts = read.filter(low <= high).withColumn("cut", F.explode(F.sequence(low, high)))
    may = lambda role, name: known.filter(F.col(role) | F.col("listed")).select(F.col("surface").alias(name)).distinct()
    cuts = cuts.withColumn("_head", F.substr("text", F.lit(1), F.col("cut"))).join(may("first", "_head"), "_head", "left_semi").drop("_head")
    cuts = cuts.withColumn("_tail", F.substr("text", F.col("cut") + 1)).join(may("last", "_tail"), "_tail", "left_semi").drop("_tail")
    both = F.array(F.struct(F.lit(0).alias("s"), F.col("cut").alias("e")), F.struct(F.col("cut").alias("s"), F.length("text").alias("e")))
    return cuts.select("word", "capital", "text", "at", F.inline(both))


def spaced(forms: DataFrame) -> DataFrame:
    """``(w)``: forms of two words, without the space."""
    return forms.filter(F.size(F.split("surface", " ")) == 2).select(F.replace("surface", F.lit(" "), F.lit("")).alias("w"))


def replaceable(config: AffixConfig) -> list[tuple]:
    """The replacements within a word that bar a compound."""
    if "CHECKCOMPOUNDREP" not in config.switches:
        return []
    return [(n, p, False, False, r) for n, p, start, end, r in config.replacements if not start and not end]


def barred_tails(tails: DataFrame, forms: DataFrame, config: AffixConfig, keys: list[str]) -> DataFrame:
    """Places from which a word on is an entry of two words, or one replacement away from a form."""
    asked = tails.select("w").distinct()
    bad = asked.join(spaced(forms).distinct(), "w", "left_semi")
    if free := replaceable(config):
        rules = forms.sparkSession.createDataFrame(free, config.replacements_df(forms.sparkSession).schema)
        near = replaced(asked, rules).join(forms.select(F.col("surface").alias("candidate")).distinct(), "candidate", "left_semi")
        bad = bad.unionByName(near.select("w")).distinct()
    return tails.join(bad, "w", "left_semi").groupBy(*keys).agg(F.collect_set("s").alias("barred"))


FOUND = "word string, capital boolean, parts array<string>, roots array<string>, entry_id bigint, analyses array<string>"


def searching(laws: Laws, every: bool):
    def described(search: Search, row: list[int]) -> str:
        out = []
        for k in row:
            edge = search.edges[k]
            out.append(" ".join(x for x in (f"pa:{edge['surface']}", f"st:{edge['root']}", edge["morph"], edge["sfx_morph"]) if x))
        return " ".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                search = Search(r["text"], r["at"], r["edges"], frozenset(r["barred"]), r["capital"], laws)
                row = search.first()
                if row is not None:
                    two = list(search.rows(2)) if every else []
                    out.append({
                        "word": r["word"], "capital": r["capital"], "parts": [r["edges"][k]["surface"] for k in row], "roots": [r["edges"][k]["root"] for k in row],
                        "entry_id": r["edges"][row[0]]["entry_id"], "analyses": sorted({described(search, x) for x in two or [row]}) if every else [],
                    })
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return run


SCHEMA = pa.schema([("word", pa.string()), ("capital", pa.bool_()), ("parts", pa.list_(pa.string())), ("roots", pa.list_(pa.string())), ("entry_id", pa.int64()), ("analyses", pa.list_(pa.string()))])


def compounds(words: DataFrame, forms: DataFrame, config: AffixConfig, every: bool = False) -> DataFrame:
    """``(word, capital, parts, roots, entry_id, analyses)`` of the words that are compounds.

    ``capital`` of the input (false if absent) says that the word was typed with
    an initial capital.  ``every`` asks for all analyses in two parts, or, where
    there are none, the first in more.  Null words, and words shorter than two
    parts, are no compounds.
    """
    words = words.filter("word IS NOT NULL").select("word", (F.col("capital") if "capital" in words.columns else F.lit(False)).alias("capital"))
    if not enabled(config):
        return words.sparkSession.createDataFrame([], FOUND)
    found = with_parts(words, forms, config).select("word", "capital", "text", "at", "edges", "barred").mapInArrow(searching(Laws.of(config), every), FOUND)
    # A word read in several ways keeps the first; the word as it stands comes before others by its fewer characters.
    best = found.groupBy("word", "capital").agg(F.min(F.struct(F.length(F.array_join("parts", "")).alias("n"), "parts", "roots", "entry_id", "analyses")).alias("b"))
    return best.select("word", "capital", "b.parts", "b.roots", "b.entry_id", "b.analyses")


def analyze_compounds(words: DataFrame, forms: DataFrame, config: AffixConfig) -> DataFrame:
    """``(word, analysis)``: each part's own text, root and description in turn."""
    return compounds(words, forms, config, every=True).select("word", F.explode("analyses").alias("analysis")).distinct()
