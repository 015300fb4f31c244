"""Affix files: options, replacement and equivalence tables, affix rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lexiforge.sources.lines import existing, file_lines

# Defaults of the format.
DEFAULT_KEYBOARD = "qwertyuiop|asdfghjkl|zxcvbnm"
DEFAULT_BREAKS = ("-", "^-", "-$")
DEFAULT_FORBIDDEN, ONLY_UPCASE = 65510, 65511
FLAG_OPTIONS = (
    "COMPOUNDFLAG", "COMPOUNDBEGIN", "COMPOUNDMIDDLE", "COMPOUNDEND", "COMPOUNDROOT", "COMPOUNDPERMITFLAG", "COMPOUNDFORBIDFLAG",
    "ONLYINCOMPOUND", "NOSUGGEST", "NONGRAMSUGGEST", "FORBIDDENWORD", "LEMMA_PRESENT", "CIRCUMFIX", "NEEDAFFIX", "PSEUDOROOT",
    "KEEPCASE", "FORCEUCASE", "WARN", "SUBSTANDARD",
)
NUMBER_OPTIONS = ("COMPOUNDWORDMAX", "COMPOUNDMIN", "MAXNGRAMSUGS", "MAXDIFF", "MAXCPDSUGS")
SWITCHES = (
    "COMPLEXPREFIXES", "FULLSTRIP", "COMPOUNDMORESUFFIXES", "CHECKCOMPOUNDDUP", "CHECKCOMPOUNDREP", "CHECKCOMPOUNDTRIPLE",
    "SIMPLIFIEDTRIPLE", "CHECKCOMPOUNDCASE", "ONLYMAXDIFF", "NOSPLITSUGS", "SUGSWITHDOTS", "FORBIDWARN", "CHECKSHARPS", "CHECKNUM",
)
TEXT_OPTIONS = ("SET", "LANG", "VERSION", "WORDCHARS", "TRY", "KEY", "IGNORE", "SYLLABLENUM")

RULES = "rule_no int, kind string, flag int, cross boolean, strip string, append string, cond string, cond_regex string, cont_flags array<int>, morph string"
REPLACEMENTS = "rule_no int, pattern string, at_start boolean, at_end boolean, replacement string"


@dataclass
class AffixConfig:
    """What an affix file says; unknown directives are ignored."""

    flag_mode: str = "char"
    flags: dict[str, int] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)
    switches: set[str] = field(default_factory=set)
    texts: dict[str, str] = field(default_factory=dict)
    rules: list[tuple] = field(default_factory=list)
    replacements: list[tuple] = field(default_factory=list)
    classes: list[list[str]] = field(default_factory=list)
    breaks: list[str] = field(default_factory=lambda: list(DEFAULT_BREAKS))
    #: As written: an underscore at an end of a pattern binds it to that end of the word, others are blanks.
    input_conversion: list[tuple[str, str]] = field(default_factory=list)
    output_conversion: list[tuple[str, str]] = field(default_factory=list)
    phonetic: list[tuple[str, str]] = field(default_factory=list)
    flag_aliases: list[list[int]] = field(default_factory=list)
    morph_aliases: list[str] = field(default_factory=list)
    compound_rules: list[str] = field(default_factory=list)
    compound_patterns: list[tuple[str, ...]] = field(default_factory=list)
    syllables: tuple[int, str] | None = None

    @property
    def try_chars(self) -> str:
        return self.texts.get("TRY", "")

    @property
    def charset(self) -> str:
        return self.texts.get("SET", "UTF-8")

    @property
    def keyboard(self) -> str:
        return self.texts.get("KEY", DEFAULT_KEYBOARD)

    @property
    def forbidden(self) -> int:
        return self.flags.get("FORBIDDENWORD", DEFAULT_FORBIDDEN)

    def flag(self, name: str) -> int:
        """A flag option's number; 0, which no entry has, if unset."""
        return self.flags.get(name, 0)

    def decode(self, text: str) -> list[int]:
        if self.flag_mode == "num":
            return sorted({int(x) for x in text.split(",") if x.strip().isdigit()})
        if self.flag_mode == "long":
            return sorted({ord(text[i]) * 256 + ord(text[i + 1]) for i in range(0, len(text) - 1, 2)})
        return sorted({ord(c) for c in text})

    def flags_of(self, text: str) -> list[int]:
        """Flags of a field, through the alias table if there is one."""
        if self.flag_aliases and text.isdigit():
            return self.flag_aliases[int(text) - 1] if 0 < int(text) <= len(self.flag_aliases) else []
        return self.decode(text)

    def morph_of(self, text: str) -> str:
        if self.morph_aliases and text.isdigit() and 0 < int(text) <= len(self.morph_aliases):
            return self.morph_aliases[int(text) - 1]
        return text

    def rules_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rules, RULES)

    def replacements_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.replacements, REPLACEMENTS)


def mirrored(config: AffixConfig) -> AffixConfig:
    """The same affixes for words read backwards: prefixes become suffixes and the other way round."""
    rules = []
    for number, kind, flag, cross, strip, append, condition, _, continuation, morph in config.rules:
        other = "SFX" if kind == "PFX" else "PFX"
        back = "".join(reversed(re.findall(r"\[[^\]]*\]|.", condition)))
        rules.append((number, other, flag, cross, strip[::-1], append[::-1], back, condition_regex(other, back), continuation, morph))
    return replace(config, rules=rules, switches=config.switches - {"COMPLEXPREFIXES"})


def condition_regex(kind: str, condition: str) -> str:
    """A condition as a regular expression on the stem before stripping: a suffix's looks at the end, a prefix's at the start."""
    if condition == ".":
        return ""
    parts = re.findall(r"\[[^\]]*\]|.", condition)
    body = "".join(p if p == "." or p[0] == "[" else re.escape(p) for p in parts)
    return f"{body}$" if kind == "SFX" else f"^{body}"


def parse_affix(lines: Iterable[str]) -> AffixConfig:
    """Read the directives in two passes, so that flag encoding and aliases hold wherever they stand in the file."""
    config = AffixConfig()
    rows = [line.lstrip("\ufeff").split() for line in lines]
    rows = [r for r in rows if r and not r[0].startswith("#")]
    for row in rows:
        if row[0] == "FLAG" and len(row) > 1:
            config.flag_mode = {"long": "long", "num": "num", "UTF-8": "char"}.get(row[1], "char")
    seen_breaks: set[str] = set()
    for name, *rest in (r for r in rows if r[0] in ("AF", "AM")):
        table = config.flag_aliases if name == "AF" else config.morph_aliases
        if name == "AF" and rest and (table or not rest[0].isdigit() or "#" in rest):
            table.append(config.decode(rest[0]))
        elif name == "AM" and (table or not (len(rest) == 1 and rest[0].isdigit())):
            table.append(" ".join(rest))
        elif name not in seen_breaks:
            seen_breaks.add(name)  # the count line
    headers: dict[tuple[str, str], bool] = {}
    for name, *rest in rows:
        if not rest:
            if name in SWITCHES:
                config.switches.add(name)
            continue
        value = rest[0]
        if name in FLAG_OPTIONS:
            found = config.decode(value)
            if found:
                config.flags["NEEDAFFIX" if name == "PSEUDOROOT" else name] = found[0]
        elif name in NUMBER_OPTIONS:
            config.numbers[name] = int(value) if value.isdigit() else 0
        elif name in SWITCHES:
            config.switches.add(name)
        elif name in TEXT_OPTIONS:
            config.texts[name] = value
        elif name == "REP" and len(rest) > 1:
            text = value.replace("_", " ")
            start, end = text.startswith("^"), text.endswith("$")
            config.replacements.append((len(config.replacements), text[start : len(text) - end], start, end, rest[1].replace("_", " ")))
        elif name == "MAP" and not value.isdigit():
            config.classes.append([x[1:-1] if x[0] == "(" else x for x in re.findall(r"\([^)]*\)|.", value)])
        elif name == "BREAK":
            if value.isdigit() and "BREAK" not in seen_breaks:
                seen_breaks.add("BREAK")
                config.breaks = []
            else:
                config.breaks.append(value)
        elif name in ("ICONV", "OCONV", "PHONE") and len(rest) > 1:
            table = {"ICONV": config.input_conversion, "OCONV": config.output_conversion, "PHONE": config.phonetic}[name]
            table.append((value, rest[1] if name != "PHONE" else rest[1].replace("_", "")))
        elif name == "COMPOUNDRULE" and not value.isdigit():
            config.compound_rules.append(value)
        elif name == "CHECKCOMPOUNDPATTERN" and len(rest) > 1:
            config.compound_patterns.append(tuple(rest[:3]))
        elif name == "COMPOUNDSYLLABLE" and len(rest) > 1:
            config.syllables = (int(value), rest[1])
        elif name in ("PFX", "SFX"):
            if (name, value) not in headers:
                headers[name, value] = len(rest) > 1 and rest[1] == "Y"
                continue
            strip, append, *more = rest[1:]
            append, _, continuation = append.partition("/")
            condition = more[0] if more else "."
            config.rules.append((
                len(config.rules), name, config.decode(value)[0], headers[name, value], "" if strip == "0" else strip, "" if append == "0" else append,
                condition, condition_regex(name, condition), config.flags_of(continuation) if continuation else [], config.morph_of(" ".join(more[1:])),
            ))
    return config


def load_affix(spark: SparkSession, path: str, key: str | None = None) -> AffixConfig:
    """Parse an affix file, plain or compressed, from any store that Spark reads, in the character set it names; such files are small, so the driver holds it."""
    data = bytes(spark.read.format("binaryFile").load(existing(spark, path)).select("content").first()["content"])
    first = parse_affix(file_lines(data, "ISO8859-1", key))
    return parse_affix(file_lines(data, first.charset, key))
