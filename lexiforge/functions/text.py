"""Scalar functions of one word, as columns.

Everything works on code points.  Case is mapped character by character, since
whole-string lower() turns a last sigma into its final form.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NOCAP, INITCAP, ALLCAP, HUHCAP, HUHINITCAP = range(5)
#: Longest accepted word, in UTF-8 bytes.
MOST_BYTES = 300

# Latin spelling to Greek, in the order in which rules apply.
GREEK_DIGRAPHS = (
    ("sh", "σ̆"), ("Sh", "Σ̆"), ("ch", "τσ̆"), ("Ch", "Τσ̆"), ("ps", "ψ"), ("Ps", "Ψ"), ("ks", "ξ"), ("Ks", "Ξ"),
    ("Th", "Θ"), ("th", "θ"), ("yi", "γι"), ("Yi", "Γι"), ("ngk", "γκ"), ("ng", "γκ"), ("ths", "τησ"), ("Ths", "Τησ"),
    ("j", "τζ̆"), ("J", "Τζ̆"), ("b", "μπ"), ("B", "Μπ"),
)
# Letters that become one letter each.
GREEK_LETTERS = ("aAiIeEoOuUyYwWrRtTpPsSdDfFgGhHkKlLzZxXcCvVnNmM3", "αΑιΙεΕοΟυΥυΥωΩρΡτΤπΠσΣδΔφΦγΓηΗκΚλΛζΖχΧκΚβΒνΝμΜξ")
# Vowels whose runs make syllables; accented ones do not count.
GREEK_VOWELS = "αειυηοω"
# Words with one spelling whatever was typed.
OVERRIDES = {
    "me": "με", "με": "με", "gia": "για", "yia": "για", "για": "για", "na": "να", "να": "να", "sou": "σου", "σου": "σου",
    "mou": "μου", "μου": "μου", "pou": "που", "που": "που", "en": "εν", "εν": "εν", "η": "η", "h": "η", "ο": "ο", "o": "ο",
}
# Dead keys, the letters that take their mark, and the marks.
ACCENT_KEYS = (
    ("˘", "σζξψςΣΖΞΨ", "\u0306"),
    (" ̈", "ιίυύΙΊΥΎ", "\u0308"),
    ("΅", "ιυΙΥ", "\u0308\u0301"),
    ("΅", "ϊϋΪΫ", "\u0301"),
    ("΅", "ίύΊΎ", "\u0308"),
    ("΄", "αειηυοωϋϊὀΑΕΙΗΥΟΩΫΪὈ", "\u0301"),
)


def chars(w: Column) -> Column:
    """The code points of a word; an empty word has none."""
    return F.filter(F.split(w, ""), lambda c: c != "")


def lower_cp(w: Column) -> Column:
    return F.array_join(F.transform(F.split(w, ""), lambda c: F.lower(c)), "")


def upper_cp(w: Column) -> Column:
    """Upper case by character; characters that would become several stay."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(w, ""), one), "")


def init_upper(w: Column) -> Column:
    return F.concat(upper_cp(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))


def init_lower(w: Column) -> Column:
    return F.concat(lower_cp(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))


def captype(w: Column) -> Column:
    """0 no capitals, 1 initial, 2 all, 3 mixed, 4 mixed with an initial capital; caseless characters count as neutral."""
    capital = lambda c: F.lower(c) != c
    letters = F.split(w, "")
    capitals = F.size(F.filter(letters, capital))
    neutral = F.size(F.filter(letters, lambda c: F.upper(c) == F.lower(c)))
    first = capital(F.substring(w, 1, 1))
    return (
        F.when(capitals == 0, NOCAP)
        .when((capitals == 1) & first, INITCAP)
        .when((capitals == F.length(w)) | (capitals + neutral == F.length(w)), ALLCAP)
        .when((capitals > 1) & first, HUHINITCAP)
        .otherwise(HUHCAP)
    )


def clean_word(w: Column, ignore: str = "") -> Column:
    """``struct(word, dots)``: without ignored characters, leading blanks and trailing dots, whose number is kept."""
    kept = F.ltrim(F.translate(w, ignore, "") if ignore else w)
    bare = F.rtrim(kept, F.lit("."))
    return F.struct(bare.alias("word"), (F.length(kept) - F.length(bare)).alias("dots"))


def conversions(pairs: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Patterns, longest first, each with its output within a word, at its start, at its end, and as the whole of it."""
    table: dict[str, list[str]] = {}
    for pattern, out in pairs:
        start, end = pattern.startswith("_"), len(pattern) > 1 and pattern.endswith("_")
        plain = pattern[start : len(pattern) - end].replace("_", " ")
        if plain:
            table.setdefault(plain, ["", "", "", ""])[start + 2 * end] = out.replace("_", " ")
    found = []
    for plain, (inner, first, last, whole) in sorted(table.items(), key=lambda e: -len(e[0])):
        found.append((plain, [inner, first or inner, last or inner, whole or last or first or inner]))
    return found


def convert(w: Column, pairs: list[tuple[str, str]]) -> Column:
    """A word rewritten from left to right: at each place the longest pattern there is replaced by what its position calls for."""
    table = conversions(pairs)
    if not table:
        return w
    n = F.length(w)

    def step(s: Column, i: Column) -> Column:
        here = F.struct((i + 1).alias("at"), F.concat(s["out"], F.substr(w, i, F.lit(1))).alias("out"))
        for plain, (inner, first, last, whole) in reversed(table):
            ends, starts = i + len(plain) == n + 1, i == 1
            out = F.when(ends & starts, whole).when(ends, last).when(starts, first).otherwise(inner)
            rewritten = F.struct((i + len(plain)).alias("at"), F.concat(s["out"], out).alias("out"))
            here = F.when(F.substr(w, i, F.lit(len(plain))) == plain, F.when(out != "", rewritten).otherwise(F.struct((i + 1).alias("at"), F.concat(s["out"], F.substr(w, i, F.lit(1))).alias("out")))).otherwise(here)
        return F.when(s["at"] == i, here).otherwise(s)

    places = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])


def reverse_word(w: Column) -> Column:
    """The code points in reverse, as dictionaries with complex prefixes store words."""
    return F.reverse(w)


def sharp_forms(w: Column, most: int = 5) -> Column:
    """All ways to read some of the first ``most`` ``ss`` of a lower-case word as sharp s; none for words without."""
    parts = F.split(w, "ss")
    several = lambda x, i: F.when(i <= most, F.flatten(F.transform(x["forms"], lambda f: F.array(F.concat(f, F.lit("ß"), F.get(parts, i)), F.concat(f, F.lit("ss"), F.get(parts, i))))))
    start = F.struct(F.slice(parts, F.lit(1), F.lit(1)).alias("forms"))
    grown = lambda x, i: F.struct(F.coalesce(several(x, i), F.transform(x["forms"], lambda f: F.concat(f, F.lit("ss"), F.get(parts, i)))).alias("forms"))
    count = F.size(parts) - 1
    forms = F.aggregate(F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), start, grown, lambda x: x["forms"])
    return F.filter(forms, lambda f: f != w)


def is_number(w: Column) -> Column:
    """Digits with single inner separators."""
    return F.regexp_like(w, F.lit("^[0-9]+([.,-][0-9]+)*$"))


def fits(w: Column) -> Column:
    return F.octet_length(w) < MOST_BYTES


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Accented letters and the plain ones they decompose to, then combining marks, which go."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and all(unicodedata.combining(c) for c in plain[1:]):
            pairs.append((chr(code), plain[0]))
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def fold(w: Column) -> Column:
    """Without accents."""
    return F.translate(w, *fold_table())


def syllables(w: Column, vowels: str = GREEK_VOWELS) -> Column:
    return F.regexp_count(lower_cp(w), F.lit(f"[{vowels}]+"))


def greekify(w: Column) -> Column:
    for latin, greek in GREEK_DIGRAPHS:
        w = F.replace(w, F.lit(latin), F.lit(greek))
    return F.translate(w, *GREEK_LETTERS)


def distance(a: Column, b: Column) -> Column:
    """Edit distance without case and accents."""
    return F.levenshtein(fold(lower_cp(a)), fold(lower_cp(b))).cast("double")


def sound_key(w: Column) -> Column:
    """A Greek word reduced to what a transliteration can tell apart."""
    w = lower_cp(w)
    for pair in ("ει", "εί", "οι", "οί"):
        w = F.replace(w, F.lit(pair), F.lit("ι"))
    return F.replace(fold(w), F.lit("η"), F.lit("ι"))


def override(w: Column) -> Column:
    """The fixed spelling of a word, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in OVERRIDES.items() for x in pair]), w)


def final_sigma(w: Column) -> Column:
    """Final sigma at the end of a word and nowhere else; a breve stays with its letter."""
    inner = F.regexp_replace(w, "ς(\u0306?)(?=\\p{L})", "σ$1")
    return F.regexp_replace(inner, "(?<=\\p{L}|\u0306)σ(\u0306?)$|^σ(\u0306?)$", "ς$1$2")


def compose_accents(w: Column) -> Column:
    """Apply dead keys typed after their letters; a key after any other letter is dropped."""
    for key, hosts, marks in ACCENT_KEYS:
        w = F.regexp_replace(w, f"([{hosts}]){key}", f"$1{marks}")
    for key in dict.fromkeys(key for key, _, _ in ACCENT_KEYS):
        w = F.replace(w, F.lit(key), F.lit(""))
    return w


def punctuation_first(w: Column) -> Column:
    return F.regexp_like(w, F.lit("^\\P{L}"))


def capital_first(w: Column) -> Column:
    """Only the first letter is a capital."""
    return (w != lower_cp(w)) & (F.substr(w, F.lit(2)) == lower_cp(F.substr(w, F.lit(2))))


def first_in_sentence(context: Column, word: Column) -> Column:
    """Whether the last sentence of the text before the cursor consists of the word alone."""
    parts = F.filter(F.split(context, "[.!?…;·]"), lambda x: F.trim(x) != "")
    return F.coalesce(F.trim(F.element_at(F.when(F.size(parts) > 0, parts), -1)) == word, F.lit(False))


def decode_flags(s: Column, mode: str = "char") -> Column:
    """Flag numbers of a flag field, ascending and distinct: ``char`` or ``utf8`` (one character each), ``long`` (two), ``num`` (comma-separated)."""
    if mode == "num":
        found = F.transform(F.split(s, ","), lambda x: F.try_to_number(F.trim(x), F.lit("99999")).cast("int"))
    elif mode == "long":
        found = F.transform(F.regexp_extract_all(s, F.lit("(?s)(..)"), F.lit(1)), lambda x: F.ascii(F.substring(x, 1, 1)) * 256 + F.ascii(F.substring(x, 2, 1)))
    else:
        found = F.transform(chars(s), lambda x: F.ascii(x))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), F.array().cast("array<int>"))


def encode_flag(flag: Column, mode: str = "char") -> Column:
    if mode == "num":
        return flag.cast("string")
    if mode == "long":
        return F.concat(F.char(F.floor(flag / 256).cast("bigint")), F.char((flag % 256).cast("bigint")))
    return F.char(flag.cast("bigint"))


def field(morph: Column, tag: str) -> Column:
    """The values of a tag in a morphological description, in order."""
    return F.regexp_extract_all(morph, F.lit(rf"(?:^|\s){tag}:(\S*)"), F.lit(1))
