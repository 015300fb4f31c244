"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Everything is built from DataFrame functions.  The base patterns find
assignments, access keys and hexadecimal strings.  The battery looks at every
other unbroken run of 20 or more key characters.  Separators and padding are
set aside, and the smallest alphabet that holds the rest is the run's encoding.
Three statistics are taken over that alphabet's k symbols, by their indices:

* chi-squared for uniformity over the k symbols;
* runs: changes of class from symbol to symbol, where classes are lower case,
  upper case and digits, or in an alphabet of one class its two halves;
* serial correlation of the indices at lag one.

Each has a law for evenly drawn symbols, which follows from the alphabet, and a
law for ordinary writing in that encoding (``ENCODINGS``).  The null hypothesis is
writing: every statistic becomes a normal score under it, and scores add up
weighted by how far even drawing would move them (the best linear test between
the two laws), so that a statistic tells in one encoding and is silent in another.
A run whose statistics lie beyond the even law's reach on the far side from
writing, as repeated patterns do, is no secret either.

Benjamini-Hochberg runs over all runs of the corpus, within strata of length, on
a histogram of -10 log10 p: short runs, which are many and weakly tested, do not
spend the error budget of long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import fresh_name, materialize

#: Base patterns (fixed by the contract), in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs below 24 characters are dropped; asking for 24 at once finds the same runs without listing every shorter one.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ASIDE = "[=+/_-]"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, smallest alphabet first: (symbols, and of ordinary writing in them: sums of squared and
#: cubed symbol frequencies, chance of a class change, serial correlation).
ENCODINGS = (
    (DIGITS, 0.125, 0.0208, 0.45, 0.1),
    (DIGITS + LOWER[:6], 0.1, 0.0135, 0.2, 0.2),
    (DIGITS + UPPER[:6], 0.1, 0.0135, 0.2, 0.2),
    (LOWER, 0.066, 0.0055, 0.48, -0.05),
    (UPPER, 0.066, 0.0055, 0.48, -0.05),
    (UPPER + DIGITS[2:8], 0.062, 0.005, 0.2, 0.2),
    (LOWER + DIGITS, 0.06, 0.0048, 0.2, 0.2),
    (UPPER + DIGITS, 0.06, 0.0048, 0.2, 0.2),
    (UPPER + LOWER, 0.054, 0.004, 0.2, 0.3),
    (UPPER + LOWER + DIGITS, 0.05, 0.0035, 0.2, 0.3),
)
#: Symbols that a run must have, and standard deviations by which it may be more even than even drawing.
LEAST_SYMBOLS, TOO_EVEN = 16, 4.0
#: Lengths from which a stratum begins.
STRATA = (20, 28, 40, 64)
FALSE_DISCOVERY_RATE = 0.001
MOST_TENTHS = 3000
REDACTED = "[SECRET]"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def sums_before(values: Column) -> Column:
    """For each number the sum of those before it; block by block, so that long arrays stay cheap."""

    def within(x: Column) -> Column:
        grown = F.aggregate(x, F.array(F.lit(0).cast("bigint")), lambda s, v: F.array_append(s, F.element_at(s, -1) + v))
        return F.slice(grown, F.lit(1), F.size(x))

    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda b: F.slice(values, b * width + 1, F.greatest(width, F.lit(1))))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v))
    return F.flatten(F.zip_with(blocks, within(totals), lambda x, t: F.transform(within(x), lambda v: v + t)))


def match_spans(text: Column, pattern: str, kind: int, value_group: int | None = None, least: int = 0) -> Column:
    """Code-point spans of a pattern's leftmost non-overlapping matches whose (group's) length is at least ``least``.

    The gaps between matches come from splitting by the same pattern; sums of
    the gaps and matches before give the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(hits, lambda h: F.length(h).cast("bigint"))
    values = lengths if value_group is None else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda h: F.length(h).cast("bigint"))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint")), F.lit(1), F.size(hits))
    before = sums_before(F.zip_with(gaps, lengths, lambda g, h: g + h))
    begins = F.zip_with(before, gaps, lambda s, g: s + g)
    ends = F.zip_with(begins, lengths, lambda s, h: s + h)
    spans = F.zip_with(F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), values, lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), v.alias("v")))
    found = F.transform(F.filter(spans, lambda x: x["v"] >= least), lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z): a rational approximation near 0, a continued fraction beyond 3."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * a)
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = density / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65)))))
    tail = F.when(a > 3, far).otherwise(near)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(body: Column) -> Column:
    """Alphabet, its even law and writing's law; null for symbols of no alphabet."""

    def law(symbols: str, s2: float, s3: float, change: float, serial: float) -> Column:
        k = len(symbols)
        shares = [len([c for c in symbols if c in part]) / k for part in (DIGITS, LOWER, UPPER)]
        one_class = max(shares) == 1
        if one_class:
            shares = [(k // 2) / k, 1 - (k // 2) / k]
        even = 1 - sum(x * x for x in shares)
        named = {"k": float(k), "s2": s2, "s3": s3, "change": change, "even": even, "serial": serial}
        return F.struct(F.lit(symbols).alias("symbols"), F.lit(one_class).alias("one_class"), *[F.lit(v).alias(n) for n, v in named.items()])

    found = F.lit(None)
    for symbols, *writing in reversed(ENCODINGS):
        found = F.when(F.translate(body, symbols, "") == "", law(symbols, *writing)).otherwise(found)
    return found


def scores(run: Column) -> Column:
    """A run's statistics, each as a normal score under writing (``z``) and where even drawing would have it (``w``); null for few symbols."""
    body = F.regexp_replace(run, ASIDE, "")
    return F.when(F.length(body) >= LEAST_SYMBOLS, _let(F.struct(body.alias("body"), encoding(body).alias("law")), _scores))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scores(x: Column) -> Column:
    body, law = x["body"], x["law"]
    n, k = F.length(body).cast("double"), law["k"]
    symbols = F.slice(F.split(body, ""), F.lit(1), F.length(body))

    # Chi-squared: k / n * sum of squared counts - n; the counts come as coincident pairs.
    pairs = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda s, c: s + _pairs(F.length(body) - F.length(F.replace(body, c, F.lit("")))))
    chi2 = k / n * (n + 2 * pairs) - n
    expected = k * (1 + (n - 1) * law["s2"]) - n
    spread = k / n * 2 * F.sqrt(n * (n - 1) / 2 * (law["s2"] - law["s2"] * law["s2"]) + n * (n - 1) * (n - 2) * (law["s3"] - law["s2"] * law["s2"]))
    even_spread = F.sqrt(2 * (k - 1) * (n - 1) / n)

    at = lambda c: F.instr(law["symbols"], c) - 1
    kind = lambda c: F.when(law["one_class"], (at(c) >= F.floor(k / 2)).cast("int")).when(c < "A", 2).when(c < "a", 3).otherwise(4)
    indices = F.transform(symbols, lambda c: F.struct(at(c).cast("double").alias("at"), kind(c).alias("kind")))
    beside = F.zip_with(
        F.slice(indices, F.lit(1), F.length(body) - 1),
        F.slice(indices, F.lit(2), F.length(body) - 1),
        lambda a, b: F.struct((a["kind"] != b["kind"]).cast("double").alias("change"), ((a["at"] - (k - 1) / 2) * (b["at"] - (k - 1) / 2)).alias("product")),
    )
    changes = F.aggregate(beside, F.lit(0.0), lambda s, p: s + p["change"])
    serial = F.aggregate(beside, F.lit(0.0), lambda s, p: s + p["product"]) / ((n - 1) * (k * k - 1) / 12)
    change_spread = F.sqrt((n - 1) * law["change"] * (1 - law["change"]))
    return F.struct(
        F.length(body).alias("n"),
        ((chi2 - expected) / spread).alias("z1"), ((k - 1 - expected) / spread).alias("w1"),
        ((changes - (n - 1) * law["change"]) / change_spread).alias("z2"), ((n - 1) * (law["even"] - law["change"]) / change_spread).alias("w2"),
        ((serial - law["serial"]) * F.sqrt(n - 1)).alias("z3"), (-law["serial"] * F.sqrt(n - 1)).alias("w3"),
        # Patterns repeated by rule are more even, or change and alternate more, than chance allows.
        ((chi2 - (k - 1)) / even_spread).alias("u1"), ((changes - (n - 1) * law["even"]) / F.sqrt((n - 1) * law["even"] * (1 - law["even"]))).alias("u2"), (serial * F.sqrt(n - 1)).alias("u3"),
    )


def battery(run: Column) -> Column:
    """-10 log10 of the p-value of a run under ordinary writing, as a whole number from 0 to MOST_TENTHS."""

    def tenths(s: Column) -> Column:
        total = (s["w1"] * s["z1"] + s["w2"] * s["z2"] + s["w3"] * s["z3"]) / F.sqrt(s["w1"] * s["w1"] + s["w2"] * s["w2"] + s["w3"] * s["w3"])
        regular = (s["u1"] < -TOO_EVEN) | (s["u2"] > TOO_EVEN) | (F.abs(s["u3"]) > TOO_EVEN)
        p = F.when(regular, F.lit(1.0)).otherwise(upper_tail(total))
        return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(MOST_TENTHS)).cast("int")

    return _let(scores(run), lambda s: F.when(s.isNull(), 0).otherwise(tenths(s)))


def _pairs(count: Column) -> Column:
    return (count * (count - 1)).cast("double") / 2


def stratum(length: Column) -> Column:
    found = F.lit(0)
    for number, least in enumerate(STRATA[1:], 1):
        found = F.when(length >= least, number).otherwise(found)
    return found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``tested_spans`` (runs outside base spans, with stratum and evidence) to ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(match_spans(whole, ASSIGN, 0, 2, LEAST_ASSIGN), match_spans(whole, ACCESS, 1, None, LEAST_ACCESS), match_spans(whole, HEX, 2))
    runs = fresh_name(docs, "runs")
    found = docs.withColumns({"base_spans": F.array_sort(base), runs: match_spans(whole, CANDIDATE, 3)})
    free = F.filter(runs, lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.withColumn(runs, free)

    def tested(c: Column) -> Column:
        run = F.substring(whole, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int"))
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), stratum(c["end"] - c["start"]).alias("stratum"), battery(run).alias("tenths"))

    return found.withColumn("tested_spans", F.transform(runs, tested)).drop(runs)


def thresholds(scanned: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> dict[int, int]:
    """The least evidence (in tenths) that Benjamini-Hochberg accepts in each stratum; strata without discoveries are absent."""
    counts = scanned.select(F.explode("tested_spans").alias("c")).groupBy("c.stratum", "c.tenths").agg(F.count(F.lit(1)).alias("many"))
    up = Window.partitionBy("stratum").orderBy(F.col("tenths").desc())
    table = counts.withColumns({"above": F.sum("many").over(up), "tests": F.sum("many").over(Window.partitionBy("stratum"))})
    passed = table.filter(F.pow(F.lit(10.0), -F.col("tenths") / 10) * F.col("tests") <= F.lit(rate) * F.col("above"))
    return {r["stratum"]: r["least"] for r in passed.groupBy("stratum").agg(F.min("tenths").alias("least")).collect()}  # one row for each stratum


def secret_spans(scanned: DataFrame, accepted: dict[int, int]) -> DataFrame:
    """Replace ``tested_spans`` by ``spans``: base spans and accepted runs by start, then kind."""

    def passes(c: Column) -> Column:
        any_ = F.lit(False)
        for number, least in accepted.items():
            any_ = any_ | ((c["stratum"] == number) & (c["tenths"] >= least))
        return any_

    more = F.transform(F.filter("tested_spans", passes), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base_spans", more))).drop("tested_spans")


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (start, kind number, end in code points); the whole of each text is scanned.

    Columns but ``text`` pass through the written intermediate table as they
    are; leave out the text beforehand with :func:`scan` where it is not needed
    again.  Null texts are empty and have no spans.  Repeated rows are scanned
    each for itself; each counts as a test.
    """
    scanned = materialize(scan(docs.drop("base_spans", "tested_spans", "spans")), "scanned")
    return secret_spans(scanned, thresholds(scanned, rate))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(found: DataFrame, text: str = "text", mark: str = REDACTED) -> DataFrame:
    """Replace each found span in the text by ``mark``; overlapping spans are replaced as one."""
    return found.withColumn(text, redacted(F.col(text), F.col("spans"), mark)).drop("spans", "base_spans")


def redacted(whole: Column, spans: Column, mark: str = REDACTED) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kept = F.substring(whole, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        fresh = F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(kept, F.lit(mark))).alias("out"))
        longer = F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))
        return F.when(x["start"] >= s["at"], fresh).otherwise(longer)

    done = F.aggregate(spans, start, step, lambda s: F.array_join(F.array_append(s["out"], F.substring(whole, (s["at"] + 1).cast("int"), F.length(whole))), ""))
    return F.when(F.size(spans) > 0, done).otherwise(whole)
