"""Quality rules: exact counts of each text, and a hashed n-gram log-likelihood ratio.

Words and punctuation runs, and pairs of neighbours, are hashed into buckets.
Bucket shares among trusted documents over those in the raw corpus give one
log-likelihood ratio a bucket; a document's score is their mean over its
n-grams.  A fixed threshold on the score decides every document.

Texts are read once: their counts and the bucket of each token, two bytes each,
are written as a narrow table, from which pairs follow.  That table is read for
the bucket counts and again for the scores.  The ratio table has
``2 * BUCKETS`` entries whatever the corpus, and reaches the documents as a
scalar subquery.  All of it is DataFrame functions; words never leave their row
except as counts by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm._common import WORD, fresh_name, materialize

#: An odd number of 32 bits without a pattern, for multiplicative hashing.
MULTIPLIER = 2_654_435_761
#: A power of two.
BUCKETS = 1 << 13
#: Documents whose mean log-likelihood ratio is below this are dropped.
THRESHOLD = -0.25
SMOOTHING = 1.0
#: Runs of letters and numbers of any script, and runs of other characters but ASCII white space, in lower-case text.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
#: Trusted ids that are broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def text_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text has no words."""
    docs = docs.drop(*RESULTS[:5])
    whole, split, lined, hashed, placed, starts = (fresh_name(docs, c) for c in ("whole", "words", "lines", "windows", "sorted", "starts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.withColumns({whole: text, split: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))})
    w = F.col(split)
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        *docs.columns,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        lines.alias(lined),
        windows.alias(hashed),
    )
    in_order = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct(hashed)) < F.size(hashed)
    counted = counted.withColumn(placed, F.when(twice, in_order))
    s = F.col(placed)
    again = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    counted = counted.withColumn(starts, F.sort_array(F.transform(again, lambda x: x["i"])))
    # Words covered by windows at sorted starts: up to 3 each, fewer where the next window begins sooner.
    covered = F.aggregate(
        F.col(starts),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("words")),
        lambda a, p: F.struct(p.alias("last"), (a["words"] + F.least(F.lit(3), p - a["last"])).alias("words")),
        lambda a: a["words"],
    )
    return counted.select(
        *docs.columns,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size(lined) - F.size(F.array_distinct(lined))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def token_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each of a text's tokens, in order."""
    kind = "smallint" if buckets <= 1 << 15 else "int"
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND(F.lit(buckets - 1)).cast(kind))


def pair(a: Column, b: Column, buckets: int) -> Column:
    """The bucket of a pair of neighbours, from ``buckets`` on: the middle bits of a multiple of both numbers side by side."""
    mixed = F.shiftright((a.cast("bigint") * buckets + b.cast("bigint")) * MULTIPLIER, 16)
    return mixed.bitwiseAND(F.lit(buckets - 1).cast("bigint")).cast("int") + buckets


def features(ones: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of tokens, then of pairs."""
    shorter = F.greatest(F.size(ones) - 1, F.lit(0))
    twos = F.zip_with(F.slice(ones, F.lit(1), shorter), F.slice(ones, F.lit(2), shorter), lambda a, b: pair(a, b, buckets))
    return F.concat(F.transform(ones, lambda x: x.cast("int")), twos)


def ratio_table(marked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with an array: the log-likelihood ratio of each bucket, trusted over raw, from ``marked (ones, trusted)``.

    Tokens and pairs are two multinomials, each smoothed by SMOOTHING a bucket.
    Without trusted documents all ratios are what smoothing leaves.
    """
    places = F.when(F.size("ones") > 0, F.sequence(F.lit(0), F.size("ones") - 1))
    each = marked.select("ones", "trusted", F.explode(places).alias("i"))
    one, following = F.get("ones", F.col("i")), F.get("ones", F.col("i") + 1)
    tally = lambda rows: rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good"))
    counts = tally(each.select(one.cast("int").alias("bucket"), "trusted"))
    counts = counts.unionByName(tally(each.select(pair(one, following, buckets).alias("bucket"), "trusted").filter(F.col("bucket").isNotNull())))
    every = marked.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").fillna(0, ["raw", "good"]).withColumn("pairs", F.col("bucket") >= buckets)
    within = Window.partitionBy("pairs")  # BUCKETS rows each
    share = lambda c: F.log((F.col(c) + SMOOTHING) / (F.sum(c).over(within) + SMOOTHING * buckets))
    ratio = F.when(F.sum("good").over(within) == 0, F.lit(0.0)).otherwise(share("good") - share("raw"))
    return full.withColumn("ratio", ratio).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, keep_text: bool = False) -> DataFrame:
    """``docs`` with the counts, ``llr``, ``base_failed`` and ``kept``; the texts only with ``keep_text``.

    ``trusted (doc_id)`` names the documents that stand for the target; a null
    id names none.  Texts without tokens score 0.  Repeated rows are judged
    alike.  Input columns with a result's name are replaced.
    """
    docs = docs.drop(*RESULTS)
    ones, marks, ratios = (fresh_name(docs, c) for c in ("ones", "trusted", "ratios"))
    counted = text_counts(docs.withColumn(ones, token_buckets(F.col("text"), buckets)))
    stored = materialize(counted if keep_text else counted.drop("text"), "judged")
    ids = trusted.select(F.col("doc_id").alias(marks)).filter(F.col(marks).isNotNull()).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = stored.select("doc_id", F.col(ones).alias("ones")).join(ids, F.col("doc_id") == F.col(marks), "left").select("ones", F.col(marks).alias("trusted"))
    scored = stored.withColumn(ratios, materialize(ratio_table(marked, buckets), "ratios").scalar())
    found = features(F.col(ones), buckets)
    total = F.aggregate(found, F.lit(0.0), lambda s, f: s + F.get(F.col(ratios), f))
    many = 2 * F.size(ones) - 1
    scored = scored.withColumn("llr", F.when(many > 0, total / many).otherwise(F.lit(0.0))).drop(ones, ratios)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
