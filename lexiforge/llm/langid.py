"""Language identification by word-first backoff.

A word that the model knows is scored by its log relative frequency in each
language.  An unseen word is scored by its character n-grams instead: the
longest order at which any of its n-grams is known counts, as the mean over
those n-grams; shorter orders are tried down to single characters.  A text's
score in a language is the sum over its words.  What a language lacks costs
that model's penalty.

The model is fitted on a bounded sample of labelled texts
(``TRAIN_PER_LANG`` texts of each language, the first ones by a hash of id and
text) and keeps every entry of it, so its size is bounded by the sample's and it
is broadcast.  Every text is scored whole, by the sum over all its words; no
language is left out, however many there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexiforge.llm._common import limit_batches, materialize, release

UNKNOWN = "und"
#: Runs of word characters but decimal digits and the underscore; few hold other numbers.
WORD_RUNS = re.compile(r"[^\W\d_]+")
OTHER_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")
ORDERS = (5, 4, 3, 2, 1)
#: Bounds of the sample: labelled texts of a language and in all.
TRAIN_PER_LANG, TRAIN_ROWS = 500, 100_000
#: Log-frequency (base 10) of what a language's model lacks.
PENALTY = -7.0
#: Scored words after which the cache starts over, and texts scored at a time.
CACHE, BLOCK = 100_000, 256


def word_counts(text: str | None) -> Counter:
    """How often each word occurs: a run of letters of any script, in lower case."""
    counts = Counter(WORD_RUNS.findall((text or "").lower()))
    for run in [run for run in counts if not run.isalpha()]:
        times = counts.pop(run)
        for word in filter(None, OTHER_NUMBERS.split(run)):
            counts[word] += times
    return counts


@dataclass
class Model:
    """Log-frequencies by entry: a row of ``values`` for each, a column for each language in ``langs``."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    values: np.ndarray
    #: Scored words: their rows in a table of scores, a column for each language.
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def found(self, word: str) -> list[int]:
        """The rows of ``values`` whose mean is the word's score; none where nothing of it is known."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        marked = f"<{word}>"
        for n in ORDERS:
            grams = [marked] if len(marked) <= n else [marked[i : i + n] for i in range(len(marked) - n + 1)]
            found = [v for g in grams if (v := self.grams.get(g)) is not None]
            if found:
                return found
        return []

    def learn(self, words: list[str]) -> None:
        """Score words that the cache lacks."""
        at, sizes = [], np.zeros(len(words), np.int64)
        for row, word in enumerate(words):
            found = self.found(word)
            at += found
            sizes[row] = len(found)
            self.rows[word] = len(self.rows)
        owner = np.repeat(np.arange(len(words)), sizes)
        scores = np.empty((len(words), len(self.langs)))
        for lang in range(len(self.langs)):
            scores[:, lang] = np.bincount(owner, self.values[at, lang], len(words)) / np.maximum(sizes, 1)
        scores[sizes == 0] = PENALTY
        self.table = scores if self.table is None else np.concatenate([self.table, scores])

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of the highest sum of scores and its share of the probability; ties go to the first language by name."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        judged = []
        for first in range(0, len(texts), BLOCK):
            if len(self.rows) > CACHE:
                self.rows, self.table = {}, None
            counted = list(map(word_counts, texts[first : first + BLOCK]))
            if unseen := list(dict.fromkeys(word for counts in counted for word in counts if word not in self.rows)):
                self.learn(unseen)
            for counts in counted:
                if not counts:
                    judged.append((UNKNOWN, 0.0))
                    continue
                total = np.fromiter(counts.values(), np.float64, len(counts)) @ self.table[[self.rows[word] for word in counts]] * math.log(10)
                best = int(np.argmax(total))
                judged.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return judged


def remainder(doc_id: Column, of: int) -> Column:
    """CRC-32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(of)).cast("int")


def training_sample(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, most_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``per_lang`` labelled texts of each language: ``(lang, text)``.

    Where languages are many, each has fewer, down to one, so that all together
    have ``most_rows`` and none is left out.  Rows are taken by a hash of id and
    text: those below a share that the number of the language's distinct hashes
    sets, and of these the first ones.  So no language is sorted in one task,
    however many rows it has; rows that repeat are limited before they are dealt.
    """
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", order.alias("_order"))
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("_order").alias("many")), "lang-rows")
    take = max(1, min(per_lang, most_rows // max(1, counts.count())))
    share = counts.select(F.col("lang").alias("_lang"), (F.lit(1.5 * take + 20) / F.col("many")).alias("_share"))
    near = rows.join(share, F.col("lang") == F.col("_lang")).filter(F.col("_order") <= F.col("_share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id", "text"))
    return near.withColumn("_place", place).filter(F.col("_place") <= take).select("lang", "text")


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, entry, n): kind 0 for words, else the order of an n-gram."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, times in word_counts(text).items():
                counts[lang, 0, word] += times
                marked = f"<{word}>"
                for n in ORDERS:
                    if len(marked) <= n:
                        counts[lang, n, marked] += times
                    else:
                        for i in range(len(marked) - n + 1):
                            counts[lang, n, marked[i : i + n]] += times
        if counts:
            langs, kinds, entries = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(kinds, pa.int32()), pa.array(entries), pa.array(counts.values(), pa.int64())], ["lang", "kind", "entry", "n"])


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """Fit on ``docs (doc_id, text, lang)``; rows with null text or lang are not used.

    Without labelled rows the model knows no language and finds every text unknown.
    Rows that repeat are learnt as often as the sample takes them.
    """
    sample = materialize(training_sample(docs, per_lang), "lang-sample")
    counts = sample.mapInArrow(counted, "lang string, kind int, entry string, n bigint").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "lang-counts")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    logs = counts.join(totals, ["lang", "kind"])
    # One row an entry: a gram of several orders takes its highest frequency.
    one = logs.groupBy((F.col("kind") > 0).alias("gram"), "entry", "lang").agg(F.max(F.log10(F.col("n") / F.col("total"))).alias("log"))
    rows = one.groupBy("gram", "entry").agg(F.map_from_entries(F.collect_list(F.struct("lang", "log"))).alias("logs"))
    langs = [r["lang"] for r in totals.select("lang").distinct().orderBy("lang").collect()]
    each = [F.coalesce(F.try_element_at("logs", F.lit(lang)), F.lit(PENALTY)) for lang in langs]
    table = rows.select("gram", "entry", F.array(*each).cast("array<double>").alias("values")).orderBy("gram", "entry").toArrow()  # the entries of at most TRAIN_ROWS texts
    release(sample, counts)
    split = table["gram"].to_pylist().index(True) if len(table) else 0
    entries = table["entry"].to_pylist()
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["values"].chunks]).reshape(-1, len(langs)) if len(table) else np.zeros((0, 0))
    words, grams = ({entry: row for row, entry in part} for part in (enumerate(entries[:split]), enumerate(entries[split:], split)))
    return Model(langs, words, grams, values)


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; all other columns pass through.

    A null text, or one without letters, is ``und`` with score 0; input columns
    of the two names are replaced.  Repeated rows are judged alike.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.drop(lang, score)
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = own.score(batch.column(at).to_pylist())
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, lang, score])

    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(judge, schema)
