"""A lexicon that changes: versions of what was touched, merged when read.

A change writes one version: the entries, after it, of the words it touches, and
the forms of these alone.  Nothing else is read but the parts of the lexicon in
which those words lie, and nothing else is expanded.  Reading takes for each word
the entries and forms of its last version, so forms after any number of changes
are those of a rebuild.  ``compact`` writes what reading gives as a new base.

Tables lie in a folder as ``kind/version=v/part=p``; a word's part is a hash of
it.  The list of touched words is written last: a version that was cut off before
it is not seen, and is written anew by the next change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import init_upper, lower_cp
from lexiforge.operators import overlay
from lexiforge.operators.expand import expand
from lexiforge.sources.affix import AffixConfig
from lexiforge.store import _file_system

PARTS = 64
TOUCHED = "word string, version int"


def part_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PARTS)).cast("int")


class VersionedLexicon:
    """Lexicon and forms in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, config: AffixConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    @classmethod
    def create(cls, lexicon: DataFrame, path: str, config: AffixConfig) -> VersionedLexicon:
        """A base of ``lexicon`` and its forms in an empty folder."""
        made = cls(lexicon.sparkSession, path, config)
        made._write("lexicon", lexicon, 0)
        made._write("forms", expand(made._stored("lexicon"), config.rules_df(made.spark), config), 0)
        made._write("touched", lexicon.select("word").limit(0), 0)
        return made

    def _write(self, kind: str, df: DataFrame, version: int) -> None:
        place = f"{self.path}/{kind}/version={version}"
        if kind == "touched":
            df.write.mode("overwrite").parquet(place)
        else:
            df.withColumn("part", part_of(F.col("word" if kind == "lexicon" else "root"))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(place)

    def _versions(self, kind: str) -> list[int]:
        target, files = _file_system(self.spark, f"{self.path}/{kind}")
        return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(target)) if files.exists(target) else []

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}")

    def touched(self) -> DataFrame:
        """``(word, version)``: the last version that touched each word."""
        rows = self.spark.read.schema(TOUCHED).option("basePath", f"{self.path}/touched").parquet(f"{self.path}/touched")
        return rows.groupBy("word").agg(F.max("version").alias("version"))

    @property
    def version(self) -> int:
        return self._versions("touched")[-1]

    def _merged(self, kind: str, word: str, parts: list[int] | None = None) -> DataFrame:
        rows = self._stored(kind)
        if parts is not None:
            rows = rows.filter(F.col("part").isin(parts))
        base = self._versions("touched")[0]
        last = self.touched().select(F.col("word").alias("_word"), F.col("version").alias("_version"))
        old = rows.filter(F.col("version") == base).join(last, F.col(word) == F.col("_word"), "left_anti")
        new = rows.filter(F.col("version") > base).join(last, (F.col(word) == F.col("_word")) & (F.col("version") == F.col("_version")), "left_semi")
        return old.unionByName(new).drop("version", "part")

    def lexicon(self) -> DataFrame:
        return self._merged("lexicon", "word")

    def forms(self) -> DataFrame:
        return self._merged("forms", "root")

    def _change(self, words: DataFrame, models: DataFrame | None, apply) -> int:
        """Write a version in which ``apply`` has changed the entries of ``words (word)`` and of what is hidden behind them; ``models (word)`` are read too."""
        named = words.select("word").filter("word IS NOT NULL")
        keys = named.union(named.select(init_upper(lower_cp(F.col("word"))))).distinct()
        read = keys if models is None else keys.union(models.select("word").filter("word IS NOT NULL")).distinct()
        parts = [r[0] for r in read.select(part_of(F.col("word"))).distinct().collect()]  # at most PARTS numbers
        version = self.version + 1
        current = self._merged("lexicon", "word", parts).join(read, "word", "left_semi")
        self._write("lexicon", apply(current).join(keys, "word", "left_semi"), version)
        written = self._stored("lexicon").filter(F.col("version") == version).drop("version", "part")
        self._write("forms", expand(written, self.config.rules_df(self.spark), self.config), version)
        self._write("touched", keys, version)
        return version

    def add(self, words: DataFrame) -> int:
        """:func:`overlay.add` as a version; returns its number."""
        return self._change(words, None, lambda current: overlay.add(current, words.filter("word IS NOT NULL"), self.config))

    def add_with_affix(self, pairs: DataFrame) -> int:
        """:func:`overlay.add_with_affix` as a version."""
        return self._change(pairs, pairs.select(F.col("example").alias("word")), lambda current: overlay.add_with_affix(current, pairs, self.config))

    def remove(self, words: DataFrame) -> int:
        """:func:`overlay.remove` as a version."""
        return self._change(words, None, lambda current: overlay.remove(current, words, self.config))

    def compact(self) -> None:
        """Write the merged tables as the base of all later versions, then delete what they replace.

        A version that is both base and last is read whole, so a reader that
        comes between the two steps sees the same rows.
        """
        version = self.version + 1
        old = [(kind, v) for kind in ("lexicon", "forms", "touched") for v in self._versions(kind) if v < version]
        for kind, merged in (("lexicon", self.lexicon()), ("forms", self.forms())):
            self._write(kind, merged, version)
        self._write("touched", self.lexicon().select("word").limit(0), version)
        for kind, v in sorted(old, key=lambda x: x[0] != "touched"):
            target, files = _file_system(self.spark, f"{self.path}/{kind}/version={v}")
            files.delete(target, True)
