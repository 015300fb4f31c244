"""The roots most like a word, by an inverted index of grams with bounds on the score.

A root's score is what :func:`lexiforge.functions.similarity.ngram` counts over
one, two and three characters, plus the common prefix, less a penalty for being
longer.  Roots are posted under each of their grams and their length.  A word
meets the roots that share a gram of three with it, then, where the best ``most``
so far do not rule them out, those that share enough grams of two, then enough
characters, then none:

* bit sets of a root's characters and pairs, met with those of the word, bound
  its score from above without looking at its letters; only pairs whose bound
  reaches the word's present mark, its ``most``-th best score, are scored;
* a root that shares no gram of a level can score no more than the lower levels
  give, which says how many grams of the next level it needs; it must then have
  one of the word's rarest, so that only those are looked up.

A word whose mark is above what unseen roots can reach is done.  Results are
those of scoring every root of the length band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.similarity import common_prefix
from lexiforge.functions.text import INITCAP, lower_cp
from lexiforge.store import written

#: Bits of a bit set of characters and of one of pairs, of which each number holds 64.
LENGTH_BAND, ONES, TWOS = 4, 64, 128
#: Scores of a pair that no word has.
NEVER = -1_000_000
PAIR = ["w", "entry_id", "root"]


def grams(w: Column, j: int) -> Column:
    """The grams of ``j`` characters at each place of a word."""
    n = F.length(w) - (j - 1)
    return F.transform(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(w, i, F.lit(j)))


def bit_sets(found: Column, bits: int, times: int = 1) -> Column:
    """Bits of grams, as an array of 64-bit numbers: those that at least ``times`` grams fall on."""
    fallen = F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(bits)).cast("int"))
    often = F.array_distinct(fallen)
    if times > 1:
        often = F.filter(often, lambda b: F.size(F.filter(fallen, lambda x: x == b)) >= times)
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b % 64)
    part = lambda k: F.aggregate(F.filter(often, lambda b: F.floor(b / 64) == k), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(one(b)))
    return F.array(*[part(k) for k in range(bits // 64)])


def with_bits(df: DataFrame, low: Column, suffix: str = "", times: int = 1) -> DataFrame:
    """Columns ``ones``, ``twos_a`` and ``twos_b`` of a word's bit sets."""
    pairs = bit_sets(grams(low, 2), TWOS, times)
    return df.withColumns({f"ones{suffix}": F.get(bit_sets(grams(low, 1), ONES, times), F.lit(0)), f"twos_a{suffix}": F.get(pairs, F.lit(0)), f"twos_b{suffix}": F.get(pairs, F.lit(1))})


def index_roots(lexicon: DataFrame) -> DataFrame:
    """``(size, gram, clen, entry_id, root, proper, ones, twos_a, twos_b)``: each root under each of its grams of one to three characters.

    Grams are those of the root in lower case, the last three columns its bit
    sets.
    """
    low = lower_cp(F.col("word"))
    proper = (F.col("captype") == INITCAP) & ~F.contains("morph", F.lit("ph:"))
    roots = lexicon.select("entry_id", F.col("word").alias("root"), "clen", proper.alias("proper"), low.alias("low")).distinct()
    roots = with_bits(roots, F.col("low"))
    named = lambda j: F.transform(F.array_distinct(grams(F.col("low"), j)), lambda g: F.struct(F.lit(j).alias("size"), g.alias("gram")))
    every = F.concat(*[named(j) for j in (1, 2, 3)])
    return roots.select("*", F.inline(every)).select("size", "gram", "clen", "entry_id", "root", "proper", "ones", "twos_a", "twos_b")


def word_sets(words: DataFrame) -> DataFrame:
    """Distinct words ``(w, lower, n)`` with their grams ``g1, g2, g3``, their bit sets, those of bits that come twice, and how much comes oftener."""
    w = F.col("w")
    asked = words.select("w", (F.col("lower") if "lower" in words.columns else F.lit(True)).alias("lower")).filter("w <> ''").distinct()
    asked = asked.withColumns({"n": F.length("w"), **{f"g{j}": grams(w, j) for j in (1, 2, 3)}})
    asked = with_bits(with_bits(asked, w), w, "_2", 2)
    count = lambda *names: sum((F.bit_count(x) for x in names), F.lit(0))
    return asked.withColumns({"over1": F.size("g1") - count("ones", "ones_2"), "over2": F.size("g2") - count("twos_a", "twos_a_2", "twos_b", "twos_b_2")})


def most_shared() -> Column:
    """No fewer than the places of a word ``q`` whose character, and whose pair of characters, is in the root ``r``."""
    both = lambda x: F.bit_count(F.col(f"q.{x}").bitwiseAND(F.col(f"r.{x}"))) + F.bit_count(F.col(f"q.{x}_2").bitwiseAND(F.col(f"r.{x}")))
    return both("ones") + F.col("q.over1") + both("twos_a") + both("twos_b") + F.col("q.over2")


def common_start(w: Column, root: Column, most: int) -> Column:
    """The common characters at the start, up to ``most``; the root's in lower case."""
    same = lambda k: F.lower(F.substring(root, k, 1)) == F.substring(w, k, 1)
    out = F.lit(most)
    for k in range(most, 0, -1):
        out = F.when(same(k), out).otherwise(k - 1)
    return out


def penalty() -> Column:
    return F.greatest(F.col("r.clen") - F.col("q.n") - 2, F.lit(0))


def meet(asked: DataFrame, index: DataFrame, size: int, keys: DataFrame) -> DataFrame:
    """Postings ``r`` of the words' ``keys (w, gram, many)`` within the length band, with the words' columns ``q``.

    Keys are few and what they meet is much, so they are dealt to all tasks, as the join wants them.
    """
    lengths = F.explode(F.sequence(F.col("n") - LENGTH_BAND, F.col("n") + LENGTH_BAND)).alias("clen")
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = keys.join(asked, "w").select("*", lengths).repartition(tasks, "gram", "clen").alias("q")
    r = index.filter(F.col("size") == size).alias("r")
    return q.join(r, (F.col("q.gram") == F.col("r.gram")) & (F.col("q.clen") == F.col("r.clen"))).filter(~F.col("q.lower") | ~F.col("r.proper"))


def scored(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``pairs`` with the exact ``score``: each gram of the word is looked for in the root."""
    each = pairs.join(asked.select("w", "n", "g1", "g2", "g3"), "w").withColumn("low", lower_cp(F.col("root")))
    level = lambda j: F.size(F.filter(f"g{j}", lambda g: F.contains("low", g)))
    each = each.withColumns({"s1": level(1), "s2": level(2), "s3": level(3)})
    counted = F.col("s1") + F.when(F.col("s1") >= 2, F.col("s2") + F.when(F.col("s2") >= 2, F.col("s3")).otherwise(0)).otherwise(0)
    score = counted - F.greatest(F.length("low") - F.col("n") - 2, F.lit(0)) + common_prefix(F.col("w"), F.col("root"))
    return each.select(*PAIR, score.cast("int").alias("score"))


def rarest(asked: DataFrame, index: DataFrame, size: int, need: Column) -> DataFrame:
    """``(w, gram, many)``: grams of which a root has at least one if it has those of ``need`` places of the word, the rarest."""
    often = index.filter(F.col("size") == size).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    places = asked.select("w", "n", need.alias("need"), F.explode(grams(F.col("w"), size)).alias("gram")).join(often, "gram")
    order = F.row_number().over(Window.partitionBy("w").orderBy("df", "gram"))
    # Places whose gram no root has are not there to be shared: the word has fewer to lose.
    total = F.count(F.lit(1)).over(Window.partitionBy("w"))
    return places.withColumns({"at": order, "total": total}).filter(F.col("at") <= F.col("total") - F.col("need") + 1).select("w", "gram").distinct().withColumn("many", F.lit(1))


def marked(asked: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """``asked`` with ``mark``: the score of the ``most``-th best found, or NEVER while there are fewer."""
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score")))
    last = found.withColumn("_place", place).filter(F.col("_place") == most).select("w", F.col("score").alias("mark"))
    return asked.drop("mark").join(last, "w", "left").withColumn("mark", F.coalesce("mark", F.lit(NEVER)))


def similar_roots(words: DataFrame, lexicon: DataFrame, most: int = 100, index: DataFrame | None = None) -> DataFrame:
    """``(w, entry_id, root, score, place)``: the ``most`` roots within four characters of length that score best; ties go to the smaller entry.

    Words are in lower case.  Where ``lower`` is true (or absent), capitalised
    roots without a pronunciation are left out.  ``index`` is that of the
    lexicon, computed if not given.  Null and empty words have no roots.
    """
    index = written(index_roots(lexicon), "root-index") if index is None else index
    asked = written(word_sets(words), "asked-words")
    three = asked.select("w", F.explode(grams(F.col("w"), 3)).alias("gram")).groupBy("w", "gram").agg(F.count(F.lit(1)).alias("many"))
    met = meet(asked, index, 3, three)
    bound = most_shared() - penalty()
    pairs = met.select("q.w", "r.entry_id", "r.root", F.col("q.many").alias("many"), bound.alias("bound"), F.col("q.n").alias("n"))
    pairs = pairs.groupBy(*PAIR).agg(F.sum("many").alias("g3"), F.max("bound").alias("bound"), F.max("n").alias("n"))
    # A common start of three or more has all its grams in common.
    start = common_start(F.col("w"), F.col("root"), 3)
    start = F.when(start == 3, F.least(F.col("g3") + 2, F.col("n"))).otherwise(start)
    pairs = written(pairs.select(*PAIR, (F.col("bound") + F.col("g3") + start).alias("bound")), "gram-pairs")
    # A first mark from the pairs with the highest bounds; then all pairs that may reach it.
    first = pairs.withColumn("_place", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("bound"), "entry_id"))).filter(F.col("_place") <= most)
    asked = written(marked(asked, scored(first.select(*PAIR), asked), most), "marked-words")
    good = pairs.join(asked.select("w", "mark"), "w").filter(F.col("bound") >= F.col("mark")).select(*PAIR)
    found = written(scored(good, asked), "scored-roots")
    asked = written(marked(asked, found, most), "marked-words")

    # Roots without a common gram of three share at most two characters at the start.
    need = F.greatest(F.col("mark") - F.col("n") - 2, F.lit(1))
    asked = asked.withColumn("need", need)
    two = asked.filter(F.col("need") <= F.col("n") - 1)
    met = meet(two, index, 2, rarest(two, index, 2, F.col("need"))).filter(most_shared() + common_start(F.col("q.w"), F.col("r.root"), 2) - penalty() >= F.col("q.mark"))
    found = found.unionByName(scored(fresh(met, found), asked))
    found = written(found, "scored-roots")

    # Without a gram of two in common, only characters and the first of them count.
    asked = written(marked(asked.filter("need = 1"), found, most), "marked-words").withColumn("need", F.greatest(F.col("mark") - 1, F.lit(1)))
    one = asked.filter(F.col("need") <= F.col("n"))
    met = meet(one, index, 1, rarest(one, index, 1, F.col("need"))).filter(most_shared() + common_start(F.col("q.w"), F.col("r.root"), 1) - penalty() >= F.col("q.mark"))
    found = written(found.unionByName(scored(fresh(met, found), asked)), "scored-roots")

    # Nothing in common: all that tells such roots apart is how long they are, and their entry.
    rest = written(marked(asked.filter("need = 1"), found, most).filter(F.col("mark") <= 0), "unlike-words")
    if not rest.isEmpty():
        found = found.unionByName(scored(unlike(rest, lexicon, found, most), rest))
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "entry_id", "root"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select("w", "entry_id", "root", "score", "place")


def fresh(met: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct pairs that were not found before."""
    return met.select("q.w", "r.entry_id", "r.root").distinct().join(found.select(*PAIR), PAIR, "left_anti")


def unlike(asked: DataFrame, lexicon: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Pairs of each word and the first roots of each length by entry: ``most`` more than were found of that length."""
    proper = (F.col("captype") == INITCAP) & ~F.contains("morph", F.lit("ph:"))
    roots = lexicon.select("entry_id", F.col("word").alias("root"), "clen", proper.alias("proper")).distinct()
    place = F.row_number().over(Window.partitionBy("clen", "proper").orderBy("entry_id", "root")) - 1
    placed = roots.withColumn("page", F.floor(place / most))
    seen = found.withColumn("clen", F.length("root")).groupBy("w", "clen").agg(F.count(F.lit(1)).alias("seen"))
    lengths = asked.select("w", "lower", F.explode(F.sequence(F.col("n") - LENGTH_BAND, F.col("n") + LENGTH_BAND)).alias("clen")).join(seen, ["w", "clen"], "left")
    pages = lengths.select("w", "lower", "clen", F.explode(F.sequence(F.lit(0), F.ceil(F.coalesce("seen", F.lit(0)) / most).cast("bigint"))).alias("page"))
    return pages.join(placed, ["clen", "page"]).filter(~F.col("lower") | ~F.col("proper")).select(*PAIR).join(found.select(*PAIR), PAIR, "left_anti")
