"""Requests written as XML: analysis, stems, generation, and words to add.

``<query type="..."><word>...</word>...</query>``, where the type is analyze,
stem, generate or add.  A second ``word`` is the example to follow; ``code`` lists
descriptions in ``a`` elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators import morphology

MARK = "<?xml"


def _plain(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\t"), F.lit(" ")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def parse(requests: DataFrame, column: str = "word") -> DataFrame:
    """``(request, type, word, example, codes)`` of distinct requests; what is no query has a null type."""
    text = F.col(column)
    words = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<word[^>]*>([^<]*)"), F.lit(1)), _plain)
    coded = F.regexp_extract(text, r"(?s)<code[^>]*>(.*)", 1)
    kind = F.regexp_extract(text, r"""(?s)<query[^>]*?\btype=["'](analyze|stem|generate|add)["'][^>]*>.*<word""", 1)
    first = F.get(words, F.lit(0))
    usable = (kind != "") & (F.coalesce(first, F.lit("")) != "")
    codes = F.transform(F.regexp_extract_all(coded, F.lit(r"(?s)<a>([^<]*)"), F.lit(1)), _plain)
    read = requests.filter(text.isNotNull()).select(
        text.alias("request"), F.when(usable, kind).alias("type"), first.alias("word"), F.nullif(F.get(words, F.lit(1)), F.lit("")).alias("example"), codes.alias("codes")
    )
    return read.distinct()


def answer(requests: DataFrame, forms: DataFrame, column: str = "word") -> DataFrame:
    """``(request, answers)``: analyses as one ``code`` element, stems or generated forms as a sorted list; empty where there are none.

    Requests to add words answer nothing: ``additions`` lists them.
    """
    asked = parse(requests, column)
    words = asked.filter("type IN ('analyze', 'stem')").select("word").distinct()
    analyses = morphology.analyze(words, forms)
    shown = analyses.groupBy("word").agg(F.array_sort(F.collect_set("analysis")).alias("found"))
    code = F.array(F.concat(F.lit("<code>"), F.array_join(F.transform("found", lambda a: F.concat(F.lit("<a>"), _escaped(a), F.lit("</a>"))), ""), F.lit("</code>")))
    analysed = asked.filter("type = 'analyze'").join(shown, "word").select("request", code.alias("answers"))
    stems = morphology.stem(analyses).groupBy("word").agg(F.array_sort(F.collect_set("stem")).alias("answers"))
    stemmed = asked.filter("type = 'stem'").join(stems, "word").select("request", "answers")
    pairs = asked.filter("type = 'generate' AND example IS NOT NULL").select("request", "word", "example")
    made = pairs.join(morphology.generate(pairs, forms), ["word", "example"]).select("request", "generated")
    coded = asked.filter("type = 'generate' AND example IS NULL").select("request", "word", F.explode("codes").alias("code"))
    made = made.unionByName(coded.join(morphology.generate_described(coded, forms), ["word", "code"]).select("request", "generated"))
    generated = made.groupBy("request").agg(F.array_sort(F.collect_set("generated")).alias("answers"))
    every = analysed.unionByName(stemmed).unionByName(generated)
    return asked.select("request").join(every, "request", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))


def additions(requests: DataFrame, column: str = "word") -> DataFrame:
    """``(word, example)`` of the words to add; ``example`` is null for those without a model."""
    return parse(requests, column).filter("type = 'add'").select("word", "example").distinct()
