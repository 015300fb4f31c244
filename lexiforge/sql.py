"""A lexicon for queries written in SQL alone: views of its tables, and table functions of a word for ``LATERAL``.

The functions are SQL themselves, so Spark turns a lateral call into joins on the
distinct words asked: nothing runs for each row, and no Python.  All names start
with a prefix, so that several lexicons can be registered in a session.

========================  =============================================================
``P_forms``               view ``(surface, root, kind, analysis, sig, ...)``
``P_entries``             view of the lexicon
``P_surfaces``            view ``(surface)`` of what may be suggested
``P_lookup(w)``           table ``(surface, root, kind)``: forms that make ``w`` right
``P_analyze(w)``          table ``(analysis)``
``P_stem(w)``             table ``(stem)``
``P_generate(w, like)``   table ``(generated)``: forms of the root of ``w`` inflected as ``like``
``P_near(w)``             table ``(suggestion, distance)``: forms at most one edit away
``P_two_words(w)``        table ``(head, tail)``: cuts of ``w`` into two forms
========================  =============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import ALLCAP, INITCAP
from lexiforge.operators import morphology, suggest
from lexiforge.sources.affix import ONLY_UPCASE, AffixConfig


def forms_view(forms: DataFrame, config: AffixConfig) -> DataFrame:
    """Forms that are words of their own, with their analysis and what capitals they need."""
    has = lambda name: F.array_contains("flags", config.flag(name)) if config.flag(name) else F.lit(False)
    described = morphology.description(forms)
    return forms.filter(~has("ONLYINCOMPOUND")).select(
        "surface", "root", "kind", described.alias("analysis"), morphology.signature(described).alias("sig"),
        F.array_contains("flags", ONLY_UPCASE).alias("only_upcase"), has("KEEPCASE").alias("keep_case"),
    )


def variants(word: str) -> str:
    """SQL of the forms to try for a word: as typed, in lower case or capitalised by its capitals, and with the dot of an abbreviation."""
    clean = f"regexp_replace({word}, '[.]+$', '')"
    capital = "concat(upper(left(clean, 1)), lower(substr(clean, 2)))"
    named = lambda form: f"transform(bare, (b, i) -> named_struct('form', {form}, 'own', i = 0))"
    return f"""SELECT clean, kind, form, own FROM (
      SELECT clean, kind, concat({named("b")}, if(dotted, {named("concat(b, '.')")}, array())) AS tried FROM (
        SELECT clean, kind, dotted, CASE kind WHEN 0 THEN array(clean) WHEN {ALLCAP} THEN array(clean, lower(clean), {capital}) ELSE array(clean, lower(clean)) END AS bare FROM (
          SELECT clean, dotted, CASE WHEN lower(clean) = clean THEN 0 WHEN lower(substr(clean, 2)) = substr(clean, 2) THEN {INITCAP} WHEN upper(clean) = clean THEN {ALLCAP} ELSE 0 END AS kind
          FROM (SELECT {clean} AS clean, {clean} <> {word} AS dotted))))
      LATERAL VIEW inline(tried) t AS form, own WHERE clean <> ''"""


def found(prefix: str, word: str) -> str:
    """SQL of the forms that make a word right: none for a forbidden word."""
    return f"""SELECT f.* FROM (SELECT * FROM ({variants(word)}) v LEFT ANTI JOIN {prefix}_forbidden b ON v.clean = b.word) t JOIN {prefix}_forms f ON f.surface = t.form
      WHERE (NOT f.only_upcase OR t.kind = {ALLCAP}) AND (t.own OR NOT f.keep_case)"""


def one_deleted(word: str) -> str:
    """SQL array of a word and of what is left of it without one character."""
    cut = f"transform(sequence(1, length({word})), i -> concat(substr({word}, 1, i - 1), substr({word}, i + 1)))"
    return f"if(length({word}) > 0, array_distinct(concat(array({word}), {cut})), array({word}))"


def register(spark: SparkSession, forms: DataFrame, lexicon: DataFrame, config: AffixConfig, prefix: str = "lexicon") -> None:
    """Create the views and functions in the session; those of an earlier call with the prefix are replaced.

    Capitals follow SQL's ``lower`` and ``upper``.  Null and empty words find
    nothing.  Words pass no input conversion; numbers and compounds are for
    :func:`lexiforge.operators.spell.check`.
    """
    view = lambda name, df: df.createOrReplaceTempView(f"{prefix}_{name}")
    view("forms", forms_view(forms, config))
    view("entries", lexicon)
    view("forbidden", lexicon.filter(F.array_contains("flags", config.forbidden)).select("word").distinct())
    surfaces = suggest.accepted_surfaces(forms, lexicon, config)
    view("surfaces", surfaces)
    view("keys", surfaces.select("surface", F.explode(F.expr(one_deleted("surface"))).alias("key")))

    def function(name: str, takes: tuple[str, ...], returns: str, body: str) -> None:
        of = f"{prefix}_{name}"
        for arg in takes:
            body = body.replace(f":{arg}", f"{of}.{arg}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {of}({', '.join(f'{a} STRING' for a in takes)}) RETURNS TABLE ({returns}) RETURN {body}")

    right = found(prefix, ":w")
    function("lookup", ("w",), "surface STRING, root STRING, kind STRING", f"SELECT DISTINCT surface, root, kind FROM ({right})")
    function("analyze", ("w",), "analysis STRING", f"SELECT DISTINCT analysis FROM ({right})")
    stems = r"regexp_extract_all(analysis, '(?:^|\\s)st:(\\S+)', 1)"
    function("stem", ("w",), "stem STRING", f"SELECT DISTINCT stem FROM (SELECT {stems} AS stems FROM ({right})) LATERAL VIEW explode(stems) s AS stem")
    function(
        "generate", ("w", "like"), "generated STRING",
        f"""SELECT DISTINCT g.surface FROM (SELECT DISTINCT root FROM ({right})) r JOIN {prefix}_forms g ON g.root = r.root
            JOIN (SELECT DISTINCT sig FROM ({found(prefix, ':like')})) e ON g.sig = e.sig""",
    )
    function(
        "near", ("w",), "suggestion STRING, distance INT",
        f"""SELECT surface, distance FROM (SELECT DISTINCT k.surface, levenshtein(k.surface, :w) AS distance
            FROM (SELECT key FROM (SELECT {one_deleted(':w')} AS keys) LATERAL VIEW explode(keys) e AS key) d JOIN {prefix}_keys k ON k.key = d.key) WHERE distance <= 1""",
    )
    cuts = "if(length(:w) > 1, transform(sequence(1, length(:w) - 1), i -> named_struct('head', left(:w, i), 'tail', substr(:w, i + 1))), array())"
    function(
        "two_words", ("w",), "head STRING, tail STRING",
        f"""SELECT c.head, c.tail FROM (SELECT head, tail FROM (SELECT {cuts} AS cuts) LATERAL VIEW inline(cuts) t AS head, tail) c
            JOIN {prefix}_surfaces h ON h.surface = c.head JOIN {prefix}_surfaces t ON t.surface = c.tail""",
    )
