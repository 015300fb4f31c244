"""Forms by stripping against forms by expanding; generation and stems of derived words."""

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import affix_index, expand, morphology, spell
from tests.test_engine import AFFIX, WORDS, lexical, words

CASES = {
    "engine": (AFFIX.strip().splitlines(), WORDS[1:]),
    "circumfix": (["CIRCUMFIX X", "NEEDAFFIX n", "PFX A Y 1", "PFX A 0 leg/X .", "SFX B Y 2", "SFX B 0 obb .", "SFX B 0 obb/AX .", "SFX C N 1", "SFX C y ies/n y"], ["nagy/B", "ly/C", "may/BCA", "kis/nB"]),
    "turned": (["COMPLEXPREFIXES", "PFX P Y 1", "PFX P 0 re/Q [^e]", "PFX Q Y 1", "PFX Q 0 un .", "SFX S Y 1", "SFX S e ing e"], ["make/PS", "eat/P", "bake/S"]),
    "stripped": (["FULLSTRIP", "SFX A Y 2", "SFX A eau eaux eau", "SFX A . x/B .", "SFX B Y 1", "SFX B x xs x", "PFX D Y 1", "PFX D e o e"], ["eau/AD", "tableau/A", "été/AD"]),
}


@pytest.mark.parametrize("case", CASES)
def test_stripping_gives_the_expanded_rows(spark, case):
    affix, entries = CASES[case]
    config, lex, forms = lexical(spark, affix, *entries)
    junk = words(spark, "zzz", "", "s", "un", "uncryed", "eauxx").withColumnRenamed("word", "surface").union(spark.createDataFrame([(None,)], "surface string"))
    asked = forms.select("surface").union(junk)
    got = affix_index.forms_of(asked, lex, config)
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*expand.FORM_COLUMNS).collect())
    assert rows(got) == rows(forms) and forms.count() > 4
    some = forms.filter(F.length("surface") % 2 == 0)
    assert rows(affix_index.forms_of(some.select("surface"), lex, config)) == rows(some)
    check = spell.check(words(spark, "zzz", *[r["surface"] for r in some.limit(5).collect()]), got, lex, config)
    assert check.filter("NOT ok").count() == 1


def test_derived_words(spark):
    config, lex, forms = lexical(spark, AFFIX.strip().splitlines(), *WORDS[1:], "sing al:sang", "sang st:sing is:past", "bang st:sing is:past")
    pairs = [("Drinkable", "walks"), ("drinkable", "WALKS"), ("WALK", "cried"), ("walk", "Drinkables"), ("drink", "drinkables"), ("undrinkable", "walks"), ("sing", "cried"), ("Nothing", "walks"), (None, "walks")]
    got = morphology.generate_cased(spark.createDataFrame(pairs, "word string, example string"), forms, lex, config)
    assert {tuple(r) for r in got.collect()} == {
        ("Drinkable", "walks", "Drinkables"), ("drinkable", "WALKS", "drinkables"), ("WALK", "cried", "WALKED"), ("drink", "drinkables", "drinkables"), ("undrinkable", "walks", "drinkables"), ("sing", "cried", "sang"),
    }
    stems = morphology.stem_derived(words(spark, "Undrinkables", "drinkable", "cried", "WALKS", "zzz"), forms)
    assert {tuple(r) for r in stems.collect()} == {("Undrinkables", "drinkable"), ("drinkable", "drinkable"), ("cried", "cry"), ("WALKS", "walk")}
