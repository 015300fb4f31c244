import pytest
from pyspark.sql import functions as F

from lexiforge import sql
from lexiforge.operators import expand, morphology, spell
from lexiforge.sources.affix import parse_affix
from lexiforge.sources.dictionary import parse_entries

AFFIX = """
SET UTF-8
FORBIDDENWORD !
KEEPCASE k
ONLYINCOMPOUND o
PFX U Y 1
PFX U 0 un . ds:un
SFX D Y 2
SFX D 0 d e is:past
SFX D 0 ed [^ey] is:past
SFX S Y 1
SFX S 0 s . is:plural
"""
WORDS = "11 create/DU walk/DS talk/DS London etc. NATO bad/! house iPod keep/k part/o éte/S".split()
TYPED = ["walks", "Walks", "WALKED", "wAlks", "London", "london", "LONDON", "etc", "etc.", "Etc.", "NATO", "nato", "bad", "Bad", "BAD", "keep", "Keep", "KEEP", "part", "éte", "ÉTE", "uncreated", "x", "...", "A", "walks..", ""]


@pytest.fixture(scope="module")
def engine(spark):
    config = parse_affix(AFFIX.splitlines())
    lexicon = parse_entries(spark.createDataFrame(list(enumerate(WORDS)), "entry_id bigint, value string"), config)
    forms = expand.expand(lexicon, config.rules_df(spark), config)
    sql.register(spark, forms, lexicon, config, "t")
    spark.createDataFrame([(w,) for w in [*TYPED, None, "walks"]], "word string").createOrReplaceTempView("asked")
    return forms, lexicon, config


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lookup_agrees_with_verdicts(spark, engine):
    forms, lexicon, config = engine
    words = spark.table("asked").filter("word <> ''").distinct()
    want = {r["word"] for r in spell.check(words, forms, lexicon, config).filter("ok").collect()}
    got = {r[0] for r in spark.sql("SELECT a.word FROM asked a, LATERAL t_lookup(a.word) l").collect()}
    assert got == want and {"Walks", "etc.", "LONDON"} <= got and not {"bad", "Keep", "part", "london", ""} & got


def test_lateral_keeps_rows_asked_twice(spark, engine):
    found = spark.sql("SELECT a.word, l.root FROM asked a LEFT JOIN LATERAL t_lookup(a.word) l WHERE a.word <=> 'walks' OR a.word IS NULL")
    assert sorted(map(tuple, found.collect()), key=str) == [("walks", "walk"), ("walks", "walk"), (None, None)]


def test_analyses_and_stems(spark, engine):
    forms, _, _ = engine
    words = spark.createDataFrame([("walks",), ("Walked",), ("uncreated",), ("nothing",)], "word string")
    words.createOrReplaceTempView("some")
    analyses = morphology.analyze(words, forms)
    assert rows(spark.sql("SELECT s.word, a.analysis FROM some s, LATERAL t_analyze(s.word) a")) == rows(analyses)
    assert rows(spark.sql("SELECT s.word, a.stem FROM some s, LATERAL t_stem(s.word) a")) == rows(morphology.stem(analyses))


def test_generate(spark, engine):
    forms, _, _ = engine
    pairs = spark.createDataFrame([("walk", "talked"), ("talks", "create"), ("create", "walked"), ("house", "walks"), ("x", "walks")], "word string, example string")
    pairs.createOrReplaceTempView("pairs")
    got = spark.sql("SELECT p.word, p.example, g.generated FROM pairs p, LATERAL t_generate(p.word, p.example) g")
    assert rows(got) == rows(morphology.generate(pairs, forms)) == [("create", "walked", "created"), ("talks", "create", "talk"), ("walk", "talked", "walked")]


def test_near_and_two_words(spark, engine):
    forms, lexicon, _ = engine
    surfaces = [r[0] for r in spark.table("t_surfaces").collect()]
    words = ["wlk", "walk", "tlaks", "hous", "w", "xhouse"]
    spark.createDataFrame([(w,) for w in words], "w string").createOrReplaceTempView("misspelt")

    def one_edit(a, b):
        cut = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
        return a == b or b in cut(a) or a in cut(b) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)

    got = rows(spark.sql("SELECT m.w, n.suggestion, n.distance FROM misspelt m, LATERAL t_near(m.w) n"))
    assert got == sorted((w, s, int(w != s)) for w in words for s in surfaces if one_edit(w, s))
    spark.createDataFrame([("walkhouse",), ("walk",), ("a",), ("",), ("talkswalks",)], "w string").createOrReplaceTempView("joined")
    assert rows(spark.sql("SELECT j.w, c.head, c.tail FROM joined j, LATERAL t_two_words(j.w) c")) == [("talkswalks", "talks", "walks"), ("walkhouse", "walk", "house")]


def test_a_lateral_call_is_a_join_without_python(spark, engine):
    plan = spark.sql("SELECT a.word, l.root FROM asked a, LATERAL t_lookup(a.word) l")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert spark.table("t_forms").filter(F.col("surface") == "part").count() == 0
