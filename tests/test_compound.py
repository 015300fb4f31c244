from itertools import product

import duckdb
from pyspark.sql import functions as F

from lexiforge.functions import phonetic
from lexiforge.operators import compound, expand, spell, suggest
from lexiforge.sources.affix import parse_affix
from lexiforge.sources.dictionary import parse_entries


def engine(spark, affix, *entries):
    config = parse_affix(affix)
    lines = spark.createDataFrame(list(enumerate(["0", *entries])), "entry_id bigint, value string")
    lex = parse_entries(lines, config).cache()
    return config, lex, expand.expand(lex, config.rules_df(spark), config).cache()


def verdicts(spark, made, *asked):
    config, lex, forms = made
    df = spark.createDataFrame([(w,) for w in asked], "word string")
    return {r["word"]: r["ok"] for r in spell.check(df, forms, lex, config).collect()}


def expect(spark, made, right="", wrong=""):
    got = verdicts(spark, made, *right.split(), *wrong.split())
    assert got == {**dict.fromkeys(right.split(), True), **dict.fromkeys(wrong.split(), False)}


def test_places_and_least_length(spark):
    made = engine(spark, ["COMPOUNDBEGIN B", "COMPOUNDMIDDLE M", "COMPOUNDEND E", "COMPOUNDMIN 2"], "foo/B", "bar/M", "baz/E", "qu/BE", "x/BE")
    expect(spark, made, "foobaz foobarbaz foobarbarbaz ququ Foobaz FOOBAZ", "bazfoo barbaz foobar foobazbaz xbaz foox foobarr")
    assert verdicts(spark, made, "")[""] is False
    config, _, forms = made
    assert compound.compounds(spark.createDataFrame([], "word string"), forms, config).count() == 0
    odd = spark.createDataFrame([(None,), ("a",), ("foobaz" * 40,)], "word string")
    assert compound.compounds(odd, forms, config).count() == 0


def test_against_all_rows_of_parts(spark):
    made = engine(spark, ["COMPOUNDFLAG A", "COMPOUNDMIN 1", "COMPOUNDWORDMAX 3", "CHECKCOMPOUNDDUP", "CHECKCOMPOUNDTRIPLE"], "a/A", "aa/A", "ab/A", "b/A", "bba/A")
    known = ["a", "aa", "ab", "b", "bba"]
    plain = lambda row: all(x != y for x, y in zip(row, row[1:]))

    def triple(row):
        text, at = "".join(row), 0
        for part in row[:-1]:
            at += len(part)
            if text[at - 1] == text[at] and ((at > 1 and text[at - 2] == text[at]) or text[at + 1 : at + 2] == text[at]):
                return True
        return False

    right = {"".join(row) for n in (2, 3) for row in product(known, repeat=n) if plain(row) and not triple(row)} | set(known)
    asked = ["".join(x) for n in range(1, 7) for x in product("ab", repeat=n)]
    got = verdicts(spark, made, *asked)
    assert {w for w, ok in got.items() if ok} == {w for w in right if len(w) <= 6}


def test_checks_at_joints(spark):
    base = ["COMPOUNDFLAG A"]
    expect(spark, engine(spark, [*base, "CHECKCOMPOUNDCASE"], "foo/A", "Bar/A", "BAZ/A", "-baz/A"), "foo-baz Barfoo", "fooBar BAZBar BAZfoo")
    expect(spark, engine(spark, [*base, "CHECKCOMPOUNDREP", "REP 1", "REP í i"], "szer/A", "víz/A", "szerviz", "kocsi/A"), "vízszer szerkocsi szervízkocsi", "szervíz kocsiszervíz")
    expect(spark, engine(spark, base, "tea/A", "pot/A", "tea cup", "cup/A"), "teapot potcup", "teacup potteacup")
    expect(spark, engine(spark, [*base, "SIMPLIFIEDTRIPLE", "CHECKCOMPOUNDTRIPLE"], "schiff/A", "fahrt/A"), "schiffahrt fahrtschiff", "schifffahrt schifahrt")
    expect(spark, engine(spark, [*base, "CHECKCOMPOUNDPATTERN 2", "CHECKCOMPOUNDPATTERN oo ba", "CHECKCOMPOUNDPATTERN 0/X 0/Y".replace("0/Y", "b/Y")], "foo/A", "bar/A", "kin/AX", "bun/AY", "box/A"), "barfoo foobox kinbox kinfoo", "foobar kinbun foobarbox")
    expect(spark, engine(spark, [*base, "CHECKCOMPOUNDPATTERN 1", "CHECKCOMPOUNDPATTERN o b z"], "foo/A", "bar/A"), "fozar barfoo", "foobar")
    expect(spark, engine(spark, [*base, "FORCEUCASE U"], "foo/A", "bar/AU"), "Foobar barfoo", "foobar")
    expect(spark, engine(spark, [*base, "COMPOUNDWORDMAX 2", "COMPOUNDSYLLABLE 4 aeiou", "COMPOUNDROOT R"], "foo/A", "bar/A", "barbar/AR"), "foobar barbarbar", "foobarfoobarfoo")


def test_affixes_in_compounds(spark):
    affix = ["COMPOUNDFLAG A", "COMPOUNDPERMITFLAG P", "COMPOUNDFORBIDFLAG F", "ONLYINCOMPOUND O", "SFX S Y 1", "SFX S 0 s/P .", "SFX T Y 1", "SFX T 0 er .", "SFX V Y 1", "SFX V 0 en/F .", "PFX U Y 1", "PFX U 0 un .", "SFX L Y 1", "SFX L 0 s/A ."]
    made = engine(spark, affix, "foo/ASTVU", "bar/ASTVU", "zig/AO", "kit/L")
    expect(spark, made, "foobar foobars foosbar foobarer unfoobar fooszig zigfoo fookits", "fooerbar foobaren fooenbar foounbar zig kitfoo kitsfoo")


def test_rules(spark):
    made = engine(spark, ["COMPOUNDMIN 1", "COMPOUNDRULE 2", "COMPOUNDRULE n*1t", "COMPOUNDRULE n*mp"], "0/nm", "1/n1", "2/nm", "0th/pt", "1st/p", "1th/tc", "2nd/p", "2th/tc")
    expect(spark, made, "10th 11th 12th 101st 21st 202nd 110th", "1thth 10st 21nd x1th 11nd")
    numbers = engine(spark, ["FLAG long", "COMPOUNDRULE 1", "COMPOUNDRULE (aa)(bb)?(cc)"], "foo/aa", "bar/bb", "baz/cc")
    expect(spark, numbers, "foobaz foobarbaz", "foobar barbaz foobarbarbaz")


def test_analyses_in_parts(spark):
    config, _, forms = engine(spark, ["COMPOUNDFLAG A", "SFX S Y 1", "SFX S 0 s . is:pl"], "foo/A po:n", "bar/AS", "foob/A", "ars/A")
    df = spark.createDataFrame([("foobars",), ("foo",), ("barfoobar",)], "word string")
    got = {(r["word"], r["analysis"]) for r in compound.analyze_compounds(df, forms, config).collect()}
    assert got == {("foobars", "pa:foo st:foo po:n pa:bars st:bar is:pl"), ("foobars", "pa:foob st:foob pa:ars st:ars"), ("barfoobar", "pa:bar st:bar pa:foo st:foo po:n pa:bar st:bar")}


def listed(df):
    return {k: [r["suggestion"] for r in df.orderBy("word", "rank").collect() if r["word"] == k] for k in {r["word"] for r in df.collect()}}


def test_compounds_are_suggested(spark):
    config, lex, forms = engine(spark, ["TRY abdefkoprtz", "COMPOUNDFLAG A", "MAXCPDSUGS 2"], "foot/A", "ball/A", "keeper/A")
    got = listed(suggest.suggest(spark.createDataFrame([("footbal",), ("Fotball",), ("footbak",)], "word string"), forms, lex, config))
    assert got["Fotball"] == ["Football"] and all(len(v) <= 2 for v in got.values())


TABLE = [("AH(AEIOUY)-^", "*H"), ("A^", "*"), ("C", "K"), ("GH<", "F"), ("KN^^", "N"), ("K", "K"), ("N", "N"), ("F", "F"), ("PH", "F"), ("TCH", "X"), ("CH", "X"), ("T", "T"), ("S$", "Z"), ("S", "S"), ("R", "R"), ("L", "L"), ("E", "")]


def test_phonetic_codes(spark):
    want = {"CAT": "KT", "PHNT": "FNT", "TGHT": "TFT", "KNT": "NT", "AHA": "*H", "ATS": "*TZ", "STS": "STZ", "": "", "123": "", "TCHT": "XT", "C" * 300: ""}
    df = spark.createDataFrame([*((w,) for w in want), (None,)], "w string")
    got = {r["w"]: r["c"] for r in df.select("w", phonetic.coder(TABLE)(F.col("w")).alias("c")).collect()}
    assert got == {**want, None: None}


def test_following_rules_win_by_priority():
    table = (("AB", "1"), ("A", "2"), ("BC", "3"), ("B", "4"), ("C", "5"))
    assert phonetic.encode("ABC", table) == "23"  # BC reaches further than AB
    assert phonetic.encode("ABD", table) == "1"
    assert phonetic.encode("ABC", (("AB6", "1"), *table[1:])) == "15"


def test_sounding_words_are_suggested(spark):
    affix = [f"PHONE {len(TABLE)}", *(f"PHONE {a} {b or '_'}" for a, b in TABLE)]
    config, lex, forms = engine(spark, affix, "telephant", "cattle", "partner", "fantastic")
    assert ("E", "") in config.phonetic
    got = listed(suggest.suggest(spark.createDataFrame([("kattlephxx",), ("qqqqq",)], "word string"), forms, lex, config))
    assert "qqqqq" not in got and all(len(v) == len(set(v)) for v in got.values())
    one = spark.createDataFrame([("phantastik",)], "w string")
    none = spark.createDataFrame([], "w string, candidate string")
    surfaces = forms.select("surface")
    assert [r["candidate"] for r in suggest.sounding_roots(one, lex, surfaces, config, none).orderBy("i").collect()][0] == "fantastic"
    said = spark.createDataFrame([("phantastik", "fanta")], "w string, candidate string")
    assert "fantastic" not in [r["candidate"] for r in suggest.sounding_roots(one, lex, surfaces, config, said).collect()]


def test_two_parts_take_no_stretches_within(spark, tmp_path):
    from lexiforge.operators import compound
    from lexiforge.plans import catalogue

    docs = [(i, "x", "rain bow coat rainbow coats" + (" rainbowcoats rainbowcoat raincoat coatbow rainbow" if i == 0 else "")) for i in range(5)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = catalogue.unknown_types(spark, str(tmp_path)).selectExpr("word", "false AS capital")
    forms = catalogue.compound_forms(spark, str(tmp_path))
    edges = {r["word"]: {(e["s"], e["e"]) for e in r["edges"]} for r in compound.with_parts(words, forms, catalogue.PAIR_CONFIG).collect()}
    assert edges == {"rainbowcoats": {(0, 7), (7, 12)}, "rainbowcoat": {(0, 7), (7, 11)}, "raincoat": {(0, 4), (4, 8)}}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.compound_analyses(spark, str(tmp_path)).select("word", "analysis")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT word, analysis FROM ({catalogue.ORACLES['compound_analyses']})").fetchall())
