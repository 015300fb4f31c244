import unicodedata

from pyspark.sql import functions as F

from lexiforge.functions import similarity, text


def values(spark, words, make):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r["v"] for r in df.select("i", make(F.col("w")).alias("v")).orderBy("i").collect()]


def test_captype(spark):
    assert values(spark, ["abc", "Abc", "ABC", "aBc", "ABc", "A-1", "123", "a"], text.captype) == [0, 1, 2, 3, 4, 1, 0, 0]


def test_case_is_by_character(spark):
    assert values(spark, ["ΟΔΟΣ", "Straße", ""], text.lower_cp) == ["οδοσ", "straße", ""]
    assert values(spark, ["straße", "ab"], text.upper_cp) == ["STRAßE", "AB"]
    assert values(spark, ["oPEN", "x"], text.init_upper) == ["OPEN", "X"]


def test_clean_word(spark):
    found = values(spark, ["  etc...", "a.b", "..."], lambda w: text.clean_word(w))
    assert [(r["word"], r["dots"]) for r in found] == [("etc", 3), ("a.b", 0), ("", 3)]
    assert values(spark, ["a-b"], lambda w: text.clean_word(w, "-")["word"]) == ["ab"]


def test_numbers(spark):
    assert values(spark, ["1", "1.5", "1,000", "1..5", ".5", "5.", "x1"], text.is_number) == [True, True, True, False, False, False, False]


def test_fold_and_syllables(spark):
    words = ["καλημέρα", "ΐ", "ϋ", "é̈", "σ̆"]
    plain = ["".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in words]
    assert values(spark, words, text.fold) == plain
    assert values(spark, plain, text.fold) == plain
    assert values(spark, ["καλημερα", "και", "ά", ""], text.syllables) == [4, 1, 0, 0]


def test_greekify(spark):
    assert values(spark, ["shithkio", "psomi", "ths", "jami", "b3"], text.greekify) == ["σ̆ιθκιο", "ψομι", "θσ", "τζ̆αμι", "μπξ"]


def test_sigma_and_accents(spark):
    assert values(spark, ["οδος", "οςδ", "οδοσ", "σ"], text.final_sigma) == ["οδος", "οσδ", "οδος", "ς"]
    assert values(spark, ["α΄", "σ˘", "κ΄", "ι΅"], text.compose_accents) == ["ά", "σ̆", "κ", "ΐ"]


def test_override_sound_sentence(spark):
    assert values(spark, ["gia", "nope"], text.override) == ["για", None]
    assert values(spark, ["Είμαι", "Ηοίη"], text.sound_key) == ["ιμαι", "ιιι"]
    assert values(spark, ["One. Two"], lambda w: text.first_in_sentence(w, F.lit("Two"))) == [True]
    assert values(spark, ["", "One two"], lambda w: text.first_in_sentence(w, F.lit("two"))) == [False, False]


def test_flags(spark):
    assert values(spark, ["ba", ""], text.decode_flags) == [[97, 98], []]
    assert values(spark, ["12,7,12", "x"], lambda w: text.decode_flags(w, "num")) == [[7, 12], []]
    assert values(spark, ["aabb"], lambda w: text.decode_flags(w, "long")) == [[97 * 257, 98 * 257]]
    assert values(spark, ["po:noun is:a is:b"], lambda w: text.field(w, "is")) == [["a", "b"]]


def brute_ngram(n, a, b, modes):
    total = 0
    for j in range(1, n + 1):
        level = 0
        for i in range(len(a) - j + 1):
            if a[i : i + j] in b:
                level += 1
            elif "weighted" in modes:
                level -= 1 + (i in (0, len(a) - j))
        total += level
        if level < 2 and "weighted" not in modes:
            break
    over = len(b) - len(a) - 2 if "longer_worse" in modes else abs(len(b) - len(a)) - 2 if "any_mismatch" in modes else 0
    return total - max(over, 0) if b else 0


def test_similarity(spark):
    pairs = [("hello", "hallo"), ("a", ""), ("abc", "Abcdefgh"), ("sound", "suodn"), ("vacation", "vacacation"), ("x", "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    a, b = F.col("a"), F.col("b")
    for modes in ((), ("longer_worse",), ("any_mismatch",), ("any_mismatch", "weighted")):
        assert [r[0] for r in df.select(similarity.ngram(3, a, b, *modes)).collect()] == [brute_ngram(3, x, y, modes) for x, y in pairs]
        assert [r[0] for r in df.select(similarity.ngram_batched(3, *modes)(a, b)).collect()] == [brute_ngram(3, x, y, modes) for x, y in pairs]
    assert [r[0] for r in df.select(similarity.lcs_length("a", "b")).collect()] == [4, 0, 2, 3, 8, 1]
    assert [r[0] for r in df.select(similarity.common_prefix(a, b)).collect()][:2] == [1, 0]
    assert [r[0] for r in df.select(similarity.is_swap(a, b)).collect()] == [False] * 6
    assert spark.range(1).select(similarity.is_swap(F.lit("abcd"), F.lit("dbca"))).head()[0]
