import pytest
from pyspark.sql import functions as F

from lexiforge.operators import command, compound, expand, morphology, overlay, spell
from lexiforge.sources import lines
from lexiforge.sources.affix import load_affix, parse_affix
from lexiforge.sources.dictionary import parse_entries, read_dictionary


def shortened(texts):
    """Each line as what differs from the one before."""
    out, last = bytearray(), b""
    for line in texts:
        left = 0
        while left < min(len(line), len(last), 29) and line[left] == last[left]:
            left += 1
        right = 0
        while right < min(len(line) - left, len(last) - left, 15) and line[len(line) - right - 1] == last[len(last) - right - 1]:
            right += 1
        for b in line[left : len(line) - right]:
            out += bytes([b]) if b >= 47 or b in (9, 32) else bytes([31, b])
        code = 30 if left == 9 else left
        out += bytes([right + 31, code]) if right else bytes([code])
        last = line
    return bytes(out)


def compressed(data, key=None):
    pairs = sorted({data[i : i + 2] for i in range(0, len(data) - 1, 2)})
    odd = data[-1:] if len(data) % 2 else b""
    size = max(len(pairs).bit_length(), 1)
    table = [(p, f"{n:0{size}b}") for n, p in enumerate(pairs)]
    end = f"{len(pairs):0{size}b}"
    table.append((b"\x01" + odd if odd else b"\x00\x00", end))
    packed = lambda bits: bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    head = len(table).to_bytes(2, "big")
    for pair, bits in table:
        head += pair + bytes([len(bits)]) + packed(bits).ljust(len(bits) // 8 + 1, b"\0")
    code = dict(table)
    body = packed("".join(code[data[i : i + 2]] for i in range(0, len(data) - 1, 2)) + end) + b"\0"
    if key is None:
        return b"hz0" + head + body
    check = 0
    for b in key:
        check ^= b
    return b"hz1" + bytes([check]) + bytes(b ^ key[i % len(key)] for i, b in enumerate(head)) + body


ENTRIES = ["7", "walk/S", "walked", "talked", "internationalisation", "internationalization", "it's", "über-all.", "tab\tpo:x"]


@pytest.mark.parametrize("key", [None, "s3cret"])
def test_compressed_dictionary_round_trip(spark, tmp_path, key):
    data = compressed(shortened([e.encode() for e in ENTRIES]), key and key.encode())
    assert lines.file_lines(data, "UTF-8", key) == ENTRIES
    (tmp_path / "x.dic.hz").write_bytes(data)
    rows = lines.read_lines(spark, str(tmp_path / "x.dic"), key=key).orderBy("entry_id").collect()
    assert [r["value"] for r in rows] == ENTRIES
    got = read_dictionary(spark, str(tmp_path / "x.dic"), parse_affix([]), key=key).filter("NOT hidden").orderBy("entry_id")
    assert [r["word"] for r in got.collect()] == ["walk", "walked", "talked", "internationalisation", "internationalization", "it's", "über-all.", "tab"]


def test_broken_files_are_refused():
    data = compressed(shortened([b"abc", b"abd"]), b"k")
    for bad, key in ((data, None), (data, "wrong"), (b"zip", None), (b"hz0\0\5", None), (compressed(shortened([b"abc"]))[:-3], None)):
        with pytest.raises(ValueError):
            lines.unpack(bad, key.encode() if key else None)


def test_character_sets(spark, tmp_path):
    for charset, python in (("ISO8859-2", "iso8859-2"), ("KOI8-R", "koi8-r"), ("microsoft-cp1251", "cp1251"), ("TIS620-2533", "tis-620"), ("UTF-8", "utf-8")):
        assert lines.codec(charset) == lines.codec(python)
    with pytest.raises(ValueError):
        lines.codec("ISCII-DEVANAGARI")
    (tmp_path / "x.aff").write_bytes("SET ISO8859-2\nTRY őáű\nSFX S Y 1\nSFX S 0 ő .\n".encode("iso8859-2"))
    (tmp_path / "x.dic").write_bytes("2\r\nkő\r\ntű/S\r\n".encode("iso8859-2"))
    config = load_affix(spark, str(tmp_path / "x.aff"))
    lex = read_dictionary(spark, str(tmp_path / "x.dic"), config)
    assert config.try_chars == "őáű" and [r["surface"] for r in expand.expand(lex, config.rules_df(spark), config).orderBy("surface").collect()] == ["kő", "tű", "tűő"]


def lexical(spark, affix, *entries):
    config = parse_affix(affix)
    rows = spark.createDataFrame(list(enumerate(["0", *entries])), "entry_id bigint, value string")
    lex = parse_entries(rows, config).cache()
    return config, lex, expand.expand(lex, config.rules_df(spark), config).cache()


def test_complex_prefixes(spark):
    affix = ["COMPLEXPREFIXES", "PFX A Y 1", "PFX A 0 un/B [dw] ds:un", "PFX B Y 1", "PFX B 0 re . ds:re", "SFX S Y 1", "SFX S y ies [^aeiou]y is:pl"]
    config, lex, forms = lexical(spark, affix, "do/A", "dry/AS", "go/A")
    got = {r["surface"]: (r["root"], r["kind"], r["pfx_append"], r["sfx_append"]) for r in forms.collect()}
    assert got == {
        "do": ("do", "root", "", ""), "dry": ("dry", "root", "", ""), "go": ("go", "root", "", ""), "undo": ("do", "prefix", "un", ""), "undry": ("dry", "prefix", "un", ""),
        "dries": ("dry", "suffix", "", "ies"), "reundo": ("do", "two_prefixes", "reun", ""), "reundry": ("dry", "two_prefixes", "reun", ""),
        "undries": ("dry", "prefix_suffix", "un", "ies"), "reundries": ("dry", "two_prefixes_suffix", "reun", "ies"),
    }


def test_requests(spark):
    config, lex, forms = lexical(spark, ["SFX S Y 1", "SFX S 0 s . is:plural", "SFX D Y 1", "SFX D 0 ed . is:past"], "walk/SD", "a&b", "work/SD")
    query = lambda kind, rest: f"<?xml?><query type='{kind}'>{rest}</query>"
    asked = {
        query("analyze", "<word>walks</word>"): ["<code><a>st:walk is:plural</a></code>"],
        query("analyze", "<word>a&amp;b</word>"): ["<code><a>st:a&amp;b</a></code>"],
        query("analyze", "<word>nothing</word>"): [],
        query("stem", "<word>walked</word>"): ["walk"],
        query("generate", "<word>walk</word><word>works</word>"): ["walks"],
        query("generate", "<word>walk</word><code><a>is:past</a><a>st:work is:plural</a></code>"): ["walked", "walks"],
        query("add", "<word>zebra</word>"): [],
        query("add", "<word>jump</word><word>walk</word>"): [],
        query("other", "<word>walk</word>"): [],
        query("stem", "<word></word>"): [],
        "<?xml": [],
        "": [],
    }
    df = spark.createDataFrame([*((w,) for w in asked), (None,)], "word string").withColumn("type", F.lit(1))
    assert {r["request"]: r["answers"] for r in command.answer(df, forms).collect()} == asked
    added = command.additions(df)
    assert {tuple(r) for r in added.collect()} == {("zebra", None), ("jump", "walk")}
    grown = overlay.add_with_affix(lex, added.filter("example IS NOT NULL"), config)
    again = expand.expand(grown, config.rules_df(spark), config)
    assert [r["ok"] for r in spell.check(spark.createDataFrame([("jumped",)], "word string"), again, grown, config).collect()] == [True]


def test_compounds_are_analysed_and_stemmed(spark):
    config, _, forms = lexical(spark, ["COMPOUNDFLAG A", "SFX S Y 1", "SFX S 0 s . is:pl"], "foo/A", "bar/AS")
    assert compound.enabled(config)
    found = morphology.analyze(spark.createDataFrame([("Foobars",), ("foo",)], "word string"), forms, config)
    assert {tuple(r) for r in morphology.stem(found).collect()} == {("Foobars", "foobar"), ("foo", "foo")}
