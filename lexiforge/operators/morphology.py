"""Analysis, stems and generation from surface forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import ALLCAP, HUHINITCAP, INITCAP, captype, clean_word, field, init_upper, upper_cp
from lexiforge.operators import compound
from lexiforge.operators.spell import case_variants, check
from lexiforge.sources.affix import AffixConfig

#: Tags that make up an inflection's signature (fixed values of the format).
SIGNATURE_TAGS = ("ds:", "is:", "ts:")


def description(forms: DataFrame) -> Column:
    """A form's analysis: prefix fields, stem, entry fields, suffix fields; the stem is the entry's own if it names one."""
    own = F.when(F.regexp_like("morph", F.lit(r"(^|\s)st:")), F.lit("")).otherwise(F.concat(F.lit("st:"), F.col("root")))
    parts = F.array(F.col("pfx_morph"), own, F.col("morph"), F.col("sfx_morph"))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def analyze(words: DataFrame, forms: DataFrame, config: AffixConfig | None = None) -> DataFrame:
    """``(word, analysis)``: all distinct analyses of distinct words, over their case variants.

    With an affix file that has compounds, words without a form are analysed as such.
    """
    cleaned = words.select("word").filter("word IS NOT NULL").distinct().withColumn("c", clean_word(F.col("word")))
    tried = cleaned.select("word", F.inline(case_variants(F.col("c.word"), dots=F.col("c.dots"))))
    whole = tried.join(forms, F.col("form") == F.col("surface")).select("word", description(forms).alias("analysis")).distinct()
    if config is None or not compound.enabled(config):
        return whole
    left = tried.join(whole.select("word").distinct(), "word", "left_anti").select("word", "form")
    found = compound.analyze_compounds(left.select(F.col("form").alias("word")), forms, config).withColumnRenamed("word", "form")
    return whole.unionByName(left.join(found, "form").select("word", "analysis").distinct())


def stem(analyses: DataFrame) -> DataFrame:
    """``(word, stem)``: the stems that analyses name; parts of a compound stay in front of its last stem."""
    parts = field(F.col("analysis"), "pa")
    head = F.array_join(F.concat(F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.slice(parts, 1, 1)), field(F.col("analysis"), "sp")), "")
    last = F.when(F.size(parts) > 1, F.element_at(F.split("analysis", r"(?:^|\s)pa:"), -1)).otherwise(F.col("analysis"))
    stems = F.transform(field(last, "st"), lambda s: F.concat(head, s))
    return analyses.select("word", F.explode(stems).alias("stem")).distinct()


def signature(analysis: Column) -> Column:
    """The inflection and derivation fields of an analysis, in order."""
    return F.filter(F.split(analysis, " "), lambda x: F.substring(x, 1, 3).isin(*SIGNATURE_TAGS))


def derivation(forms: DataFrame) -> Column:
    """The derivational suffixes of a form, or of its entry, before the first inflection."""
    fields = F.filter(F.split(F.concat_ws(" ", "morph", "sfx_morph"), " "), lambda x: x != "")
    inflected = F.array_position(F.transform(fields, lambda x: F.startswith(x, F.lit("is:"))), True).cast("int")
    kept = F.when(inflected > 0, F.slice(fields, F.lit(1), inflected - 1)).otherwise(fields)
    return F.filter(kept, lambda x: F.startswith(x, F.lit("ds:")))


def targets(forms: DataFrame) -> DataFrame:
    """``(stem, sig, generated)``: forms by the word they belong to and how they are inflected.

    An allomorph belongs to the word that it names as its stem and that names it in turn.
    """
    own = F.element_at(F.when(F.size(field(F.col("morph"), "st")) > 0, field(F.col("morph"), "st")), 1)
    rows = forms.select("root", "morph", own.alias("named"), signature(description(forms)).alias("sig"), F.col("surface").alias("generated"))
    plain = rows.select(F.col("root").alias("stem"), "sig", "generated")
    listed = rows.select(F.col("root").alias("stem"), F.explode(field(F.col("morph"), "al")).alias("allomorph")).distinct()
    other = rows.filter(F.col("named") != F.col("root")).join(listed, (F.col("named") == F.col("stem")) & (F.col("root") == F.col("allomorph")))
    return plain.unionByName(other.select("stem", "sig", "generated")).distinct()


def inflected(words: DataFrame, forms: DataFrame) -> DataFrame:
    """``(word, e_sig, generated)``: the forms of each distinct word's root, by the signature of the examples that ask for them.

    A derived word keeps its derivational suffixes, with the example's after
    them; where the root has no such form, it is inflected as the example alone.
    """
    own = forms.select(F.col("surface").alias("word"), F.col("root").alias("stem"), derivation(forms).alias("derived")).join(words.select("word").distinct(), "word", "left_semi").distinct()
    n = F.size("derived")
    kept = (n > 0) & (F.slice("sig", F.lit(1), n) == F.col("derived"))
    ways = F.array(F.when(kept, F.struct(F.lit(0).alias("way"), F.slice("sig", n + 1, F.size("sig")).alias("e_sig"))), F.struct(F.lit(1).alias("way"), F.col("sig").alias("e_sig")))
    tried = own.join(targets(forms), "stem").select("word", "stem", "derived", "generated", F.inline(F.filter(ways, lambda x: x.isNotNull())))
    first = F.min("way").over(Window.partitionBy("word", "stem", "derived", "e_sig"))
    return tried.withColumn("first", first).filter("way = first").select("word", "e_sig", "generated").distinct()


def offers(made: DataFrame) -> DataFrame:
    """``(word, made)``: what :func:`inflected` found, in one row a word; as many as its roots have forms."""
    return made.groupBy("word").agg(F.collect_set(F.struct("e_sig", "generated")).alias("made"))


def models(examples: DataFrame, forms: DataFrame) -> DataFrame:
    """``(example, sigs)``: how each of ``(example, model)`` is inflected, as any of its models is a form."""
    told = forms.select(F.col("surface").alias("model"), signature(description(forms)).alias("e_sig")).distinct()
    return told.join(examples.select("example", "model").distinct(), "model").groupBy("example").agg(F.collect_set("e_sig").alias("sigs"))


def generated_as(both: DataFrame) -> DataFrame:
    """``(word, example, generated)`` of distinct ``(word, made, example, sigs)``; nothing is shuffled."""
    fitting = F.filter("made", lambda m: F.array_contains("sigs", m["e_sig"]))
    return both.select("word", "example", F.explode(F.array_distinct(F.transform(fitting, lambda m: m["generated"]))).alias("generated"))


def generate(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """``(word, example, generated)``: forms of the word's root that are inflected as the example is; pairs meet what each side alone has found."""
    pairs = pairs.select("word", "example").distinct()
    wanted = models(pairs.select("example", F.col("example").alias("model")), forms)
    return generated_as(pairs.join(offers(inflected(pairs, forms)), "word").join(wanted, "example"))


def variants(words: DataFrame) -> DataFrame:
    """``(word, case, own)``: distinct words as typed, with the case variants in which they are looked up."""
    asked = words.select("word").filter("word IS NOT NULL").distinct().withColumn("c", clean_word(F.col("word")))
    return asked.select("word", captype(F.col("c.word")).alias("case"), F.inline(case_variants(F.col("c.word"), dots=F.col("c.dots")))).select("word", "case", F.col("form").alias("own"))


def offers_cased(words: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """:func:`offers` for words as typed: they are looked up in their case variants, results take the word's capitals, and wrong ones go."""
    tried = variants(words)
    found = inflected(tried.select(F.col("own").alias("word")), forms).withColumnRenamed("word", "own")
    text = F.col("generated")
    text = F.when(F.col("case") == ALLCAP, upper_cp(text)).when(F.col("case").isin(INITCAP, HUHINITCAP), init_upper(text)).otherwise(text)
    made = tried.join(found, "own").select("word", "e_sig", text.alias("generated")).distinct()
    return offers(check(made, forms, lexicon, config, "generated").filter("ok"))


def models_cased(examples: DataFrame, forms: DataFrame) -> DataFrame:
    return models(variants(examples.select(F.col("example").alias("word"))).select(F.col("word").alias("example"), F.col("own").alias("model")), forms)


def generate_cased(pairs: DataFrame, forms: DataFrame, lexicon: DataFrame, config: AffixConfig) -> DataFrame:
    """:func:`generate` for words as typed: both are looked up in their case variants, results take the word's capitals, and wrong ones go."""
    pairs = pairs.select("word", "example").distinct()
    return generated_as(pairs.join(offers_cased(pairs, forms, lexicon, config), "word").join(models_cased(pairs, forms), "example"))


def stem_derived(words: DataFrame, forms: DataFrame) -> DataFrame:
    """``(word, stem)``: stems of distinct words; where an analysis has derivational suffixes, the form that has these alone, after the surface of a prefix if it is named."""
    cleaned = words.select("word").filter("word IS NOT NULL").distinct().withColumn("c", clean_word(F.col("word")))
    tried = cleaned.select("word", F.inline(case_variants(F.col("c.word"), dots=F.col("c.dots"))))
    whole = tried.join(forms, F.col("form") == F.col("surface")).select("word", "root", description(forms).alias("analysis"), derivation(forms).alias("derived"))
    bare = stem(whole.filter(F.size("derived") == 0).select("word", "analysis"))
    grown = whole.filter(F.size("derived") > 0).select("word", F.col("root").alias("stem"), F.col("derived").alias("sig"), F.array_join(field(F.col("analysis"), "sp"), "").alias("head"))
    made = grown.distinct().join(targets(forms), ["stem", "sig"]).select("word", F.concat("head", "generated").alias("stem"))
    return bare.unionByName(made).distinct()


def generate_from(words: DataFrame, forms: DataFrame, wanted: list[str]) -> DataFrame:
    """``(word, generated)``: forms of each word's root whose signature is that of one of the given descriptions."""
    described = forms.select("surface", "root", signature(description(forms)).alias("sig"))
    signatures = [[x for x in w.split(" ") if x[:3] in SIGNATURE_TAGS] for w in wanted]
    same = F.lit(False)
    for s in signatures:
        same = same | (F.col("sig") == F.array(*[F.lit(x) for x in s]).cast("array<string>"))
    roots = words.select("word").distinct().join(described.select(F.col("surface").alias("word"), "root").distinct(), "word")
    return roots.join(described.filter(same).select("root", F.col("surface").alias("generated")), "root").select("word", "generated").distinct()


def generate_described(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """``(word, code, generated)``: for each ``(word, code)``, forms of the word's root with the description's signature."""
    described = forms.select("surface", "root", signature(description(forms)).alias("sig")).distinct()
    roots = described.select(F.col("surface").alias("word"), "root").distinct()
    wanted = asked.select("word", "code", signature(F.col("code")).alias("sig")).distinct().join(roots, "word")
    return wanted.join(described.withColumnRenamed("surface", "generated"), ["root", "sig"]).select("word", "code", "generated").distinct()
