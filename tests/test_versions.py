"""Versions of a lexicon against a rebuild; forms stored in buckets."""

from pyspark.sql import functions as F

from lexiforge import store
from lexiforge.operators import expand, overlay, spell
from lexiforge.operators.versions import VersionedLexicon
from lexiforge.plans import catalogue
from tests.test_engine import AFFIX, WORDS, lexical, words


def rows(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def test_forms_after_changes_are_those_of_a_rebuild(spark, tmp_path):
    config, lex, _ = lexical(spark, AFFIX.strip().splitlines(), *WORDS[1:])
    kept = VersionedLexicon.create(lex, str(tmp_path / "lexicon"), config)
    whole = lex
    pairs = spark.createDataFrame([("jump", "walk"), ("hop", "nothing")], "word string, example string")
    steps = [
        (kept.add, overlay.add, words(spark, "zebra", "bad", "Openoffice", "McNab", "OpenOffice")), (kept.add_with_affix, overlay.add_with_affix, pairs), (kept.remove, overlay.remove, words(spark, "have", "zebra", "absent")),
        (kept.add, overlay.add, words(spark, "zebra", "Mcnab")), (kept.remove, overlay.remove, words(spark, "jump")),
    ]
    for number, (change, plain, asked) in enumerate(steps, 1):
        assert change(asked) == number
        whole = store.written(plain(whole, asked, config), "whole")
        assert rows(kept.lexicon()) == rows(whole)
    assert rows(kept.forms()) == rows(expand.expand(whole, config.rules_df(spark), config))
    ok = {r["word"]: r["ok"] for r in spell.check(words(spark, "Openoffice", "zebra", "have", "jumped", "Mcnab", "MCNAB"), kept.forms(), kept.lexicon(), config).collect()}
    assert ok == {"Openoffice": True, "zebra": True, "have": False, "jumped": False, "Mcnab": True, "MCNAB": True}
    # A version holds what it touched, and no more.
    delta = spark.read.parquet(str(tmp_path / "lexicon/forms")).filter("version = 4")
    assert {r["root"] for r in delta.collect()} == {"zebra", "Mcnab"}
    before = rows(kept.forms())
    # What was cut off before its list of words was written is not seen.
    spark.read.parquet(str(tmp_path / "lexicon/forms/version=4")).withColumn("root", F.lit("walk")).write.partitionBy("part").parquet(str(tmp_path / "lexicon/forms/version=6"))
    assert rows(kept.forms()) == before
    kept.compact()
    assert rows(kept.forms()) == before and kept._versions("forms") == kept._versions("lexicon") == kept._versions("touched") == [6]
    kept.add(words(spark, "after"))
    assert "after" in {r["surface"] for r in kept.forms().collect()}


def test_lookups_read_buckets_without_shuffling_forms(spark):
    config, lex, forms = lexical(spark, AFFIX.strip().splitlines(), *WORDS[1:])
    stored = store.written(forms, "forms", "surface")
    assert rows(stored) == rows(forms)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = words(spark, "walked", "Cried", "zzz")
        joined = asked.join(stored, F.col("word") == F.col("surface"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        verdict = spell.check(asked, stored, lex, config)
        plan = verdict._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "Bucketed: true" in line)
        depth = len(scan) - len(scan.lstrip(" :+-"))
        above = [line for line in plan.splitlines()[: plan.splitlines().index(scan)] if len(line) - len(line.lstrip(" :+-")) < depth]
        parents, least = [], depth
        for line in reversed(above):
            if (own := len(line) - len(line.lstrip(" :+-"))) < least:
                parents.append(line)
                least = own
        join = next(k for k, line in enumerate(parents) if "Join" in line)
        assert not any("Exchange" in line for line in parents[:join])
        assert {r["word"]: r["ok"] for r in verdict.collect()} == {"walked": True, "Cried": True, "zzz": False}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_relations_are_released(spark, tmp_path):
    spark.createDataFrame([(k, "the words of a text") for k in range(6)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = catalogue.document_forms(spark, str(tmp_path))
    file = first.inputFiles()[0]
    assert catalogue.document_forms(spark, str(tmp_path)) is first
    store.release(spark)
    target, files = store._file_system(spark, file)
    assert not files.exists(target) and catalogue.document_forms(spark, str(tmp_path)).count() > 0
