"""The gram index against scoring every root."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions.similarity import _ngram
from lexiforge.operators import root_index, suggest
from lexiforge.sources.affix import parse_affix
from lexiforge.sources.dictionary import parse_entries


def prefix(w, root):
    n = 0
    while n < min(len(w), len(root)) and (w[n] == root[n] or (n == 0 and w[0] == root[0].lower())):
        n += 1
    return n


def brute(words, rows, most):
    out = []
    for w, lower in words:
        scored = []
        for r in rows:
            if w and abs(len(r["word"]) - len(w)) <= 4 and not (lower and r["captype"] == 1 and "ph:" not in r["morph"]):
                scored.append((-(_ngram(3, w, r["word"].lower(), True, False, False) + prefix(w, r["word"])), r["entry_id"], r["word"]))
        out += [(w, e, root, -s, k) for k, (s, e, root) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("count", "most"), [(900, 10), (900, 100), (40, 100), (0, 5)])
def test_top_roots(spark, count, most):
    r = np.random.default_rng(count + most)
    syllables = ["an", "ba", "ché", "do", "er", "ff", "ing", "ll", "o", "un", "ß", "zz"]
    entries = sorted({"".join(r.choice(syllables, r.integers(1, 5))) for _ in range(count)})
    entries = [e.capitalize() if k % 7 == 0 else e for k, e in enumerate(entries)]
    lines = spark.createDataFrame(list(enumerate(["0", *[e + (" ph:x" if k % 14 == 0 else "") for k, e in enumerate(entries)]])), "entry_id bigint, value string")
    lex = parse_entries(lines, parse_affix([])).cache()
    words = [("".join(r.choice(syllables, r.integers(1, 5))), bool(k % 2)) for k in range(25)] + [("qqqq", True), ("w", True), ("aaaaaaaa", False), ("anananan", True), ("12345", True), ("", True)]
    words = list(dict(words).items())
    got = root_index.similar_roots(spark.createDataFrame(words, "w string, lower boolean"), lex, most)
    assert sorted(tuple(x) for x in got.collect()) == brute(words, lex.collect(), most)


def test_few_pairs_are_scored(spark, monkeypatch):
    r = np.random.default_rng(1)
    stems = ["".join(r.choice(list("abcdefghijklmnoprstuvz"), 3)) for _ in range(60)]
    entries = sorted({"".join(r.choice(stems, 3)) for _ in range(4000)})
    lex = parse_entries(spark.createDataFrame(list(enumerate(["0", *entries])), "entry_id bigint, value string"), parse_affix([])).cache()
    seen = []
    score = root_index.scored
    monkeypatch.setattr(root_index, "scored", lambda pairs, asked: seen.append(pairs) or score(pairs, asked))
    words = spark.createDataFrame([(e[:4] + "x" + e[5:],) for e in entries[::100]], "w string")
    assert suggest.similar_roots(words, lex, most=10).count() == 10 * words.count()
    assert sum(p.count() for p in seen) < 0.05 * words.count() * lex.filter(F.col("clen").between(5, 13)).count()
