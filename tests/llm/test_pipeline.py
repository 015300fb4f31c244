from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexiforge.llm import components, jaccard, mix, queries, stages
from lexiforge.llm._common import materialize
from tests.llm.test_operators import EN, docs, prose  # noqa: F401


def test_stages_keep_columns_and_rerun(spark, docs, tmp_path):  # noqa: F811
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    (tmp_path / "in").mkdir()
    docs.select(*columns).write.parquet(str(tmp_path / "in/documents.parquet"))
    current, seen = spark.read.parquet(str(tmp_path / "in/documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path / "in"))
        current.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen[name] = current.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert current.columns == columns
    assert not set(seen["language_id"]["doc_id"].dropna()) & {103, 104, 108, 110}
    kept = set(seen["near_duplicates"]["doc_id"].dropna())
    assert 100 in kept and 105 in kept and not kept & {101, 102, 106} and set(range(20)) <= kept
    assert not seen["secret_scan"]["text"].str.contains("AKIA").any() and len(seen["secret_scan"]) == len(seen["near_duplicates"])
    assert seen["pack_sequences"].groupby("sequence_id")["length"].sum().max() <= 1024
    again = corpus_pipeline.run(spark, str(tmp_path / "in")).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(str, again[key].itertuples(index=False))) == sorted(map(str, seen["pack_sequences"][key].itertuples(index=False)))


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


def test_near_duplicates_are_decided_by_row(spark):
    a, b, c, d, e = (prose(100, EN, 70 + i) for i in range(5))
    near = lambda t: t + " end"
    rows = [(1, b), (3, a), (3, near(b)), (50, near(a)), (3, c), (3, c), (None, near(d)), (9, d), (9, near(d)), (None, e), (None, near(e)), (4, ""), (4, ""), (None, ""), (None, "")]
    got = stages.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()
    ids = sorted((r["doc_id"] or 0, r["text"]) for r in got if r["doc_id"] != 9 and not (r["text"] or "").startswith(e))
    assert ids == sorted([(1, b), (3, a), (3, c), (4, ""), (0, ""), (0, "")])
    assert [r["text"].startswith(d) for r in got if r["doc_id"] == 9] == [True]
    assert [r["doc_id"] for r in got if r["text"].startswith(e)] == [None]


def test_rows_of_one_id_are_drawn_each_for_itself(spark):
    rows = [(7 if i % 5 else i, prose(20, EN, 500 + i), f"s{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    drawn, want = mix.draw(df).toPandas(), mix.mix_sources(df).toPandas()
    words = drawn.assign(size=drawn["text"].str.split().str.len()).groupby("source")["size"].sum()
    assert words.to_dict() == want.groupby("source")["taken"].sum().to_dict()


def test_without_labels_nothing_is_judged(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "12 ..", None)]
    with pytest.warns(UserWarning, match="no document is labelled"):
        kept = stages.keep_known_languages(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "")
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_texts_are_scanned_for_secrets_once(spark, monkeypatch):
    scans, scan = [], stages.secrets.scan
    monkeypatch.setattr(stages.secrets, "scan", lambda *a: scans.append(1) or scan(*a))
    rows = [(1, "password = hunter2hunter2 and more"), (2, None), (3, "nothing")]
    got = stages.redact_secrets(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    assert len(scans) == 1 and texts[2] is None and texts[3] == "nothing" and "hunter2" not in texts[1]


def test_pairs_are_compared_once(spark, monkeypatch):
    # Passages shared by two texts (40 to 95 % of each), by three and by five; half of the rows are written twice.
    r, texts = np.random.default_rng(5), []
    words = lambda n: [f"w{i}" for i in r.integers(0, 1 << 40, n)]
    for members, percent in ((2, 40), (2, 55), (2, 70), (2, 95), (2, 95), (3, 60), (3, 93), (5, 70), (5, 95)):
        passage = words(18 * percent)
        texts += [" ".join(passage + words(18 * (100 - percent))) for _ in range(members)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts) if i % 2]
    compared, verified = Counter(), jaccard.verified

    def watched(pairs, *args, **more):
        compared.update((bytes(p["a"]), bytes(p["b"])) for p in pairs.collect())
        return verified(pairs, *args, **more)

    monkeypatch.setattr(jaccard, "verified", watched)
    got = {p["doc_id"]: p["component_id"] for p in jaccard.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 5, 80).collect()}
    sets, part = {i: set(jaccard.shingle_set(t, 5).tolist()) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((part[i], part[j]))
                part = {d: low if c == high else c for d, c in part.items()}
    assert got == part and len(set(part.values())) < len(texts)
    assert compared and max(compared.values()) == 1


def test_links_between_components_join_them(spark):
    # Paths, a link within a component, one of two components, one to a node without any, and two new nodes.
    first, more = [(1, 2), (2, 3), (5, 6), (8, 9), (9, 10)], [(1, 3), (10, 6), (3, 4), (20, 21)]
    kind = "a bigint, b bigint"
    written = lambda rows: materialize(spark.createDataFrame(rows, kind).repartition(2), "links")
    of = lambda df: {r["node"]: r["part"] for r in df.collect()}
    parts = components.connected_components(written(first))
    same = components.joined_components(parts, written([]))
    assert same is parts and components.joined_components(parts, written([(1, 3)])) is parts
    joined = of(components.joined_components(parts, written(more)))
    assert joined == of(components.connected_components(written(first + more)))
    assert joined == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 5, 9: 5, 10: 5, 20: 20, 21: 20}


def test_few_plans_where_little_is_left_to_do(spark, monkeypatch):
    # Every written table is a plan that the driver makes, compiles and keeps.
    made = []
    for module in (jaccard, components):
        monkeypatch.setattr(module, "materialize", lambda df, tag, *more: made.extend([tag] * (1 + len(more))) or materialize(df, tag, *more))
    texts = [prose(60, EN, 900 + i) for i in range(12)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[1] + " end"])), "doc_id bigint, text string").repartition(3)
    of = lambda: {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(df, 3, 80).collect()}
    whole = of()
    assert whole == {i: i for i in range(12)} | {12: 0, 13: 1}
    assert len(made) <= 30, Counter(made)
    monkeypatch.setattr(jaccard, "ONE_SLICE", 0, raising=False)
    assert of() == whole
