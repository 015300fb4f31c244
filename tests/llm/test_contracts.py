"""Every registered query on a small table with nulls, repeats and empty texts: columns, types and fixed values."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import queries
from tests.llm.test_operators import docs  # noqa: F401

CONTRACTS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_line_crf": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_feistel_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_multiprobe_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_packed_matrices": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"},
    "op11_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op12_rns_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_collision_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("tables"))
    docs.drop("piece").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    x = np.random.default_rng(5).normal(size=(300, 8))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(400, None, 0), (401, x[0].tolist(), 0), (402, x[0].tolist(), None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, docs, folder, name):  # noqa: F811
    found = queries.QUERIES[name](spark, folder)
    kinds = dict(found.dtypes)
    assert {c: kinds[c] for c in CONTRACTS[name]} == CONTRACTS[name]
    got, texts = found.toPandas(), docs.select("doc_id", "text").toPandas()
    plain = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text or "") for r in texts.itertuples()]
    if name == "op9_multiprobe_neighbours":
        assert sorted(set(got["query_id"])) == [0, 100, 200] and len(got) == 30
        return
    if name == "op12_rns_whitening":
        assert len(got) == 302 * 8 and sorted(set(got["component"])) == list(range(1, 9)) and set(got["n"]) == {300}
        return
    if name == "op13_collision_dedup":
        assert len(got) == 303 and got.set_index("vec_id").loc[401, "component_id"] == 0 and got["kept"].sum() == 302
        return
    if "piece" not in kinds:
        assert len(got) == len(plain)
    if "held_out" in kinds:
        of, rest = (4, 2) if name.startswith("op1_") else (5, 0)
        assert got["held_out"].notna().all() and got["score"].between(0, 1).all()
        for r in got.itertuples():
            assert r.held_out == (not pd.isna(r.doc_id) and zlib.crc32(str(int(r.doc_id)).encode()) % of == rest)
    if name == "op3_line_crf":
        assert (got["predicted"] == (got["score"] >= 0.3)).all()
    if name == "op5_feistel_shards":
        want = sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in plain)
        assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, folder, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{folder}/{name_}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    columns = sorted(c for c in got.columns if c != "grown_shard")
    rows = lambda found: sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v for v in r]) for r in found)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").df()
    assert rows(got.select(*[F.col(c) for c in columns]).toPandas().itertuples(index=False)) == rows(want.itertuples(index=False))
