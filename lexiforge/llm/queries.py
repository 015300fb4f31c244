"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import ann, binary, collide, crf, jaccard, langid, merkle, mix, pack, rules, secrets, shard, whiten
from lexiforge.llm._common import materialize, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.filter(F.col("doc_id").isNotNull() & ~held_out).select("doc_id", "text", "lang"))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = crf.score(docs, crf.train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = materialize(shard.document_keys(table(spark, sf_dir, "documents")), "keys")
    placed = shard.shard_rows(keys, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = materialize(secrets.scan(docs).drop("text"), "scanned")
    found = secrets.secret_spans(scanned, secrets.thresholds(scanned))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed("base_spans"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = rules.judge(docs, trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op9_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op10_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = materialize(binary.packed_matrices(table(spark, sf_dir, "documents")), "matrices")
    return binary.placements(written)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(merkle.document_leaves(table(spark, sf_dir, "documents")), claim="claim")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_rns_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_collision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collide.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(text) AS text_hash FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM by_source
), ratios AS (SELECT *, cap / weight AS ratio FROM ranked
), leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios
), water AS (SELECT arg_min(level, ratio) AS water FROM leveled WHERE level <= ratio
), goals AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM ranked, water
), measured AS (SELECT *, len(bin(size + 1)) AS measure FROM sized
), by_measure AS (SELECT source, measure, CAST(sum(size) AS BIGINT) AS words FROM measured GROUP BY ALL
), spent AS (
  SELECT m.source, measure, words, source_size, target,
         (target - coalesce(sum(words) OVER (PARTITION BY m.source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
         / nullif(CAST(sum(words * measure) OVER (PARTITION BY m.source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS level
  FROM by_measure m JOIN goals g ON m.source IS NOT DISTINCT FROM g.source
), levels AS (
  SELECT source AS of_source, arg_max(level, measure) AS level FROM spent WHERE level * measure <= 2.0 GROUP BY source
), expected AS (
  SELECT s.source, measure, words, source_size, target,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN l.level IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, l.level * measure) END AS copies
  FROM spent s LEFT JOIN levels l ON s.source IS NOT DISTINCT FROM l.of_source
), shares AS (
  SELECT source, measure, source_size, target, CAST(floor(copies) AS INTEGER) AS whole, copies - floor(copies) AS odds,
         greatest(target - sum(words * CAST(floor(copies) AS BIGINT)) OVER (PARTITION BY source), 0) AS remaining
  FROM expected
), keyed AS (
  SELECT doc_id, d.source, size, text_hash, source_size, target, whole, remaining, least(greatest(odds, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS p,
         (('0x' || substr(md5('23:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text_hash, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM measured d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source AND d.measure = s.measure
), ordered AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM keyed
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size, text_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((whole + CASE WHEN whole < 2 AND size > 0 AND before + size / 2 <= remaining THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""

#: CRC-32 of UTF-8 text, four bits at a time, the lower half of a byte first.
CRC_STEPS_SQL = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(0, 16), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0]::BIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""
CRC_SQL = CRC_STEPS_SQL + """, texts AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents
), halves AS (
  SELECT doc_id, size, list_transform(range(0, (size - 1) * 2), lambda k: CAST(instr('0123456789ABCDEF', h[xor(k, 1) + 1]) - 1 AS BIGINT)) AS halves FROM texts
), keys AS (
  SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], halves), lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1])), 4294967295) AS text_crc32 FROM halves, steps
)"""

OP5_SQL = f"""{CRC_SQL}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn, count(*) OVER () AS n FROM keys
), base AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM numbered
), walk AS (
  SELECT rn, n, a, 0 AS i, rn // a AS l, rn % a AS r FROM base
  UNION ALL
  SELECT rn, n, a, i % 6 + 1, r, (l + ('0x' || substr(md5('17:' || (i % 6 + 1) || ':' || r), 1, 13))::BIGINT % a) % a
  FROM walk WHERE i < 6 OR l * a + r >= n
), image AS (SELECT rn, l * a + r AS image FROM walk WHERE i = 6 AND l * a + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(image % 16 AS INTEGER) AS shard, image // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM base JOIN image USING (rn)
"""

LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Trees are numbered by language; tree -1 is that of their roots.
OP11_SQL = f"""{CRC_STEPS_SQL}, ids AS (
  SELECT *, string_split(hex(encode(CAST(doc_id AS VARCHAR))), '') AS h FROM documents
), leaves AS (
  SELECT doc_id, lang, {LEAF_SQL.format(text="text")} AS leaf, {LEAF_SQL.format(text=LOWER_SQL)} AS lowered,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h)), lambda k: CAST(instr('0123456789ABCDEF', h[xor(k, 1) + 1]) - 1 AS BIGINT))), lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1])), 4294967295) % 3 = 0 AS tampered
  FROM ids, steps
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, place AS idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8, n
), subroots AS (SELECT tree, digest AS subroot, level AS top FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, tree AS idx, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, idx // 8, n
), every AS (
  SELECT tree, level, idx, digest FROM nodes UNION ALL SELECT -1, level, idx, digest FROM upper
), runs AS (
  SELECT e.tree, e.level, e.idx, coalesce(string_agg(o.digest, '' ORDER BY o.idx) FILTER (WHERE o.idx < e.idx), '') AS before, coalesce(string_agg(o.digest, '' ORDER BY o.idx) FILTER (WHERE o.idx > e.idx), '') AS after
  FROM every e JOIN every o ON e.tree = o.tree AND e.level = o.level AND e.idx // 8 = o.idx // 8 GROUP BY ALL
), whole AS (
  SELECT p.*, subroot, top, (SELECT digest FROM upper WHERE n = 1) AS root, (SELECT max(level) FROM upper) AS last, row_number() OVER () AS r FROM placed p JOIN subroots USING (tree)
), walk AS (
  SELECT r, tree, place AS own, 0 AS level, top, last, tree AS again, '' AS path, CASE WHEN tampered THEN lowered ELSE leaf END AS folded FROM whole
  UNION ALL
  SELECT r, CASE WHEN w.tree >= 0 AND w.level = top THEN -1 ELSE w.tree END, CASE WHEN w.tree >= 0 AND w.level = top THEN again ELSE own // 8 END, CASE WHEN w.tree >= 0 AND w.level = top THEN 0 ELSE w.level + 1 END, top, last, again,
         CASE WHEN w.tree >= 0 AND w.level = top THEN path ELSE path || before || after END, CASE WHEN w.tree >= 0 AND w.level = top THEN folded ELSE sha256(before || folded || after) END
  FROM walk w JOIN runs s ON w.tree = s.tree AND w.level = s.level AND w.own = s.idx WHERE w.tree >= 0 OR w.level < last
)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM whole JOIN walk USING (r) WHERE walk.tree = -1 AND level = walk.last
"""

OP13_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), fine AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS size FROM u
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), parts AS (SELECT a, least(a, min(b)) AS part FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, coalesce(part, vec_id) AS component_id, vec_id = coalesce(part, vec_id) AS kept FROM u LEFT JOIN parts ON a = vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_crf": op3_line_crf,
    "op4_mix_sources": op4_mix_sources,
    "op5_feistel_shards": op5_feistel_shards,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_multiprobe_neighbours": op9_multiprobe_neighbours,
    "op10_packed_matrices": op10_packed_matrices,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_rns_whitening": op12_rns_whitening,
    "op13_collision_dedup": op13_collision_dedup,
}

ORACLES: dict[str, str] = {"op4_mix_sources": OP4_SQL, "op5_feistel_shards": OP5_SQL, "op11_merkle_manifest": OP11_SQL, "op13_collision_dedup": OP13_SQL}
