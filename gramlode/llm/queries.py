"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gramlode.llm import bagminhash, chat, lm, mtree, negatives, packing, pii, ranking, repair, shinglejoin, simhash, treebpe, warc
from gramlode.llm.common import keep, table


def id_remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm.score(table(spark, sf_dir, "documents"), id_remainder(7) != 2)
    return rows.select("doc_id", (~F.col("fit")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(keep(chat.formatted(turns.unionByName(added)), "chat"))


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mtree.whole_steps(F.col("embedding")).alias("vector"))
    return mtree.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op5_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_neighbours(simhash.edited(table(spark, sf_dir, "documents")))


def op7_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.with_sizes(keep(bagminhash.near_classes(table(spark, sf_dir, "documents")), "classes"))


def op8_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = ranking.fit(docs, table(spark, sf_dir, "labels"), usable=id_remainder(3) != 1)
    held_out = (id_remainder(3) == 1).alias("held_out")
    return ranking.score(docs, ranker).select("doc_id", held_out, "score", "predicted")


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep(pii.find(table(spark, sf_dir, "documents")), "pii")
    return pii.digests(found, pii.accepted_cells(found))


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.digests(table(spark, sf_dir, "documents"))


def op11_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), mtree.whole_steps(F.col("embedding")).alias("vector"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20; nulls in it, and null roles and texts, are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.col("kind"), F.coalesce("text", space)
    return conversations.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind <> 0").select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("nth"),
    )


def op12_big_integer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(turns).drop("nth")
    return repair.report(rows, repair.Plan(rows), turns)


def op13_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shinglejoin.components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_prefix_targets": op2_prefix_targets,
    "op3_warc_chain": op3_warc_chain,
    "op4_mtree_top_k": op4_mtree_top_k,
    "op5_bm25_packing": op5_bm25_packing,
    "op6_simhash": op6_simhash,
    "op7_bag_min_hash": op7_bag_min_hash,
    "op8_bradley_terry": op8_bradley_terry,
    "op9_weak_supervision_pii": op9_weak_supervision_pii,
    "op10_tree_bpe": op10_tree_bpe,
    "op11_shared_list_negatives": op11_shared_list_negatives,
    "op12_big_integer_repair": op12_big_integer_repair,
    "op13_shingle_join": op13_shingle_join,
    "pipeline": corpus_pipeline.run,
}
# --------------------------------------------------------------------------- SQL of those that SQL can express

_CONTROL = "<</SYS>>|\\[/INST\\]|<<SYS>>|</role>|\\[INST\\]|<role>|<end>|</s>|<s>|\\\\"

OP2_SQL = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 18 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END
    + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS size,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS n_examples
FROM placed GROUP BY conv_id"""

OP3_SQL = """WITH full_pages AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to
FROM full_pages"""

OP4_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

OP11_SQL = """WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT *, row_number() OVER () AS a FROM v WHERE vec_id % 100 = 0),
pairs AS MATERIALIZED (
  SELECT a, q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM anchors q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS nth FROM pairs WHERE same) WHERE nth <= 5),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.nth ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5"""

OP13_SQL = r"""WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(1, len(w) - 4) + 1)]) AS s
  FROM split WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s) GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(b), d.doc_id) AS component_id
FROM split d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reached ON a = d.doc_id GROUP BY d.doc_id"""

ORACLES = {"op2_prefix_targets": OP2_SQL, "op3_warc_chain": OP3_SQL, "op4_mtree_top_k": OP4_SQL, "op11_shared_list_negatives": OP11_SQL, "op13_shingle_join": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
