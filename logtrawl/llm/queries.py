"""Queries of this subpackage over the given tables, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dual_tree, exact_top, packing, pii, prefix_forest, prefix_trie, recursive_bpe, secrets, shards, signature_join, simple8b, token_text, toxicity
from .common import byte_bpe_path, byte_ranks_path, documents, embeddings


HELD_OUT = "coalesce(crc32(cast(cast({0} as string) as binary)) % 4 = 2, false)"


def op1_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, labels, keep="not " + HELD_OUT.format("id"))
    return scored.select("doc_id", F.expr(HELD_OUT.format("doc_id")).alias("held_out"), F.col("_toxic_score").alias("score"), F.col("_toxic_predicted").alias("predicted"))


def op2_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top.exact_top(embeddings(spark, sf_dir), k=5, every=50)


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(documents(spark, sf_dir), byte_bpe_path(), end_id=2)


def op4_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("live", "text_key")


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.forest_search(embeddings(spark, sf_dir), k=20, every=20)


def op6_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.linked_groups(documents(spark, sf_dir))


def op7_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), byte_bpe_path(), end_id=0, window=1024)


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op9_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_text.round_trip_digests(documents(spark, sf_dir), byte_bpe_path())


def op10_byte_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(documents(spark, sf_dir), shards=40)


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def op12_turn_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_head_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_recursive_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive_bpe.round_trip_digests(documents(spark, sf_dir), byte_ranks_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_clause_grammar, op2_no_random_access, op3_simple8b, op4_ownership, op5_prefix_forest, op6_signature_trees, op7_sum_of_squares, op8_weak_supervision, op9_pair_index, op10_byte_prefix, op11_dual_tree, op12_turn_matrices, op13_recursive_merges, pipeline)}

OP2_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

OP6_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                          WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS own FROM w),
e AS MATERIALIZED (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(own)::BIGINT AS n_shingles, least(s.doc_id, min(reach.y)) AS component_id
FROM s JOIN reach ON reach.x = s.doc_id GROUP BY s.doc_id, own"""

OP11_SQL = """WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM b) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
v AS (SELECT item, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM v
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 20"""

#: CRC-32 of the decimals of conv_id by its bits; equal turns are in the order of the hash that the library takes
OP12_SQL = """WITH t AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, ''))::BIGINT AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, id, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
         list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::UBIGINT)),
         lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::UBIGINT)),
           lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, o.i, o.id, o.chars FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h
      UNION ALL SELECT c.conv_id, o.i, o.id, o.chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
p AS (SELECT c.conv_id, coalesce(list(r.id ORDER BY r.i) FILTER (WHERE r.id IS NOT NULL), []) AS path, coalesce(list(r.chars ORDER BY r.i) FILTER (WHERE r.id IS NOT NULL), []) AS sizes
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, len(path) AS n, sizes, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
nodes AS MATERIALIZED (
  SELECT path[1:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[depth]), 0) * (count(*) - 1) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM m GROUP BY path[1:depth], depth),
kids AS (SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
filled AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key, depth)),
up AS (SELECT key[1:above] AS key, above AS depth, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
       FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM filled) GROUP BY ALL)
SELECT f.conv_id, f.depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM filled f JOIN up USING (key, depth) LEFT JOIN filled parent ON parent.depth = f.depth - 1 AND parent.key = f.key[1:f.depth - 1]"""

#: Tokenizers, fitted models and checksums are not SQL: the others are tested against brute force, the tokenizers
#: library, exact round trips or held-out rows
ORACLE: dict[str, str] = {"op2_no_random_access": OP2_SQL, "op6_signature_trees": OP6_SQL, "op11_dual_tree": OP11_SQL, "op12_turn_matrices": OP12_SQL}
