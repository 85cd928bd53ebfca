"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clvforge.llm.common import table
from clvforge.llm.exact_dedup import content_sort_dedup
from clvforge.llm.licences import scan_licences
from clvforge.llm.line_chunks import drop_repeated_chunks
from clvforge.llm.mixing import mix
from clvforge.llm.negatives import mine_negatives
from clvforge.llm.pieces import encode_documents
from clvforge.llm.prefix_trie import prefix_trie, share_heads, turn_paths
from clvforge.llm.quality import classify
from clvforge.llm.simhash import hex_fingerprint, simhash_dedup

from clvforge.llm.suffix_dedup import remove_repeats

from clvforge.llm.surrogates import replace_entities
from clvforge.llm.topk import cover_tree_topk
from clvforge.llm.toxicity import detect_toxicity


def model_path() -> str:
    """The vocabulary file of the queries; a parameter of the operator."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), key=b"example key of the query")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort_dedup(docs).select(
        F.col("_row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("changed"),
                      F.expr("make_valid_utf8(cast(kept as string))").alias("kept"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree_topk(table(spark, sf_dir, "embeddings"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.concat_ws(" ", c).alias(c)
    return scan_licences(table(spark, sf_dir, "documents")).select(
        "doc_id", listed("licences"), listed("sentences"), listed("leftover"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path(), keep_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(share_heads(turn_paths(table(spark, sf_dir, "conversations")))).drop("node", "parent")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_cover_tree": op4_cover_tree,
    "op5_licences": op5_licences,
    "op6_quality": op6_quality,
    "op7_line_chunks": op7_line_chunks,
    "op8_mixing": op8_mixing,
    "op9_pieces": op9_pieces,
    "op10_simhash": op10_simhash,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
                          length(coalesce(text, '')) AS chars,
                          md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
                     list_concat([4294967295::BIGINT], flatten([list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])
                                                                for ch in string_split(conv_id::VARCHAR, '')])),
                     lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 6 AS h
                   FROM (SELECT DISTINCT conv_id FROM t)),
             r AS (SELECT c.conv_id, 0 AS part, p, chars, e FROM c JOIN t ON t.conv_id = c.base AND p <= h
                   UNION ALL SELECT conv_id, 1, p, chars, e FROM c JOIN t USING (conv_id) WHERE p > h),
             m AS (SELECT conv_id, row_number() OVER w AS d, chars, string_agg(e, '') OVER w AS k FROM r
                   WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
                   UNION ALL SELECT conv_id, 0, 0, '' FROM c),
             n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY d, k),
             kids AS (SELECT d - 1 AS d, left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
             f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
             sub AS (SELECT a.d, a.k, sum((y.n_convs - 1) * y.chars)::BIGINT AS saved_tokens,
                            count(*) FILTER (y.n_children = 0) AS n_leaves
                     FROM f y JOIN m a ON a.conv_id = y.conv_id AND a.d <= y.d GROUP BY ALL),
             ends AS (SELECT d, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s
                      FROM (SELECT conv_id, max(d) AS d, arg_max(k, d) AS k FROM m GROUP BY conv_id) GROUP BY d, k)
        SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
               coalesce(ends.s, sha256('')) AS ends_sha256
        FROM f JOIN sub USING (d, k) LEFT JOIN ends USING (d, k)
             LEFT JOIN f p ON p.d = f.d - 1 AND p.k = left(f.k, 32 * (f.d - 1))""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
             s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
                          list_inner_product(q.e, c.e)::BIGINT AS score
                   FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
        QUALIFY rank <= 5""",
    "op4_cover_tree": """
        WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
                   FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)""",
}
