"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from incidentkit.llm import byte_bpe, conversation_trie, decontaminate, hadamard_clusters, html_blocks, kd_topk, language_id, piece_bpe, quality, secret_ledger, simhash, token_prefix, url_templates
from incidentkit.llm.common import fold_of, table

QUALITY_CUT = 0.7
TOKEN_LIMIT = 512
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return kd_topk.top_k(table(spark, folder, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.predict(docs, language_id.fit(docs, fold_of(F.col("doc_id"), 3) != 1))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(table(spark, folder, "pages"), RULES)


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_ledger.digests(secret_ledger.scan(table(spark, folder, "documents")))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_prefix.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_blocks.extract(table(spark, folder, "pages"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op11_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return hadamard_clusters.with_inertia(*hadamard_clusters.cluster(table(spark, folder, "embeddings")))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation c opens with the first crc32(c) mod 9 turns of conversation c - c % 5."""
    turns = conversation_trie.ordered_turns(table(spark, folder, "conversations"))
    c = F.col("conv_id")
    rebuilt = conversation_trie.reopened(turns, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)
    return conversation_trie.with_digests(*conversation_trie.nodes(*rebuilt))


def op13_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


_ALL = (
    op1_decontaminate, op2_quality, op3_top_k, op4_language, op5_url_filter, op6_secrets, op7_byte_bpe, op8_token_counts, op9_main_text, op10_simhash,
    op11_clusters, op12_conversation_trie, op13_piece_bpe,
)
QUERIES = {f.__name__: f for f in _ALL}


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """Each round as two tables: assignments c<r> of all vectors, then the next centroids."""
    kept = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
    first = f"""m0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
              FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""
    steps = [kept, first]
    for r in range(rounds + 1):
        # Rows are told apart by their number, since ids may repeat.
        steps.append(f"""a{r} AS (SELECT vec_id, v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
              SELECT w.n, w.vec_id, w.v, m.cluster, list_sum(list_transform(list_zip(w.v, m.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
              FROM (SELECT row_number() OVER () AS n, vec_id, v FROM v) w CROSS JOIN m{r} m) GROUP BY n, vec_id, v)""")
        if r < rounds:
            steps.append(f"""m{r + 1} AS (SELECT m.cluster, coalesce(g.c, m.c) AS c FROM m{r} m LEFT JOIN (
              SELECT cluster, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS c
              FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)
              GROUP BY cluster) g USING (cluster))""")
    return f"""WITH {", ".join(steps)}
        SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN m{rounds} m USING (cluster)"""


#: CRC-32 of a decimal number: eight shifts for every character.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
              lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

ORACLES = {
    "op11_clusters": _lloyd_sql(),
    "op12_conversation_trie": f"""
        WITH o AS (SELECT conv_id AS c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS turns
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
             h AS (SELECT c, turns, c - c % 5 AS base, {_CRC} % 9 AS h FROM o),
             p AS (SELECT h.c, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS path FROM h LEFT JOIN o b ON b.c = h.base),
             m AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
             n AS (SELECT list_slice(path, 1, depth) AS path, depth, min(c) AS conv_id, count(*) AS n_convs,
                          coalesce(string_agg(CASE WHEN len(path) = depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
                   FROM m GROUP BY ALL),
             w AS (SELECT n.*, k.conv_id AS parent_conv_id, (n.n_convs - 1) * coalesce(strlen(n.path[len(n.path)].text), 0) AS saved, count(*) FILTER (u.depth IS NOT NULL) AS n_children
                   FROM n LEFT JOIN n k ON k.depth = n.depth - 1 AND k.path = list_slice(n.path, 1, n.depth - 1)
                          LEFT JOIN (SELECT depth - 1 AS depth, list_slice(path, 1, depth - 1) AS path FROM n WHERE depth > 0) u ON u.depth = n.depth AND u.path = n.path GROUP BY ALL),
             s AS (SELECT depth, path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
                   FROM (SELECT unnest(range(0, w.depth + 1)) AS depth, w.path AS whole, saved, n_children FROM w) x, LATERAL (SELECT list_slice(x.whole, 1, x.depth) AS path) GROUP BY depth, path)
        SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
        FROM w JOIN s ON s.depth = w.depth AND s.path = w.path
    """,
    "op3_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
