"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, lang_id, packing, sharding, simhash, substring_dedup, suffix_dedup, token_scan, topk
from tidemark.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.substring_dedup(spark, docs)
    removed = F.expr("aggregate(removed_spans, 0L, (s, x) -> s + x.end - x.start)")
    spans = F.concat_ws(",", F.expr("transform(removed_spans, x -> concat(x.start, '-', x.end))"))
    return cut.select("doc_id", "text", spans.alias("spans"), F.size("removed_spans").cast("long").alias("n_spans"), removed.alias("n_removed"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(spark, table(spark, sf_dir, "documents"))
    decoded = bpe.decode_documents(spark, encoded)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents")).drop("text_hash")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(spark, table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spark, table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave_shards(spark, table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_token_counts(spark, table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(spark, table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)")
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_topk": op9_topk,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE = {
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, string_split(regexp_replace(text, '([\r\n]|[.!?][ \t]+)', '\1' || chr(1), 'g'), chr(1)) AS pieces
            FROM documents WHERE text IS NOT NULL
        ), p AS (
            SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM d
        ), w AS (
            SELECT *, octet_length(encode(piece)) AS size, sum(octet_length(encode(piece))) OVER o AS stop,
                   [x FOR x IN string_split_regex(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+') IF x <> ''] AS words,
                   sum(CASE WHEN right(piece, 1) IN (chr(10), chr(13)) THEN 1 ELSE 0 END) OVER o - CASE WHEN right(piece, 1) IN (chr(10), chr(13)) THEN 1 ELSE 0 END AS line
            FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY k)
        ), s AS (
            SELECT doc_id, line, stop - size AS start, stop, array_to_string(words, ' ') AS norm,
                   CAST(list_sum([1 + octet_length(encode(x)) // 15 FOR x IN words]) AS BIGINT) AS n,
                   CAST(sum(list_sum([1 + octet_length(encode(x)) // 15 FOR x IN words])) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS cum,
                   row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j
            FROM w WHERE len(words) > 0
        ), l AS (
            SELECT doc_id, line, min(j) AS a, max(j) AS b, min(cum - n) AS before, max(cum) AS cum FROM s GROUP BY doc_id, line
        ), u AS (
            SELECT x.doc_id, x.j AS a, y.j AS b FROM s x ASOF JOIN s y ON x.doc_id = y.doc_id AND y.cum >= x.cum - x.n + 30
            UNION
            SELECT x.doc_id, x.a, y.b FROM l x ASOF JOIN l y ON x.doc_id = y.doc_id AND y.cum >= x.before + 30
        ), whole AS (
            SELECT doc_id, list(norm ORDER BY j) AS norms, list(start ORDER BY j) AS starts, list(stop ORDER BY j) AS stops FROM s GROUP BY doc_id
        ), r AS (
            SELECT doc_id, starts[a] AS start, stops[b] AS stop, row_number() OVER (PARTITION BY md5(array_to_string(norms[a:b], ' ')) ORDER BY doc_id, a, b) > 1 AS again
            FROM u JOIN whole USING (doc_id)
        ), g AS (
            SELECT doc_id, start, stop, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r WHERE again
        ), i AS (
            SELECT *, sum(CASE WHEN start <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM g
        ), c AS (
            SELECT doc_id, min(start) AS a, max(stop) AS b FROM i GROUP BY doc_id, run
        ), t AS (
            SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed
            FROM c GROUP BY doc_id
        ), kept AS (
            SELECT w.doc_id, string_agg(piece, '' ORDER BY k) FILTER (WHERE c.a IS NULL) AS text
            FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND stop - size >= a AND stop <= b AND size > 0 GROUP BY w.doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(spans, '') AS spans,
               coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op3_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept,
               h AS text_sha256
        FROM d
    """,
    "op6_sharding": r"""
        WITH RECURSIVE steps(k, v, i) AS (
            SELECT range, range, 0 FROM range(256)
            UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM steps WHERE i < 8
        ), crc AS (
            SELECT list(v ORDER BY k) AS t FROM steps WHERE i = 8
        ), d AS (
            SELECT doc_id, coalesce('=' || source, 'null') AS stratum, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), c AS (
            SELECT doc_id, stratum, CAST(n + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(n)]),
                   lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1])), 4294967295) AS text_crc32
            FROM d, crc
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32 || ':' || size), doc_id, text_crc32, size) - 1 AS rank,
                   count(*) OVER (PARTITION BY stratum) AS of_source, CAST(CAST('0x' || substr(md5('interleave-1:' || stratum), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS phase
            FROM c
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY (rank + phase) / of_source, stratum, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM r
        ), s AS (
            SELECT *, pos * 8 // total AS shard FROM o
        )
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * total + 7) // 8 AS BIGINT) AS slot,
               CAST(NULL AS INTEGER) AS grown_shard, stratum
        FROM s
    """,
    "op9_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS uid, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
            FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.uid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_dot_product(q.e, c.e), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.uid <> q.uid
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op10_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
        ), l AS (
            SELECT doc_id, [md5(substr(h, 2 * i + 1, 200)) FOR i IN range(n - 99)] AS w FROM d WHERE n >= 100
        ), w AS (
            SELECT doc_id, unnest(w) AS g, generate_subscripts(w, 1) - 1 AS i FROM l
        ), r AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM w
        ), g AS (
            SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM r WHERE again
        ), o AS (
            SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
        ), s AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM o GROUP BY doc_id, run
        ), p AS (
            SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
        ), k AS (
            SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
            FROM p JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
}
