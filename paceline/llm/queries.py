"""One query per operator, over its whole table, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    lm_scoring,
    minhash,
    packing,
    prefix_trie,
    quality,
    sharding,
    spelling,
    token_counts,
    toxicity,
    vp_search,
)
from paceline.llm.common import crc32_of_id


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), n_shards=16)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc32_of_id("doc_id") % 5 == 0
    lexicon = toxicity.fit(docs, labels(spark, sf_dir).where(~held_out))
    return toxicity.scored(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoded(documents(spark, sf_dir), path, public_tokenizers.PATTERN, digests=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc32_of_id("doc_id") % 4 == 2
    trees = quality.fit(docs, labels(spark, sf_dir).where(~held_out))
    return quality.scored(docs, trees).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), length=4096, last=2)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_dedup(documents(spark, sf_dir), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(documents(spark, sf_dir), labels(spark, sf_dir), label="quality")


def op11_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vp_search.nearest(vectors, F.col("vec_id") % 20 == 0, k=20, relax=1.0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir), least_length=5, least_count=3)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_vp_search": op11_vp_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op11_vp_search": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    # The checksum is worked out byte by byte from its polynomial, the shuffle from the same md5 as in Spark.
    "op1_sharding": """
WITH steps AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS step
    FROM (SELECT unnest(range(256)) AS n)
),
bytes AS (
    SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS b
    FROM documents
),
slim AS (
    SELECT doc_id, source, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
    FROM bytes, steps
),
keyed AS (
    SELECT *, CAST('0x' || substr(md5('20|' || doc_id || '|' || text_crc32), 1, 14) AS BIGINT) AS key,
        (CAST('0x' || substr(md5('20|' || source || '|offset'), 1, 14) AS BIGINT) + 1) / 72057594037927936.0::DOUBLE AS shift
    FROM slim
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) AS rank,
        count(*) OVER (PARTITION BY source) AS source_rows FROM keyed
),
placed AS (
    SELECT *, row_number() OVER (ORDER BY (rank - shift) / source_rows, source, rank) - 1 AS position, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position * 16 // total AS INTEGER) AS shard,
    position - (position * 16 // total * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
    """,
    "op7_exact_dedup": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        ranked AS (
            SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
            FROM texts
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM ranked
    """,
    "op2_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.95
        ),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
        least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id,
            vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN least_id m ON m.x = vec_id
    """,
    "op9_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
            FROM words
        ),
        n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ),
        links AS (
            SELECT x, y FROM pairs JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
        ),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id,
            d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id m ON m.x = d.doc_id
    """,
}
