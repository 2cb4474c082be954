"""From raw documents to packed sequences: filters, both kinds of deduplication, and packing.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
`documents`. Null texts count as empty; rows with null ids pass through every stage like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import exact_dedup, minhash, packing, quality, toxicity
from paceline.llm.common import crc32_of_id, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The lexicon is learnt on the labels' training fold."""
    labels = _labels(spark, sf_dir).where(crc32_of_id("doc_id") % 5 != 0)
    lexicon = toxicity.fit(docs, labels)
    return toxicity.scored(docs, lexicon, score_col="_score").where("_score < 0.5").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.7 go. The trees are grown on the labels' training fold."""
    labels = _labels(spark, sf_dir).where(crc32_of_id("doc_id") % 4 != 2)
    trees = quality.fit(docs, labels)
    return quality.scored(docs, trees, score_col="_score").where("_score >= 0.7").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.unique_rows(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8 or more the one with the smallest id stays."""
    found = minhash.near_dedup(docs, shingle=5, percent=80)
    gone = written(found.where(~F.col("kept")).select("doc_id", "text_hash").distinct(), "near-copies")
    same = (F.col("d.doc_id") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_hash"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, last=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Scores, shingles and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
