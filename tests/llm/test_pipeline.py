from collections import Counter

import corpus_pipeline
import edges
import test_minhash
from paceline.llm.queries import QUERIES, SQL

import __spark_entry__


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in QUERIES if name != "pipeline"}
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]


def test_stages_on_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = docs.collect()
        assert docs.columns == columns and not Counter(after) - Counter(before), name
        if name == "exact_dedup":
            assert Counter(r.text for r in after) == Counter({r.text for r in before})
        if name == "near_dedup":
            sets, least = test_minhash.brute([tuple(r) for r in before], 5, 80)
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not sets[r.text] or least[r.text] == r.doc_id}
        if name in ("toxicity", "quality"):
            labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [r for r in before if (x := labels.get(r.doc_id)) and x.quality == 1 and x.toxic == 0]
            assert len(set(good) & set(after)) >= 0.95 * len(good)
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in after}


def test_edges(spark, sf):
    for rows in (edges.ROWS, []):
        docs = edges.documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, sf)
            assert kept.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(kept.collect(), kept.schema)
        corpus_pipeline.pack(spark, docs, sf).collect()
    # Rows with null ids are never lost to a deduplication.
    docs = edges.documents(spark)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert any(r.doc_id is None and r.text for r in stage(spark, docs, sf).collect())
