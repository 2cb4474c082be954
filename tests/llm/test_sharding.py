import zlib

import edges
from paceline.llm.sharding import shards


def laws(rows, docs, n):
    assert len(rows) == len(docs)
    sizes = [sum(r.shard == k for r in rows) for k in range(n)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1
    for k in range(n):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Many small ranges give what one range gives.
    rows = shards(docs, 16, rows_per_range=9).collect()
    laws(rows, texts, 16)
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in shards(docs, 16).collect()}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None
    assert {(r.doc_id, r.shard) for r in rows} != {(r.doc_id, r.shard) for r in shards(docs, 16, seed=21).collect()}


def test_mixture(spark):
    # One hot source, a middle one, and sources of one row each.
    rows = [(k, f"t{k}", None, "hot" if k < 600 else "mid" if k < 800 else f"s{k}", None) for k in range(1000)]
    found = shards(edges.documents(spark, rows), 8, rows_per_range=50).collect()
    laws(found, rows, 8)
    for k in range(8):
        names = [r.source for r in found if r.shard == k]
        assert 67 <= names.count("hot") <= 83 and 21 <= names.count("mid") <= 29


def test_edges(spark):
    found = shards(edges.documents(spark), 5).collect()
    laws(found, edges.ROWS, 5)
    assert {(r.size, r.text_crc32) for r in found if r.doc_id == 3} == {(1, 0)}
    assert shards(edges.none(spark), 5).collect() == []
    assert len(shards(edges.documents(spark, edges.ROWS[:1]), 16).collect()) == 1
