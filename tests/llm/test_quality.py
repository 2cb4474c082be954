import edges
import numpy as np

from paceline.llm.common import crc32_of_id
from paceline.llm.quality import STATISTICS, fit, grow, scored, statistics


def test_statistics():
    row = dict(zip(STATISTICS, statistics("AB cd cd.\nAB cd cd.\nx1 #")))
    assert abs(row["repeated_lines"] - 1 / 3) < 1e-9 and row["distinct_words"] == 5 / 8 and row["top_word"] == 2 / 8
    assert row["capital_words"] == 2 / 8 and row["stopped_lines"] == 2 / 3
    assert statistics(None) == statistics("") == statistics(" \n") == [0.0] * len(STATISTICS)


def test_trees_part_an_interval():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 1] > 0.3) & (x[:, 1] < 0.6)).astype(float)
    trees = grow(x, y)
    p = trees.probability(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.99
    # The flat walk equals a walk down each tree.
    for row in x[:20]:
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        assert abs(total - trees.raw(row[None])[0]) < 1e-9
    # Without both labels only the base is left.
    assert len(grow(x, np.ones(2000)).roots) == 0 and grow(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = crc32_of_id("doc_id") % 4 == 2
    trees = fit(docs, labels.where(~held))
    rows = scored(docs.join(labels, "doc_id").where(held), trees).select("score", "quality").collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in rows) >= 0.98 * len(rows)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (8, 0)], "doc_id long, quality int")
    docs = edges.documents(spark)
    for some in (labels, labels.limit(0)):
        rows = scored(docs, fit(docs, some)).collect()
        assert len(rows) == len(edges.ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert scored(edges.none(spark), fit(edges.none(spark), labels)).collect() == []
