import numpy as np
from pyspark.sql import functions as F

from paceline.llm.vp_search import build, nearest, recall

FIELDS = "vec_id long, embedding array<float>, label int, rank string, score string, shard string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], FIELDS)


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows
          if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for qi, q in ok:
        if qi is None or qi % every:
            continue
        cands = sorted(((-float(sum(a * b for a, b in zip(q, v))), i) for i, v in ok if i != qi and len(v) == len(q)),
                       key=lambda t: (t[0], t[1] is None, t[1]))
        out += [(qi, r + 1, i) for r, (_, i) in enumerate(cands[:k])]
    return sorted(out, key=str)


def found(df, **options):
    return sorted(((r.query_id, r.rank, r.vec_id) for r in nearest(df, F.col("vec_id") % 20 == 0, **options).collect()), key=str)


def test_exact_over_many_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.3 * rng.normal(size=8)], 0) for i in range(600)]
    df = table(spark, rows)
    assert found(df, shard_rows=90, block_rows=7) == brute(rows)


def test_relaxed_search_recall(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(800)]
    df = table(spark, rows)
    q = F.col("vec_id") % 20 == 0
    exact = nearest(df, q, shard_rows=200)
    loose = nearest(df, q, relax=1.3, shard_rows=200)
    assert recall(exact, exact) == 1.0 and recall(loose, exact) >= 0.9


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0, 3.0], 0), (20, [1.0, 2.0, 3.0], 0), (40, [1.0, 2.0, 3.01], 0), (1, [0.0, 0.0, 0.0], 0),
        (2, None, 0), (3, [1.0, None, 2.0], 0), (4, [float("nan"), 1.0, 1.0], 0), (5, [float("inf"), 1.0, 1.0], 0),
        (60, [5.0, 5.0], 0), (7, [5.0, 5.0], 0), (8, [], 0), (9, [1.0, 2.0, 3.0], 0), (9, [1.0, 2.0, 3.0], 0),
        (80, [-1.0, -1.0, -1.0], 0),
    ]
    assert found(table(spark, rows)) == brute(rows)


def test_ties_and_copies_split_the_tree():
    points = np.ones((300, 4))
    order, vantage, lo, hi, parent, leaf_of, ranges, leaves = build(points, leaf=10)
    assert sorted(order.tolist()) == list(range(300)) and (ranges[:, 1] - ranges[:, 0]).max() <= 10


def test_empty(spark):
    assert found(table(spark, [])) == []
