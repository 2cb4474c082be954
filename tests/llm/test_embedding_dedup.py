import math

import numpy as np

from paceline.llm.embedding_dedup import audited_recall, near_dedup

FIELDS = "vec_id long, embedding array<float>, label int, node string, vector string, links string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], FIELDS)


def brute(rows, least=0.95):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    # As the table holds them: single precision, compared in double.
    kept = [(k, np.array(v, dtype=np.float32).astype(float)) for k, (_, v) in enumerate(rows) if usable(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    x = np.array([v / np.sqrt((v * v).sum()) for _, v in kept])
    for a, b in np.argwhere(x @ x.T >= least).tolist() if kept else ():
        if a != b:
            a, b = kept[a][0], kept[b][0]
            links[a] += 1
            parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    least_id = [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(rows))]
    return sorted(str((i, links[k], least_id[k])) for k, (i, _) in enumerate(rows))


def check(spark, rows, **options):
    found = near_dedup(frame(spark, rows), **options).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in found) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def clusters(seed, groups, size, noise, lone, dims=32):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        out += [centre / np.linalg.norm(centre) + noise * rng.standard_normal(dims) / math.sqrt(dims) for _ in range(size)]
    out += [rng.standard_normal(dims) for _ in range(lone)]
    return [(k, [float(x) for x in v]) for k, v in enumerate(rng.permutation(np.array(out)))]


def test_small_groups_over_many_parts(spark):
    check(spark, clusters(1, 60, 3, 0.2, 200), part_rows=60)


def test_one_large_group(spark):
    check(spark, clusters(2, 1, 250, 0.25, 100), part_rows=80, ask_rows=50)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (7, [float("nan"), 1.0, 1.0]),
            (8, [float("inf"), 1.0, 1.0]), (None, v), (None, None), (9, [-1.0, -2.0, -3.0]), (10, []), (11, [3.0, -2.0, 0.1])]
    check(spark, rows)
    assert near_dedup(frame(spark, [])).collect() == []
    assert [tuple(r) for r in near_dedup(frame(spark, [(5, None)])).collect()] == [(5, 0, 5, True)]
    check(spark, [(5, v)])


def test_recall(spark):
    rows = clusters(4, 40, 10, 0.2, 400, dims=64)
    vectors = frame(spark, rows)
    result = near_dedup(vectors, part_rows=100)
    assert 0.99 <= audited_recall(vectors, result, every=10) <= 1.0
