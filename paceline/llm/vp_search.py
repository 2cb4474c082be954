"""Nearest neighbours by largest inner product: a vantage-point tree per shard, pruned by the triangle inequality.

Inner products are not a metric, so each shard maps them to one: with M the largest norm in the shard, a point p
becomes (p, sqrt(M^2 - |p|^2)) and a query q becomes (q, 0); then |q' - p'|^2 = |q|^2 + M^2 - 2 q.p, and the nearest
points are those of largest inner product. A vantage-point tree splits a set of points by their distance to one of
them; a query skips a subtree when its distance to the vantage point, less or more the subtree's range of
distances, already exceeds the distance of the k-th best found so far divided by `relax`. `relax = 1` is exact
search; a larger factor prunes more and may miss neighbours (measure recall against `exact_neighbours`).

Work is dealt as (shard, block of queries) tasks: every query meets every shard, each shard answers with its own k
best, and the best k of those are kept per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points a shard holds on average, and queries a block holds: together they bound one task's memory.
SHARD_ROWS = 50_000
BLOCK_ROWS = 2_000
#: Points of a leaf.
LEAF = 48
#: Leaves scored at one step of a query, and queries that step together.
STEP = 8
QUERY_BATCH = 128

ANSWER = "query_id long, vec_id long, score double, shard_rank int"


def usable(col: str = "embedding") -> Column:
    """Vectors that take part: not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & finite & F.exists(col, lambda x: x != 0)


def build(points: np.ndarray, leaf: int = LEAF):
    """A vantage-point tree: node arrays (vantage, lo/hi distance range per child, children) and leaf ranges.

    Points are reordered so each leaf is a contiguous range of `order`. Vantage points are the first point of
    their set, in the (hashed) order the shard gave; ties of distance are split by position, and each child keeps
    the exact [lo, hi] range of its distances, so copies and ties still bound correctly.
    """
    n = len(points)
    order = np.arange(n)
    vantage, child_lo, child_hi, children, parent_of = [], [], [], [], []
    leaves = []  # (node id, start, stop)
    stack = [(0, n, -1, 0.0, 0.0)]  # start, stop in order, parent node, lo, hi
    node_lo, node_hi, node_parent, node_leaf = [], [], [], []
    while stack:
        start, stop, parent, lo, hi = stack.pop()
        me = len(node_lo)
        node_lo.append(lo), node_hi.append(hi), node_parent.append(parent)
        if stop - start <= leaf:
            node_leaf.append(len(leaves))
            leaves.append((me, start, stop))
            vantage.append(-1)
            continue
        node_leaf.append(-1)
        idx = order[start:stop]
        v = idx[0]
        d = np.sqrt(np.maximum(((points[idx] - points[v]) ** 2).sum(axis=1), 0.0))
        sort = np.argsort(d, kind="stable")
        order[start:stop] = idx[sort]
        d = d[sort]
        half = (stop - start) // 2
        vantage.append(v)
        stack.append((start + half, stop, me, float(d[half]), float(d[-1])))
        stack.append((start, start + half, me, float(d[0]), float(d[half - 1])))
    return (
        order, np.array(vantage), np.array(node_lo), np.array(node_hi), np.array(node_parent), np.array(node_leaf),
        np.array([(s, e) for _, s, e in leaves], dtype=np.int64).reshape(-1, 2), np.array([m for m, _, _ in leaves]),
    )


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products summed component by component in order, in double precision."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def search(points: pd.DataFrame, queries: pd.DataFrame, k: int, relax: float) -> pd.DataFrame:
    """The k best of one shard for each query of one block: query_id, vec_id, score, shard_rank."""
    if points.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard_rank": []})
    P = np.stack(points["v"].to_numpy()).astype(np.float64)
    ids = points["vec_id"].to_numpy()
    Q = np.stack(queries["v"].to_numpy()).astype(np.float64)
    qids = queries["vec_id"].to_numpy()
    norms = (P * P).sum(axis=1)
    top = float(norms.max())
    lifted = np.hstack([P, np.sqrt(np.maximum(top - norms, 0.0))[:, None]])
    order, vantage, lo, hi, parent, leaf_of, ranges, leaf_nodes = build(lifted)
    qn = (Q * Q).sum(axis=1)
    # Distances of all queries to all vantage points, then each node's lower bound from its parents down.
    inner_nodes = np.flatnonzero(vantage >= 0)
    dist = np.full((len(Q), len(vantage)), np.nan)
    if len(inner_nodes):
        dist[:, inner_nodes] = np.sqrt(np.maximum(qn[:, None] + top - 2.0 * (Q @ P[vantage[inner_nodes]].T), 0.0))
    bound = np.zeros((len(Q), len(vantage)))
    for node in range(1, len(vantage)):
        p = parent[node]
        dp = dist[:, p]
        bound[:, node] = np.maximum(bound[:, p], np.maximum(dp - hi[node], lo[node] - dp))
    leaf_bound = bound[:, leaf_nodes]
    # Leaves as a padded table of point numbers; ties of score go to the smaller vec_id (null last).
    width = int((ranges[:, 1] - ranges[:, 0]).max())
    table = np.full((len(ranges), width + 1), -1, dtype=np.int64)
    for j, (a, b) in enumerate(ranges):
        table[j, : b - a] = order[a:b]
    tie = np.empty(len(ids), dtype=np.int64)
    tie[np.lexsort((ids, pd.isna(ids)))] = np.arange(len(ids))
    tie = np.append(tie, np.iinfo(np.int64).max)  # the padding's place, after every point
    padded = np.vstack([P, np.zeros((1, P.shape[1]))])
    keep, slack, pad = k + 4, 1e-9, len(P)
    parts = []
    for lo_q in range(0, len(Q), QUERY_BATCH):
        rows = np.arange(lo_q, min(lo_q + QUERY_BATCH, len(Q)))
        visit = np.argsort(leaf_bound[rows], axis=1, kind="stable")
        best_s = np.full((len(rows), keep), -np.inf)
        best_i = np.full((len(rows), keep), pad, dtype=np.int64)
        for at in range(0, visit.shape[1], STEP):
            chunk = visit[:, at : at + STEP]
            reach = np.sqrt(np.maximum(qn[rows] + top - 2.0 * best_s[:, -1], 0.0))
            live = np.take_along_axis(leaf_bound[rows], chunk, axis=1) <= (reach / relax * (1 + slack) + slack)[:, None]
            if not live.any():
                break
            on = np.flatnonzero(live.any(axis=1))
            members = np.where(live[on][:, :, None], table[chunk[on]], -1).reshape(len(on), -1)
            members = np.where((members >= 0) & (ids[np.maximum(members, 0)] != qids[rows[on]][:, None]), members, pad)
            scores = np.einsum("qd,qnd->qn", Q[rows[on]], padded[members])
            scores[members == pad] = -np.inf
            cand_s = np.hstack([best_s[on], scores])
            cand_i = np.hstack([best_i[on], members])
            pick = np.lexsort((tie[cand_i], -cand_s), axis=1)[:, :keep]
            best_s[on] = np.take_along_axis(cand_s, pick, axis=1)
            best_i[on] = np.take_along_axis(cand_i, pick, axis=1)
        # Scores that are output are summed component by component, then the order is decided on them.
        exact = np.zeros(best_i.shape)
        for j in range(Q.shape[1]):
            exact += Q[rows, j][:, None] * padded[best_i, j]
        exact[best_i == pad] = -np.inf
        pick = np.lexsort((tie[best_i], -exact), axis=1)[:, :k]
        chosen = np.take_along_axis(best_i, pick, axis=1)
        score = np.take_along_axis(exact, pick, axis=1)
        real = chosen != pad
        rank = np.cumsum(real, axis=1)
        parts.append(pd.DataFrame({
            "query_id": np.broadcast_to(qids[rows][:, None], chosen.shape)[real],
            "vec_id": ids[chosen[real]], "score": score[real], "shard_rank": rank[real].astype(np.int32),
        }))
    return pd.concat(parts, ignore_index=True)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k candidates of largest inner product: query_id, rank (from 1), vec_id, score.

    `queries` selects the query rows among the usable vectors; every other usable row is a candidate (rows with the
    query's own vec_id are not). Scores are the inner product in double precision, summed component by component;
    ties go to the smaller vec_id. Vectors of different lengths never meet. Rows with a null vec_id are candidates but
    no query. No usable vectors or no queries: no rows.
    """
    rows = vectors.where(usable(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).withColumn("dim", F.size("v"))
    asked = vectors.where(usable(vector_col) & queries).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    asks = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("nq"))
    plan = sizes.join(asks, "dim").select(
        "dim", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows)).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("nq") / block_rows)).cast("int").alias("blocks"),
    )
    # One row per length: as many rows as vector lengths, a handful.
    plan = F.broadcast(plan)
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")
    points = rows.join(plan, "dim").select("vec_id", "v", "dim", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = asked.join(plan, "dim").select("vec_id", "v", "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    keys = ["dim", "shard", "block"]
    found = points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda a, b: search(a, b, k, relax), ANSWER)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def exact_neighbours(vectors: DataFrame, queries: Column, k: int = 20, **options) -> DataFrame:
    """The same answer by exact search (relax = 1), against which a relaxed search's recall is measured."""
    return nearest(vectors, queries, k, relax=1.0, **options)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that `found` holds."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    row = hit.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("h")).first()
    return row["h"] / row["n"] if row["n"] else 1.0
