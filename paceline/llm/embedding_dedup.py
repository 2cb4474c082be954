"""Near-duplicates among vectors, found by search in a pruned graph.

1. Centres are fitted on a bounded sample. Each vector is stored in the shards of its nearest centres (`overlap` of them),
   so shards overlap; a shard with too many rows is dealt out to parts by a hash, and a search visits every part. Where
   too many search a shard, they are dealt out to blocks, and each block has its own copy of the parts.
2. In each part a flat graph is built: from all rows of the part, nearest first, a row keeps a neighbour unless one
   it kept already is closer to that neighbour by a factor (robust pruning). The adjacency lists that a row
   gets in different shards are united.
3. Each vector searches the parts of its `probes` nearest centres, greedily from the part's medoids. Around what lies in
   range the search expands along lists, both ways, over all rows within twice the angle of the range: as far as a
   row on the way between two that are in range can lie.
4. All links are verified in double precision. A pair met in several parts is counted in one of them: the first, in the
   order of the stored vector's centres, that the searching vector visits.

Pairs are never written out: a part reports how many links each vector has there, and for the components one root per
vector. Vectors equal to the last bit are handled as one with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import ragged, written
from paceline.llm.graph import components


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, k: int, seed: int, steps: int = 6) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=k, replace=False)]
    for _ in range(steps):
        nearest = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        filled = np.sqrt((sums * sums).sum(axis=1)) > 1e-9
        centres[filled] = unit(sums[filled])
    return centres


def robust_pruned(near: np.ndarray, degree: int, alpha: float, candidates: int) -> np.ndarray:
    """Adjacency lists from a matrix of similarities; a row that runs out of neighbours repeats itself.

    Of its `candidates` nearest rows, nearest first, a row keeps one unless a row it kept is closer to it by `alpha`.
    """
    n = len(near)
    m = min(candidates, n - 1)
    out = np.repeat(np.arange(n, dtype=np.int32)[:, None], degree, axis=1)
    if m < 1:
        return out
    distance = 2 - 2 * near
    np.fill_diagonal(distance, np.inf)
    order = np.argpartition(distance, m - 1, axis=1)[:, :m]
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(distance, order, 1), axis=1, kind="stable"), 1)
    for row in range(n):
        left = order[row]
        own = distance[row, left]
        for place in range(degree):
            if not len(left):
                break
            kept = left[0]
            out[row, place] = kept
            stays = alpha * distance[kept, left] > own
            stays[0] = False
            left, own = left[stays], own[stays]
    return out


def medoids(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The rows nearest to the middles of `k` groups: a dense group of any size has one of its own."""
    centres = fit_centres(rows, min(k, len(rows)), seed, steps=3)
    return np.unique(np.argmax(rows @ centres.T, axis=0))


def greedy_search(
    queries: np.ndarray, rows: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """For all queries at once: the `beam` best rows reached from the entries, best first, and their similarities."""
    q, n = len(queries), len(rows)
    beam = min(beam, n)
    ids = np.full((q, beam), -1, dtype=np.int64)
    near = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    value = queries @ rows[entries].T
    best = np.argsort(-value, axis=1, kind="stable")[:, :beam]
    ids[:, : best.shape[1]] = entries[best]
    near[:, : best.shape[1]] = np.take_along_axis(value, best, 1)
    seen[:, entries] = True
    active = np.arange(q)
    while len(active):
        open_near = np.where(done[active] | (ids[active] < 0), -np.inf, near[active])
        best = np.argmax(open_near, axis=1)
        going = open_near[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        neighbours = links[ids[active, best]]
        fresh = ~seen[active[:, None], neighbours]
        seen[active[:, None], neighbours] = True
        value = np.einsum("qrd,qd->qr", rows[neighbours], queries[active])
        value = np.where(fresh, value, -np.inf)
        all_ids = np.concatenate([ids[active], neighbours], axis=1)
        all_near = np.concatenate([near[active], value], axis=1)
        all_done = np.concatenate([done[active], np.zeros_like(fresh)], axis=1)
        # A row that stands twice in one list was fresh twice; the second is dropped.
        order = np.argsort(-all_near, axis=1, kind="stable")[:, : beam + 4]
        top_ids, top_near = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_near, order, 1)
        top_done = np.take_along_axis(all_done, order, 1)
        twice = np.zeros_like(top_done)
        twice[:, 1:] = (top_ids[:, 1:] == top_ids[:, :-1]) & (top_near[:, 1:] == top_near[:, :-1])
        top_near = np.where(twice, -np.inf, top_near)
        order = np.argsort(-top_near, axis=1, kind="stable")[:, :beam]
        near[active] = np.take_along_axis(top_near, order, 1)
        ids[active] = np.where(near[active] > -np.inf, np.take_along_axis(top_ids, order, 1), -1)
        done[active] = np.take_along_axis(top_done, order, 1)
    return ids, near


def both_ways(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of each row's links, in either direction: where they begin, and the ends."""
    n, width = links.shape
    a, b = np.repeat(np.arange(n), width), links.ravel().astype(np.int64)
    pair = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(pair // n, np.arange(n + 1)), pair % n


def expanded(
    query: np.ndarray, rows: np.ndarray, ends: tuple[np.ndarray, np.ndarray], start: np.ndarray, least: float
) -> np.ndarray:
    """All rows reached from `start` over rows whose similarity is at least `least`."""
    seen = np.zeros(len(rows), dtype=bool)
    seen[start] = True
    found, front = [start], start
    at, near = ends
    while len(front):
        around = np.unique(near[ragged(at[front], at[front + 1] - at[front])])
        around = around[~seen[around]]
        seen[around] = True
        front = around[rows[around] @ query >= least]
        found.append(front)
    return np.concatenate(found)


def rooted(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of two nodes, for each pair."""
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)


def valid(vector: str) -> F.Column:
    """A vector that can be compared: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_dedup(
    vectors: DataFrame,
    least: float = 0.95,
    part_rows: int = 1_500,
    ask_rows: int = 8_000,
    overlap: int = 2,
    probes: int = 12,
    n_medoids: int = 32,
    max_centres: int = 4_096,
    sample_rows: int = 20_000,
    degree: int = 24,
    candidates: int = 256,
    alpha: float = 1.2,
    beam: int = 16,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Every row with how many others it is linked to, and the smallest id it can reach: vec_id, n_links, component_id, kept.

    Rows are linked when the cosine of their vectors, in double precision, is at least `least`. Null or zero vectors, and
    such with null or non-finite components, link with nothing; so do vectors of another length than the most frequent
    one's. Rows with null ids count as links of others; their own component is the smallest id reached, or null. Every
    row is indexed; the centres are fitted on `sample_rows` rows with the smallest hashes. No rows give no rows; other
    columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(valid("vector"), F.col("vector")))
    # Equal vectors: one class with a weight.
    classes = rows.where("vector is not null").groupBy("vector").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id")
    )
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    lengths = classes.groupBy(F.size("vector").alias("length")).agg(F.sum("weight").alias("n"))
    usual = lengths.orderBy(F.desc("n"), "length").first()
    if usual is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    same = classes.where(F.size("vector") == usual["length"])
    counted = same.count()

    drawn = same.orderBy(F.xxhash64("vector"), "node").limit(sample_rows).select("vector").toArrow()
    sample = unit(np.array(drawn["vector"].to_pylist(), dtype=np.float64).reshape(-1, usual["length"]))
    k = int(min(max_centres, len(sample), max(1, -(-counted * overlap // part_rows))))
    centres = vectors.sparkSession.sparkContext.broadcast(fit_centres(sample, k, seed).astype(np.float32))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            close = unit(x).astype(np.float32) @ centres.value.T
            top = min(probes, close.shape[1])
            order = np.argpartition(-close, top - 1, axis=1)[:, :top]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(close, order, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))],
                ["node", "vector", "weight", "centres"],
            )

    placed = same.select("node", "vector", "weight").mapInArrow(
        nearest, "node bigint, vector array<double>, weight bigint, centres array<int>"
    )
    placed = written(placed, "placed-vectors")
    # Rows stored in and searching each shard: one row per centre, at most `max_centres`.
    met = placed.select(F.posexplode("centres").alias("rank", "shard")).groupBy("shard").agg(
        F.count_if(F.col("rank") < overlap).alias("stored"), F.count(F.lit(1)).alias("asking")
    )
    sizes = [(r["shard"], -(-r["stored"] // part_rows), -(-r["asking"] // ask_rows)) for r in met.where("stored > 0").collect()]
    deal = F.broadcast(vectors.sparkSession.createDataFrame(sizes, "shard int, parts int, blocks int"))

    # A stored row goes to one part of its shard. A search goes to all parts of the shards it probes, with its block
    # of searches: so neither side of a task grows with the shard.
    def one_of(n: str, salt: int) -> F.Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")

    def all_of(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = placed.select("node", "vector", "weight", "centres", F.explode(F.slice("centres", 1, overlap)).alias("shard"))
    held = held.join(deal, "shard").select("shard", one_of("parts", 0).alias("part"), "blocks", "node", "vector", "weight", "centres")

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        x = unit(np.stack(frame["vector"].to_numpy())).astype(np.float32)
        nodes = frame["node"].to_numpy()
        links = robust_pruned(x @ x.T, degree, alpha, candidates)
        return pd.DataFrame({"node": nodes, "neighbours": [np.unique(nodes[row]) for row in links]})

    lists = held.groupBy("shard", "part").applyInPandas(build, "node bigint, neighbours array<bigint>")
    # At most `overlap` lists of `degree` entries per node.
    graph = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    stored_rows = written(held.join(graph, "node"), "united-graph")
    stored_rows = stored_rows.select("*", all_of("blocks").alias("block"))
    searches = placed.select("node", "vector", "centres", F.explode("centres").alias("shard")).join(deal, "shard")
    searches = searches.select("shard", all_of("parts").alias("part"), one_of("blocks", 1).alias("block"), "node", "vector", "centres")

    def search(key: tuple, rows_of: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        columns = ["node", "links", "root"]
        if not len(rows_of) or not len(asking):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in columns})
        shard = key[0]
        rows_of = rows_of.sort_values("node").reset_index(drop=True)
        exact = unit(np.stack(rows_of["vector"].to_numpy()))
        x = exact.astype(np.float32)
        nodes = rows_of["node"].to_numpy()
        weights = rows_of["weight"].to_numpy()
        near = [np.searchsorted(nodes, row) for row in rows_of["neighbours"]]
        near = [p[(p < len(nodes)) & (nodes[np.minimum(p, len(nodes) - 1)] == row)] for p, row in zip(near, rows_of["neighbours"])]
        width = max(1, max(map(len, near)))
        links = np.repeat(np.arange(len(nodes))[:, None], width, axis=1)
        for row, places in enumerate(near):
            links[row, : len(places)] = places
        ends = both_ways(links)
        entries = medoids(x, n_medoids, seed)
        homes = [row[:overlap] for row in rows_of["centres"]]
        before = np.array([list(h).index(shard) for h in homes])
        first = np.array([h[0] for h in homes])
        asked = asking["node"].to_numpy()
        ids = np.concatenate([nodes, asked])
        ids = np.unique(ids)
        parent = np.arange(len(ids))
        found = np.zeros(len(ids), dtype=np.int64)
        place_of = np.searchsorted(ids, nodes)
        for low in range(0, len(asking), 1024):
            block = asking.iloc[low : low + 1024]
            q = unit(np.stack(block["vector"].to_numpy()))
            best, value = greedy_search(q.astype(np.float32), x, links, entries, beam)
            wide = max(2 * least * least - 1, least - 0.2)
            for k in np.flatnonzero(value[:, 0] >= wide).tolist():
                start = best[k][value[k] >= wide]
                reach = expanded(q[k].astype(np.float32), x, ends, start, wide)
                # Double precision decides.
                reach = reach[exact[reach] @ q[k] >= least]
                reach = reach[nodes[reach] != block["node"].iat[k]]
                if not len(reach):
                    continue
                own = int(np.searchsorted(ids, block["node"].iat[k]))
                rooted(parent, place_of[reach], np.full(len(reach), own))
                # Counted here unless an earlier home of that row is visited too.
                visited = np.isin(first[reach], block["centres"].iat[k])
                found[own] += weights[reach[(before[reach] == 0) | ~visited]].sum()
        for k in range(len(ids)):
            while parent[parent[k]] != parent[k]:
                parent[k] = parent[parent[k]]
        told = (found > 0) | (parent != np.arange(len(ids)))
        told[np.unique(parent[told])] = True
        return pd.DataFrame({"node": ids[told], "links": found[told], "root": ids[parent[told]]})

    told = (
        stored_rows.groupBy("shard", "part", "block")
        .cogroup(searches.groupBy("shard", "part", "block"))
        .applyInPandas(search, "node bigint, links bigint, root bigint")
    )
    told = written(told, "links-of-parts")
    counts = told.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(told, "node", "root")
    of_class = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "vector", "weight", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")
    )
    of_class = written(of_class, "class-links")
    least_ids = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    links = F.col("links") + F.col("weight") - 1
    of_vector = written(of_class.join(least_ids, "root").select("vector", links.alias("n_links"), "component_id"), "vector-links")
    joined = rows.join(of_vector, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audited_recall(vectors: DataFrame, result: DataFrame, least: float = 0.95, every: int = 50, id_col: str = "vec_id",
                   vector_col: str = "embedding") -> float:
    """The share of true links that `result` counts, for the rows whose id is divisible by `every`, against all rows.

    Each task holds its block of rows and compares it with a block of at most 1,000 queries; only counts are
    written. The queries are a fixed share of the rows, so this is for audits, not for every run.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = written(rows.where(valid("vector")), "audit-rows")
    asked = rows.where(F.col("vec_id") % every == 0).orderBy("vec_id").toArrow()
    true = 0
    for low in range(0, len(asked), 1000):
        block = asked.slice(low, 1000)
        sent = spark.sparkContext.broadcast(unit(np.array(block["vector"].to_pylist(), dtype=np.float64)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([int((x @ sent.value.T >= least).sum())])], ["n"])

        true += rows.mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] - block.num_rows
    told = result.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0]
    return 1.0 if not true else told / true
