"""Windows of many requests at once: a group's rows go to one task, which answers all requests of the group from them.

A window is a range of places in the group's sorted order. With the group at hand as sorted arrays its size, ends,
quantiles, sum and bins are look-ups, so nothing is shuffled but the rows themselves, once, and no request is paired with the
rows of its window. A caller keeps groups that a task cannot hold away from here (`PACKED_ROWS`).

Rows carry `_asked`, true where the row is a request too. Results have one row per request.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.positions import EXACT

#: A group with more rows than this is not given to a single task. A row takes up to some 300 bytes of its Python worker.
PACKED_ROWS = 4_000_000
#: Requests whose bins are worked out together.
_BLOCK = 65_536


class _Ordered:
    """A group's values in order, its requests in the order of their values, and the places of their windows."""

    def __init__(self, table: pa.Table, half: float):
        values = table.column("_at").to_numpy()
        self.order = np.argsort(values, kind="stable")
        self.values = values[self.order]
        asked = table.column("_asked").to_numpy().astype(bool)
        self.rows = self.order[asked[self.order]]
        own = values[self.rows]
        self.first = np.searchsorted(self.values, own - half, side="left")
        self.end = np.searchsorted(self.values, own + half, side="right")

    def keep(self, chosen: np.ndarray) -> None:
        """Only these of the requests."""
        self.rows, self.first, self.end = self.rows[chosen], self.first[chosen], self.end[chosen]

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.values[np.clip(places, 0, len(self.values) - 1)]


def _asked_column(df: DataFrame) -> DataFrame:
    return df.withColumn("_asked", F.coalesce("_asked", F.lit(False)))


def window_numbers(rows: DataFrame, keys: list[str], value: str, half: float, shares: dict[str, float]) -> DataFrame:
    """Per request the `count`, `min`, `max` and exact sum (`_sum`, EXACT) of the values of its group that lie within `half`
    of its own, ends included, and for each quantile the values below and above its position (`<name>_lo`, `<name>_hi`)."""
    id_ = rows.schema["result_id"].dataType.simpleString()
    names = [f"{name}_{end}" for name in shares for end in ("lo", "hi")]
    # The decimals are made after the shuffle, which they would widen.
    placed = _asked_column(rows.select("result_id", *keys, F.col(value).cast("double").alias("_at"), "_asked"))
    placed = placed.repartition(*keys).withColumn("_exact", F.col("_at").cast(EXACT))

    def answer(table: pa.Table) -> pa.Table:
        group = _Ordered(table, half)
        n = group.end - group.first
        columns = [table.column("result_id").take(pa.array(group.rows)), pa.array(n), pa.array(group.at(group.first)), pa.array(group.at(group.end - 1))]
        columns.append(_range_sums(table.column("_exact"), group))
        for share in shares.values():
            position = (n - 1) * share
            for end in (np.floor(position), np.ceil(position)):
                columns.append(pa.array(group.at(group.first + end.astype(np.int64))))
        return pa.table(columns, names=["result_id", "count", "min", "max", "_sum", *names])

    fields = ["count bigint", "min double", "max double", f"_sum {EXACT}", *[f"{name} double" for name in names]]
    return placed.groupBy(*keys).applyInArrow(answer, f"result_id {id_}, {', '.join(fields)}")


def _range_sums(exact: pa.ChunkedArray, group: _Ordered) -> pa.Array:
    """The exact sum of each window: running sums of the decimals' 32-bit limbs, carried at the end."""
    exact = exact.combine_chunks()
    limbs = np.frombuffer(exact.buffers()[1], dtype="<u4", count=4 * len(exact), offset=16 * exact.offset).reshape(-1, 4)
    found = np.empty((len(group.rows), 4), dtype="<u4")
    carry = np.zeros(len(group.rows), dtype=np.int64)
    for k in range(4):
        limb = limbs[group.order, k]
        sums = np.concatenate(([0], np.cumsum(limb.view("<i4") if k == 3 else limb, dtype=np.int64)))
        carry += sums[group.end] - sums[group.first]
        found[:, k] = carry & 0xFFFFFFFF
        carry >>= 32
    return pa.Array.from_buffers(exact.type, len(found), [None, pa.py_buffer(found.tobytes())])


def window_histograms(rows: DataFrame, keys: list[str], value: str, half: float, bins: int) -> DataFrame:
    """Per request the histogram of the values of its group within `half` of its own: `_low`, `_width` and `_counts`, one
    number per bin. Edges are equal steps between the window's ends; a value lies in the bin whose start it reaches and
    whose end it is under, the largest in the last one. Requests of a group with equal id and value have one histogram."""
    id_ = rows.schema["result_id"].dataType.simpleString()
    placed = _asked_column(rows.select("result_id", *keys, F.col(value).cast("double").alias("_at"), "_asked"))

    def answer(table: pa.Table) -> pa.Table:
        ids = table.column("result_id").combine_chunks()
        group = _Ordered(table, half)
        group.keep(_first_of(ids.take(pa.array(group.rows)), table.column("_at").to_numpy()[group.rows]))
        names = ["result_id", "_low", "_width", "_counts"]
        blocks = []
        for start in range(0, max(len(group.rows), 1), _BLOCK):
            part = slice(start, start + _BLOCK)
            first, end = group.first[part, None], group.end[part, None]
            low, high = group.at(first[:, 0]), group.at(end[:, 0] - 1)
            wider = (high > low) | (np.isnan(high) & ~np.isnan(low))
            width = np.where(wider, high - low, 1.0) / bins
            edges = low[:, None] + width[:, None] * np.arange(1, bins)
            under = np.clip(np.searchsorted(group.values, edges, side="left"), first, end)
            counts = np.diff(np.hstack((first, under, end)), axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(low) + 1, dtype=np.int32) * bins, pa.array(counts.ravel()))
            columns = [ids.take(pa.array(group.rows[part])), pa.array(low), pa.array(width), lists]
            blocks.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(blocks)

    return placed.groupBy(*keys).applyInArrow(answer, f"result_id {id_}, _low double, _width double, _counts array<int>")


def window_faster(rows: DataFrame, keys: list[str], window: str, value: str, half: float) -> DataFrame:
    """Per request the rows of its group whose `window` lies within `half` of its own (`_n`), and how many of these have a
    smaller `value` (`_below`). A row without either is no member, and as a request gets nulls.

    Returns `result_id`, the last of `keys`, `value`, `_below` and `_n`. A request that comes k times (id and value) gets k
    rows for each, and every count k times k-fold, as a join of k requests with k answers of k rows each has them.
    """
    name = keys[-1]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("result_id", name)}
    # Rows that are no members are dealt out: they need no company.
    apart = F.when(F.col(window).isNull() | F.col(value).isNull(), F.pmod(F.xxhash64("result_id"), F.lit(1024)) + 1)
    slim = _asked_column(
        rows.select(
            "result_id", *keys, F.col(window).cast("double").alias("_at"), F.col(value).cast("double").alias("_value"), "_asked",
            F.coalesce(apart, F.lit(0)).cast("int").alias("_apart"),
        )
    )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("result_id").combine_chunks()
        if key[-1].as_py():
            chosen = np.flatnonzero(table.column("_asked").to_numpy())
            below = n = pa.nulls(len(chosen), pa.int64())
        else:
            group = _Ordered(table, half)
            values = table.column("_value").to_numpy()
            # A value's place is how many are under it, so equal values share one.
            places = np.searchsorted(np.sort(values), values, side="left")
            found = _counted_under(places[group.order], group.first, group.end, places[group.rows])
            times = _times(ids.take(pa.array(group.rows)), values[group.rows])
            again = np.repeat(np.arange(len(group.rows)), times * times)
            chosen = group.rows[again]
            below, n = pa.array((found * times * times)[again]), pa.array((group.end - group.first)[again])
        taken = pa.array(chosen)
        columns = [ids.take(taken), table.column(name).take(taken), table.column("_value").take(taken), below, n]
        return pa.table(columns, names=["result_id", name, value, "_below", "_n"])

    fields = f"result_id {kinds['result_id']}, {name} {kinds[name]}, {value} double, _below bigint, _n bigint"
    return slim.groupBy(*keys, "_apart").applyInArrow(answer, fields)


def _counted_under(places: np.ndarray, first: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each range [first, end) of `places` how many lie under its `limit`, all ranges at once.

    A wavelet matrix: from the highest bit down the places are split by the bit, in order, and each range follows the half
    that its limit is in; where that is the upper one, the lower half's part of the range is counted.
    """
    found = np.zeros(len(first), dtype=np.int64)
    for bit in reversed(range(len(places).bit_length())):
        upper = (places >> bit & 1).astype(bool)
        lower = np.concatenate(([0], np.cumsum(~upper)))
        up = (limit >> bit & 1).astype(bool)
        from_, to = lower[first], lower[end]
        found += np.where(up, to - from_, 0)
        first = np.where(up, lower[-1] + first - from_, from_)
        end = np.where(up, lower[-1] + end - to, to)
        places = np.concatenate((places[~upper], places[upper]))
    return found


def _pairs(ids: pa.Array, values: np.ndarray) -> np.ndarray | None:
    """One number for each pair of id and value; None if no id comes twice."""
    codes = ids.dictionary_encode()
    if len(codes.dictionary) == len(ids):
        return None
    _, same = np.unique(values, return_inverse=True)
    return codes.indices.to_numpy().astype(np.int64) * (len(values) + 1) + same


def _times(ids: pa.Array, values: np.ndarray) -> np.ndarray:
    """How often each pair of id and value occurs."""
    pairs = _pairs(ids, values)
    if pairs is None:
        return np.ones(len(ids), dtype=np.int64)
    _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    return counts[inverse]


def _first_of(ids: pa.Array, values: np.ndarray) -> np.ndarray:
    """The first place of each pair of id and value, in order."""
    pairs = _pairs(ids, values)
    return np.arange(len(ids)) if pairs is None else np.sort(np.unique(pairs, return_index=True)[1])
