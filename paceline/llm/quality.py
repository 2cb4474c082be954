"""Quality from document statistics, by histogram gradient-boosted trees.

Statistics are computed for every whole text in the tasks. Trees are grown on a bounded sample of labelled rows: values
are cut into bins once, and each split is chosen from sums of gradients per bin. All trees lie in flat arrays; a batch of
documents walks down all trees together, one level at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import labelled_sample

STATISTICS = (
    "words", "mean_word", "longest_word", "upper", "digits", "marks", "signs", "high_bytes", "lines", "mean_line",
    "repeated_lines", "distinct_words", "top_word", "distinct_pairs", "capital_words", "signed_words", "stopped_lines",
)

_KIND = np.zeros(256, dtype=np.int64)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_KIND[128:] = 5


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; null counts as empty, and an empty text has zeros."""
    data = (text or "").encode()
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6) / len(data)
    lines = [line for line in text.split("\n") if line.strip()]
    times = Counter(words)
    n = len(words)
    return [
        math.log1p(n),
        sum(map(len, words)) / n,
        math.log1p(max(map(len, words))),
        *kinds[1:],
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        len(times) / n,
        max(times.values()) / n,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        sum(map(str.isupper, words)) / n,
        1 - sum(map(str.isalnum, words)) / n,
        sum(line.rstrip().endswith((".", "!", "?")) for line in lines) / len(lines),
    ]


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees: a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def grow(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    least_rows: int = 8,
    penalty: float = 1.0,
) -> Trees:
    """Boost trees of a fixed depth on the logistic loss. Without rows, or with one label, only the base is left."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = math.log(share / (1 - share))
    parts: list[list[tuple[int, float, int, int, float]]] = []
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            if np.abs(grad).max() < 1e-4:
                break
            nodes, leaf_of = _tree(binned, cuts, grad, hess, depth, least_rows, penalty, bins)
            nodes = [(f, c, a, b, v * rate) for f, c, a, b, v in nodes]
            raw += np.array([node[4] for node in nodes])[leaf_of]
            parts.append(nodes)
    roots, flat = [], []
    for nodes in parts:
        start = len(flat)
        roots.append(start)
        flat += [(f, c, a + start, b + start, v) for f, c, a, b, v in nodes]
    feature, cut, left, right, value = (np.array(column) for column in (zip(*flat) if flat else [()] * 5))
    return Trees(
        np.array(roots, dtype=np.int64), feature.astype(np.int64), cut.astype(float), left.astype(np.int64),
        right.astype(np.int64), value.astype(float), base, depth,
    )


def _tree(binned, cuts, grad, hess, depth, least_rows, penalty, bins):
    """One tree as nodes (feature, cut, left, right, value), and the leaf of each row."""
    nodes = [(0, math.inf, 0, 0, grad.sum() / (hess.sum() + penalty))]
    leaf = np.zeros(len(grad), dtype=np.int64)
    level = [0]
    for _ in range(depth):
        following = []
        for node in level:
            rows = np.flatnonzero(leaf == node)
            g, h = grad[rows], hess[rows]
            whole, weight = g.sum(), h.sum()
            best = (1e-6, -1, -1)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, k]
                n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, weights=g, minlength=len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, weights=h, minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + penalty) + (whole - gl) ** 2 / (weight - hl + penalty) - whole**2 / (weight + penalty)
                gain[(n < least_rows) | (len(rows) - n < least_rows)] = -1
                top = int(np.argmax(gain))
                if gain[top] > best[0]:
                    best = (float(gain[top]), k, top)
            gain, k, top = best
            if k < 0:
                continue
            low = binned[rows, k] <= top
            children = []
            for side in (low, ~low):
                children.append(len(nodes))
                leaf[rows[side]] = len(nodes)
                value = g[side].sum() / (h[side].sum() + penalty)
                nodes.append((0, math.inf, len(nodes), len(nodes), value))
            nodes[node] = (k, float(cuts[k][top]), children[0], children[1], nodes[node][4])
            following += children
        level = following
    return nodes, leaf


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    **growth,
) -> Trees:
    """Trees from at most `max_rows` labelled documents: those with the smallest hashed ids.

    Their statistics, one short row each, are all that comes to the driver. Rows with a null label or text are left out.
    """
    sample = labelled_sample(docs, labels, label, max_rows, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([statistics(t) for t in batch["text"]], columns=list(STATISTICS), dtype=float)
            yield rows.assign(label=batch["label"].to_numpy(), doc_id=batch["doc_id"].to_numpy())

    kind = sample.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{name} double" for name in STATISTICS) + f", label int, doc_id {kind}"
    rows = sample.select("doc_id", "text", "label").mapInPandas(run, fields).toPandas()
    # In a fixed order, so that the sums of the training come out alike each time.
    rows = rows.sort_values(["doc_id", *STATISTICS])
    return grow(rows[list(STATISTICS)].to_numpy(float), (rows["label"] != 0).to_numpy(float), **growth)


def scored(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the score of each whole text in `score_col`, which replaces a column of that name.

    The score lies in 0 to 1; a null or empty text gets that of zero statistics. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            if not len(series):
                yield pd.Series([], dtype=float)
                continue
            yield pd.Series(sent.value.probability(np.array([statistics(t) for t in series])))

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))
