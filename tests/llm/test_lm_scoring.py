import math
from collections import Counter

import edges
import numpy as np
import pytest

from paceline.llm import lm_scoring
from paceline.llm.lm_scoring import CLASSES, MIX, cells, cross_entropy_difference

TEXTS = ["the cat sat on the mat", "The cat ran", "buy now buy now cheap", "cheap cheap offers now", "", None, "a catalogue of mats", "the mat"]


def brute(texts, target, size, bits):
    """The same models with dictionaries."""
    docs = [(t or "").lower().split() for t in texts]
    order = Counter(w for d in docs for w in d)
    words = sorted(order, key=lambda w: (-order[w], w))[:size]
    place = {w: k for k, w in enumerate(words)}
    number = lambda w: place.get(w, len(words) + min(len(w.encode()), CLASSES) - 1)
    n = len(words) + CLASSES
    cell = lambda a, b: int(cells(np.array([a]), np.array([b]), bits)[0])
    rows = [[(a, b, cell(a, b)) for a, b in zip([n] + ids, ids)] for ids in ([number(w) for w in d] for d in docs)]
    sides = []
    for side in (True, False):
        own = [x for r, t in zip(rows, target) if t == side for x in r]
        sides.append((Counter(b for _, b, _ in own), Counter(a for a, _, _ in own), Counter(c for *_, c in own), len(own)))
    scale = sides[0][3] / sides[1][3]

    def loss(side, a, b, c, factor):
        word, first, pair, total = side
        near = min(pair[c] / first[a], 1.0) if first[a] else min(pair[c] * factor / 1e-9, 1.0)
        return -math.log(MIX[0] * near + MIX[1] * word[b] / total + MIX[2] / n)

    return [
        [sum(loss(s, *x, f) for x in r) / len(r) if r else 0.0 for s, f in zip(sides, (1.0, scale))] for r in rows
    ]


def test_like_dictionaries(spark):
    docs = edges.documents(spark, [(k, t, None, None, None) for k, t in enumerate(TEXTS)])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (7, None), (99, 1), (None, 1)], "doc_id long, quality int")
    rows = sorted(cross_entropy_difference(docs, labels, vocabulary_size=6, bits=12).collect())
    want = brute(TEXTS, [k in (0, 1) for k in range(len(TEXTS))], 6, 12)
    for r, (target, background) in zip(rows, want):
        assert r.target_loss == pytest.approx(target, rel=1e-4) and r.background_loss == pytest.approx(background, rel=1e-4)
        assert r.score == pytest.approx(r.target_loss - r.background_loss)
        assert r.n_words == len((TEXTS[r.doc_id] or "").split())
    assert rows[0].score < 0 < rows[2].score


def test_edges(spark):
    docs = edges.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = cross_entropy_difference(docs, some, vocabulary_size=20, bits=10).collect()
        assert len(rows) == len(edges.ROWS) and all(math.isfinite(r.score) for r in rows)
    assert cross_entropy_difference(edges.none(spark), labels).collect() == []


def exact(texts, target):
    """Whole models with dictionaries: every word and every pair has its own count."""
    docs = [(t or "").lower().split() for t in texts]
    n = len({w for d in docs for w in d})
    rows = [list(zip([None] + d, d)) for d in docs]
    sides = []
    for side in (True, False):
        own = [x for r, t in zip(rows, target) if t == side for x in r]
        sides.append((Counter(b for _, b in own), Counter(a for a, _ in own), Counter(own), len(own)))
    loss = lambda s, a, b: -math.log(MIX[0] * s[2][a, b] / max(s[1][a], 1) + MIX[1] * s[0][b] / max(s[3], 1) + MIX[2] / n)
    return [[sum(loss(s, *x) for x in r) / max(len(r), 1) for s in sides] for r in rows]


def test_every_word_and_pair_counts(spark, monkeypatch):
    # More words than 50,000; three blocks or more, and many ranges of keys, over which counts meet.
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 40_000)
    draw = np.random.default_rng(3)
    texts = [*TEXTS, *(" ".join(f"w{int(x)}" for x in draw.zipf(1.2, 400) % 10**9) for _ in range(500))]
    texts += [" ".join(f"r{k}x{j}" for j in range(400)) for k in range(200)]
    docs = edges.documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]).repartition(3)
    labels = spark.createDataFrame([(k, 1) for k in range(0, len(texts), 3)], "doc_id long, quality int")
    rows = sorted(cross_entropy_difference(docs, labels).collect())
    want = exact(texts, [k % 3 == 0 for k in range(len(texts))])
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, (target, background) in zip(rows, want):
        assert r.n_words == len((texts[r.doc_id] or "").split())
        assert r.target_loss == pytest.approx(target, rel=1e-9) and r.background_loss == pytest.approx(background, rel=1e-9)


def test_edges_of_whole_models(spark):
    docs = edges.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = cross_entropy_difference(docs, some).collect()
        assert len(rows) == len(edges.ROWS) and all(math.isfinite(r.score) for r in rows)
