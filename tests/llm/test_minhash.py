import random
import re
from collections import defaultdict

import edges
import pyarrow as pa
import pytest

from paceline.llm import minhash
from paceline.llm.common import texts_of, written
from paceline.llm.graph import components
from paceline.llm.minhash import near_dedup, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def brute_sets(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """Component of each distinct text, by all pairs."""
    texts = sorted({r[1] or "" for r in rows})
    sets = {t: brute_sets(t, size) for t in texts}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            common = len(sets[a] & sets[b])
            if common and common * 100 >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for r in rows:
        ids[root(r[1] or "")].append(r[0])
    least = {t: min((i for i in ids[root(t)] if i is not None), default=None) for t in texts}
    return sets, least


def agrees(spark, rows, size=4, percent=80, **options):
    sets, least = brute(rows, size, percent)
    found = near_dedup(edges.documents(spark, rows), size, percent, **options).collect()
    assert len(found) == len(rows)
    want = sorted(str((i, len(sets[t or ""]), least[t or ""] if sets[t or ""] else i)) for i, t, *_ in rows)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    """A large group of near copies, chains of copies of copies, and texts that share one long passage."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**5)}"
    base = [word() for _ in range(120)]
    texts = [edited(rng, base, rng.randrange(5)) for _ in range(60)]
    chain = [word() for _ in range(80)]
    for k in range(15):
        chain = edited(rng, chain, 1).split()
        texts.append(" ".join(chain))
    passage = [word() for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(2, 40))]) for _ in range(50)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += texts[:30]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, t, None, None, None) for i, t in zip(order, texts)]


@pytest.mark.parametrize("rounds, rare", [(0, 4), (2, 16), (0, 0), (1, 1000)])
def test_family(spark, family, rounds, rare):
    agrees(spark, family, rounds=rounds, rare=rare)


def test_no_pairs_in_a_group_of_near_copies(spark, monkeypatch):
    """Copies just too unlike the most faithful ones are not paired with all others of their group."""
    rng = random.Random(11)
    base = [f"v{k}" for k in range(150)]
    spots = list(range(2, 146, 6))

    def copy(n):
        words = list(base)
        for at in rng.sample(spots, n):
            words[at] = f"w{rng.randrange(10**6)}"
        return words

    texts = [copy(1) for _ in range(150)]
    # Like the base itself, which is not there, but one change too many for its copies.
    strays = [copy(4) for _ in range(60)]
    # Strays of a kind: linked to each other through what they share.
    strays += [[*s[:70], f"x{k}", *s[71:]] for k, s in enumerate(strays[:8])]
    rows = [(k, " ".join(t), None, None, None) for k, t in enumerate(texts + strays)]
    sizes = {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    agrees(spark, rows, rounds=1, rare=4)
    assert sizes["open-pairs"] < 10 * len(rows)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text, None, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    agrees(spark, rows, size=5)


def test_edges(spark):
    agrees(spark, edges.ROWS)
    assert near_dedup(edges.none(spark)).collect() == []


def test_sets():
    texts = ["A b\tc  d\x0be", "", None, "x", "a B c d e", "a b　c d e\xa0", "q " * 5000, "É é ß", "Aa", "a a"]
    for size in (1, 4):
        sets = shingle_sets(texts_of(pa.array(texts)), size)
        assert list(map(len, sets)) == [len(brute_sets(t, size)) for t in texts]
        assert (sets[0] == sets[4]).all() and len(set(map(bytes, (s.tobytes() for s in sets)))) == len(texts) - 2


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 440)] + [(None, 3)]
    parent = list(range(500))
    for a, b in pairs:
        if a is None:
            continue
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in pairs:
        for k in (a, b):
            top = k
            while top is not None and parent[top] != top:
                top = parent[top]
            if a is not None and a != b:
                assert found[k] == top
