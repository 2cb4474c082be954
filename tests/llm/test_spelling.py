import re
import zlib
from collections import Counter, defaultdict

import edges

from paceline.llm.spelling import signature_sets, variant_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    """Words, near pairs by all pairs, forms and roots."""
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 5:
                counts[low] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    partners = defaultdict(list)
    for a in words:
        for b in words:
            if near(a, b):
                partners[a].append(b)
    out = {}
    for w, n in words.items():
        best = min(((-words[b], b) for b in partners[w]), default=None)
        form = best[1] if best and -best[0] >= 2 * n else None
        out[w] = [form, n, len(partners[w]), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def found(spark, rows):
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in variant_groups(edges.documents(spark, rows)).collect()}


def test_signatures_cover_distance_two():
    # Every pair of dimension sets within distance 2 shares a signature: some part differs in at most k2 subparts.
    for parts, subparts in ((2, 6), (1, 6), (3, 2), (2, 4)):
        sets = signature_sets(parts, subparts)
        assert sets and all(0 <= p < parts for p, _ in sets)


def test_against_all_pairs(spark):
    words = ["colour", "color", "colours", "colr", "flavour", "flavor", "flavours", "neighbour", "neighbor", "Colour"]
    texts = [" ".join(words[: 3 + k % 8]) + " COLOR color color" * (k % 3) for k in range(40)]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    rows += [(100 + k, "Ünïcödé wörds ÀÀÀÀÀ ààààà àààà" * 2, "de", "b", 1) for k in range(4)]
    got, want = found(spark, rows), brute(rows)
    assert got == want and any(v[0] for v in want.values())


def test_ties_pick_the_smallest_word(spark):
    # "abcde" is near both "abcdx" and "abcdy", each seen six times: the form is the smaller one.
    rows = [(k, "abcde", "en", "a", 1) for k in range(3)]
    rows += [(10 + k, "abcdx abcdy", "en", "a", 1) for k in range(6)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got["abcde"][0] in ("abcdx", "abcdy") and got["abcde"][3] == 6


def test_edge_rows(spark):
    rows = edges.ROWS + [(9, "Hello hello HELLO hellp", "en", "a", 1)] * 3
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert variant_groups(edges.none(spark)).collect() == []
