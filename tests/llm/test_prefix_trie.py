import random

import trie_brute

from paceline.llm.prefix_trie import ROOT, prefix_trie

FIELDS = "conv_id long, turn long, role string, text string, node string, depth string, digest string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], FIELDS)
    return sorted((tuple(r) for r in prefix_trie(df).collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(3)
    lines = ["hi", "hello there", "how are you?", "fine", "", "ça va ✓", "x" * 5_000]
    rows = []
    for c in list(range(0, 12)) + list(range(100, 109)) + [250, 251, 377]:
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(lines + [None])))
    assert found(spark, rows) == trie_brute.trie(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [
        (1, None, "user", "a"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, "user", "b"),
        (2, 5, "user", "a"), (3, 1, "user", "a"), (None, 1, "user", "lost"), (101, 0, "user", "b"),
        (200, 0, "", ""), (4, 0, "user", "a"), (4, 1, "assistant", "c" * 20_000),
    ]
    assert found(spark, rows) == trie_brute.trie(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # crc32("1") % 6 = 1: conversation 1 takes one turn of conversation 0, which is absent, and none of its own.
    got = found(spark, [(1, 0, "user", "only")])
    assert got == trie_brute.trie([(1, 0, "user", "only")])
    root = [r for r in got if r[1] == 0][0]
    assert root[2] is None and root[3] == 1


def test_empty_table(spark):
    assert found(spark, []) == []
    assert len(ROOT) == 64
