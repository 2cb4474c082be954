import hashlib
from collections import defaultdict

import edges
from paceline.llm.exact_dedup import exact_dedup, unique_rows


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    return groups


def test_edges(spark):
    groups = brute(edges.ROWS)
    found = exact_dedup(edges.documents(spark)).collect()
    assert len(found) == len(edges.ROWS)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    seen = defaultdict(list)
    for r in found:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        seen[r.text_sha256].append(r)
    for digest, rows in seen.items():
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, by_digest[digest]))
        assert sum(r.kept for r in rows) == 1
    assert exact_dedup(edges.none(spark)).collect() == []


def test_unique_rows(spark):
    docs = edges.documents(spark)
    found = unique_rows(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    groups = brute(edges.ROWS)
    assert sorted(r.text or "" for r in rows) == sorted(groups)
    assert {r.text or "": r.doc_id for r in rows} == {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert all(r.key == "x" for r in rows)
    assert unique_rows(edges.none(spark)).collect() == []


def test_hot_group(spark):
    rows = [(k, "copy" if k % 3 else f"own {k}", None, None, None) for k in range(900)]
    found = exact_dedup(edges.documents(spark, rows)).collect()
    assert sum(r.kept for r in found) == 301
    assert {r.keep_id for r in found if r.group_size > 1} == {899}
    assert {r.group_size for r in found} == {1, 600}
