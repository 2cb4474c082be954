import zlib
from collections import defaultdict

import edges
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paceline.llm.packing import hilbert, pack, sizes_of_tail

PATH = public_tokenizers.path("word_bpe_49k.json")


def laws(rows, texts, length):
    """Every id of every text lies in one place; sequences are full but for powers of two."""
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    docs = defaultdict(list)
    for text in texts:
        ids = tuple(library.encode(text or "", add_special_tokens=False).ids) + (2,)
        docs[ids].append(text)
    sequences = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        total = sum(r.length for r in pieces)
        assert total == length or total < length and total & (total - 1) == 0
    assert sum(r.length for r in rows) == sum(len(ids) * len(t) for ids, t in docs.items())
    return docs


def whole(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    out = {}
    for doc, pieces in parts.items():
        pieces.sort(key=lambda r: r.start)
        out[doc] = tuple(x for r in pieces for x in r.ids)
        assert {r.doc_tokens for r in pieces} == {len(out[doc])}
    return out


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack(docs, PATH, length=256, tokens_per_task=5_000, with_ids=True).collect()
    ids = laws(rows, texts.values(), 256)
    assert all(texts[doc] in ids[found] for doc, found in whole(rows).items())


def test_edges(spark):
    rows = pack(edges.documents(spark), PATH, length=64, with_ids=True).collect()
    laws(rows, [t for _, t, *_ in edges.ROWS], 64)
    assert pack(edges.none(spark), PATH).collect() == []


def test_tail():
    assert sizes_of_tail(0) == [] and sizes_of_tail(11) == [8, 2, 1]


def test_curve_moves_one_step_at_a_time():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
