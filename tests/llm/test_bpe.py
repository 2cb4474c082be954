import hashlib

import edges
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paceline.llm.bpe import Encoder, decoded, encoded, read_ranks
from paceline.llm.common import texts_of

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        ranks = read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Encoder(ranks, public_tokenizers.PATTERN), library


PIECES = st.sampled_from(["a", "th", "ing", " ", "  ", "\n", "\t", "'s", "1", "é", "中文", "😀", "!!", "aaaa", "　", "́", "<|endoftext|>", "\x00"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(PIECES, max_size=40).map("".join)), max_size=8))
def test_like_the_library(both, texts):
    encoder, library = both
    ids, at = encoder.encode(texts_of(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == library.encode_ordinary(text)
        assert encoder.decode(own) == text.encode()


def test_repeats_and_long_words(both):
    encoder, library = both
    texts = ["a" * 4000, "ab" * 3000, " " * 500, "\n" * 77, "the then than " * 500]
    ids, at = encoder.encode(texts_of(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(text)


def test_edges(spark, both):
    docs = edges.documents(spark)
    found = encoded(docs, PATH, public_tokenizers.PATTERN)
    want = sorted((str(i), both[1].encode_ordinary(t or "")) for i, t, *_ in edges.ROWS)
    rows = found.collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want and all(r.n_tokens == len(r.ids) for r in rows)
    back = decoded(found, PATH).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(i), (t or "").encode()) for i, t, *_ in edges.ROWS)
    digests = encoded(docs, PATH, public_tokenizers.PATTERN, digests=True).collect()
    want = {hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() for _, ids in want}
    assert {r.ids_sha256 for r in digests} == want
    assert {r.decoded_sha256 for r in digests} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in edges.ROWS}
    assert encoded(edges.none(spark), PATH, public_tokenizers.PATTERN).collect() == []
