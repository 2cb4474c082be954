import edges
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, models

from paceline.llm.common import texts_of
from paceline.llm.token_counts import SPACE, Counter, counted, read_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        data = file.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    library = Tokenizer(models.Unigram([(p.piece, p.score) for p in model.pieces], unk_id=0, byte_fallback=True))
    return Counter(*read_pieces(data)), library


def by_library(library, text):
    return len(library.encode((" " + text).replace(" ", SPACE)).ids) if text else 0


PIECES = st.sampled_from(["a", "th", "ing", " ", "  ", "\n", "1", "é", "中文", "😀", "!!", "aaaa", "\x00", SPACE, " the"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(PIECES, max_size=40).map("".join)), max_size=8))
def test_like_the_library(both, texts):
    # Names of special pieces are ordinary text here.
    texts = [t.replace("<", "") for t in texts]
    counts, _ = counted(both[0], texts_of(pa.array(texts, pa.string())))
    assert counts.tolist() == [by_library(both[1], t) for t in texts]


def brute(text, pieces, unknown):
    """Score, then the earliest beginning of the last piece, over all cuts."""
    best = [(0.0, 0, False)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            value = pieces.get(text[start:end], unknown if end == start + 1 else None)
            if value is None or best[start] is None:
                continue
            odd = text[start:end] not in pieces
            total = best[start][0] + value
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[start][1] + (not (odd and best[start][2])), odd)
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(-4, -1).map(float), min_size=1), st.lists(st.text("abcd", max_size=12), max_size=9))
def test_ties_without_bytes(pieces, texts):
    counter = Counter(list(pieces.items()), bytes_known=False)
    counts, scores = counter.count(texts)
    for text, n, score in zip(texts, counts.tolist(), scores.tolist()):
        want = brute(text, pieces, min(pieces.values()) - 10)
        assert (n, score) == (want[1], want[0])


def test_edges(spark, both):
    rows = token_counts(edges.documents(spark), PATH).collect()
    want = sorted((str(i), by_library(both[1], t or "")) for i, t, *_ in edges.ROWS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    assert token_counts(edges.none(spark), PATH).collect() == []
