"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton over the bytes of the vocabulary runs along all distinct parts of a batch of texts at once, one
byte per step. Wherever pieces end, dynamic programming keeps the best score up to that byte and the number of pieces on
the way there; no path is stored. Ties are settled as the tokenizers library does it: of equal scores the one whose last
piece begins first wins. A character without a piece of its own costs the least score less ten, and counts as its bytes
where the vocabulary has byte pieces, else stretches of such characters count once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from paceline.llm.common import chunks, spaced_parts, texts_of

#: What a piece begins with where a text has a space.
SPACE = "▁"
#: Below the least score, for an unknown character.
UNKNOWN = 10.0


def read_pieces(data: bytes) -> tuple[list[tuple[str, float]], bool]:
    """The ordinary pieces of a sentencepiece model with their scores, and whether it has byte pieces."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    kinds = model.SentencePiece
    ordinary = (kinds.NORMAL, kinds.USER_DEFINED)
    pieces = [(p.piece, p.score) for p in model.pieces if p.type in ordinary]
    return pieces, any(p.type == kinds.BYTE for p in model.pieces)


class Counter:
    """The automaton in arrays, and the dynamic programming over many parts at once."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool, least: float | None = None):
        self.bytes_known = bytes_known
        scores = {piece.encode(): score for piece, score in pieces}
        self.unknown = (min(scores.values()) if least is None else least) - UNKNOWN
        used = sorted({b for piece in scores for b in piece})
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        size, score = [0], [0.0]
        for piece, value in scores.items():
            at = 0
            for b in piece:
                at = children[at].setdefault(int(self.symbol[b]), len(children))
                if at == len(children):
                    children.append({})
                    size.append(0)
                    score.append(0.0)
            size[at], score[at] = len(piece), value
        self.move = np.zeros((len(children), width), dtype=np.int32)
        fail = np.zeros(len(children), dtype=np.int32)
        # For a state: the longest piece that ends there, and the state of the next shorter one.
        longest = np.zeros(len(children), dtype=np.int32)
        self.shorter = np.zeros(len(children), dtype=np.int32)
        queue = deque()
        for symbol, child in children[0].items():
            self.move[0, symbol] = child
            queue.append(child)
        if queue:
            for child in children[0].values():
                longest[child] = child if size[child] else 0
        while queue:
            at = queue.popleft()
            self.move[at] = self.move[fail[at]]
            for symbol, child in children[at].items():
                fail[child] = self.move[fail[at], symbol]
                self.move[at, symbol] = child
                self.shorter[child] = longest[fail[child]]
                longest[child] = child if size[child] else self.shorter[child]
                queue.append(child)
        self.longest = longest
        self.size = np.array(size, dtype=np.int32)
        self.score = np.array(score)
        # A character with a piece of its own is never unknown.
        self.single = {piece.decode() for piece in scores if len(piece.decode()) == 1}

    def count(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces and the best score of each part."""
        counts, best = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts))
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        low = 0
        while low < len(order):
            # Parts of about one length together; few where they are long.
            longest = len(parts[order[min(low + 20_000, len(order)) - 1]].encode()) if low < len(order) else 0
            high = min(len(order), low + max(1, min(20_000, 4_000_000 // max(1, longest))))
            group = order[low:high]
            counts[group], best[group] = self._group([parts[k] for k in group])
            low = high
        return counts, best

    def _group(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode() for p in parts]
        n = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        width = int(n.max(initial=0))
        text = np.zeros((len(data), width), dtype=np.uint8)
        text[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(data), dtype=np.uint8)
        # Where an unknown character ends: its length in bytes.
        odd = np.zeros((len(data), width + 1), dtype=np.int8)
        for k, part in enumerate(parts):
            if not self.single.issuperset(part):
                at = 0
                for c in part:
                    at += len(c.encode())
                    if c not in self.single:
                        odd[k, at] = len(c.encode())
        best = np.full((len(data), width + 1), -np.inf)
        pieces = np.zeros((len(data), width + 1), dtype=np.int32)
        after_unknown = np.zeros((len(data), width + 1), dtype=bool)
        best[:, 0] = 0
        state = np.zeros(len(data), dtype=np.int32)
        rows = np.arange(len(data))
        any_odd = odd.any(axis=0)
        for end in range(1, width + 1):
            live = rows[n >= end]
            state[live] = self.move[state[live], self.symbol[text[live, end - 1]]]
            node = self.longest[state[live]]
            which = live[node > 0]
            node = node[node > 0]
            # Longest first: of equal scores the first stays.
            while len(which):
                start = end - self.size[node]
                value = best[which, start] + self.score[node]
                better = value > best[which, end]
                won, begin = which[better], start[better]
                best[won, end] = value[better]
                pieces[won, end] = pieces[won, begin] + 1
                node = self.shorter[node]
                which, node = which[node > 0], node[node > 0]
            if any_odd[end]:
                which = live[odd[live, end] > 0]
                size = odd[which, end].astype(np.int64)
                start = end - size
                value = best[which, start] + self.unknown
                better = value > best[which, end]
                won, begin = which[better], start[better]
                best[won, end] = value[better]
                more = size[better] if self.bytes_known else ~after_unknown[won, begin]
                pieces[won, end] = pieces[won, begin] + more
                after_unknown[won, end] = True
        return pieces[rows, n].astype(np.int64), best[rows, n]


def cut_free(pieces: list[tuple[str, float]]) -> bool:
    """Whether no piece goes on behind a space it holds inside: then each part after a space is counted alone."""
    return all(SPACE not in piece.lstrip(SPACE) for piece, _ in pieces)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many tokens every whole text has under the unigram vocabulary of a sentencepiece model, and their best score.

    Returns doc_id, n_tokens, score. A space is put before a text, as the model's own rule is. A null or empty text has
    no tokens. Ids may be null or repeat; no rows give no rows; other columns are not read. The model file is read on the
    driver; it does not grow with the data.
    """
    with open(model_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in chunks(batches, 1):
            if counter is None:
                counter = worker_counter(sent.value)
            texts = texts_of(batch.column(1))
            counts, scores = counted(counter, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(scores)], ["doc_id", "n_tokens", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, score double")


_COUNTERS: dict[int, Counter] = {}


def worker_counter(data: bytes) -> Counter:
    """One automaton for all tasks that a worker process runs."""
    key = hash(data)
    if key not in _COUNTERS:
        pieces, bytes_known = read_pieces(data)
        if not cut_free(pieces):
            raise ValueError("a piece spans two parts")
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(pieces, bytes_known)
    return _COUNTERS[key]


def counted(counter: Counter, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and score of each text: distinct parts are counted once, runs of spaces with what follows them."""
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    # A run of spaces, also with the one put in front or with the sign that stands for them.
    spaced = pc.match_substring_regex(texts, f"^ |  |{SPACE}").to_numpy(zero_copy_only=False)
    counts, scores = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    plain = np.flatnonzero(~spaced & ~empty)
    if len(plain):
        # With the space in front every part begins with one.
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        offsets, codes, parts = spaced_parts(pc.binary_join_element_wise(space, texts.take(pa.array(plain)), nothing))
        got, worth = counter.count([p.replace(" ", SPACE) for p in parts])
        ends = np.concatenate([[0], np.cumsum(got[codes])])[offsets]
        counts[plain] = np.diff(ends)
        owner = np.repeat(np.arange(len(plain)), np.diff(offsets))
        scores[plain] = np.bincount(owner, weights=worth[codes], minlength=len(plain))
    for row in np.flatnonzero(spaced & ~empty).tolist():
        text = (" " + texts[row].as_py()).replace(" ", SPACE)
        # Cut where a run of spaces begins.
        cuts = [k for k in range(1, len(text)) if text[k] == SPACE != text[k - 1]]
        got, worth = counter.count([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])])
        counts[row], scores[row] = got.sum(), worth.sum()
    return counts, scores
