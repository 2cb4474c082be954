"""Byte-level BPE by replaying all merges over a body of words.

Each task takes the distinct words of its texts as one body. An inverted index leads from each pair of tokens to the
places where the pair stands; pairs are taken in rank order, all their places are merged, and only the neighbours of a
merged place get new entries. As every token of a vocabulary encodes to itself, a merge never brings up a pair of a
smaller rank, so this is the same as merging each word on its own, least rank first. Texts never leave their task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import chunks, ragged, spaced_parts, texts_of

#: A token id needs 17 bits at most; a pair is kept as one number.
SHIFT = 17
MASK = (1 << SHIFT) - 1
#: From so many places on, a merge is done with arrays.
MANY = 24


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Merges:
    """The merges of a vocabulary, and their replay."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) > MASK:
            raise ValueError("token ids need more than 17 bits")
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.rank = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.rank[left << SHIFT | right] = rank
        keys = np.fromiter(self.rank.keys(), dtype=np.int64, count=len(self.rank))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(self.rank.values(), dtype=np.int64, count=len(self.rank))[order]

    def known(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs can be merged."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return self.keys[at] == pairs

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, one after the other, and where each word begins and ends among them."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words) + 1, dtype=np.int64)
        token = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        last = ends[sizes > 0] - 1
        after[last] = -1
        before[(ends - sizes)[sizes > 0]] = -1

        index: dict[int, list[int]] = {}
        queue: list[int] = []
        rank_of = self.rank

        def post(pairs: np.ndarray, places: np.ndarray) -> None:
            hit = self.known(pairs)
            pairs, places = pairs[hit], places[hit]
            order = np.argsort(pairs, kind="stable")
            pairs, places = pairs[order], places[order].tolist()
            starts = np.flatnonzero(np.diff(pairs, prepend=-1))
            stops = np.append(starts[1:], len(pairs)).tolist()
            for pair, start, stop in zip(pairs[starts].tolist(), starts.tolist(), stops):
                if pair in index:
                    index[pair] += places[start:stop]
                else:
                    index[pair] = places[start:stop]
                    heapq.heappush(queue, rank_of[pair] << 2 * SHIFT | pair)

        left = np.flatnonzero(after >= 0)
        post(token[left].astype(np.int64) << SHIFT | token[left + 1], left)
        t, a, b = memoryview(token), memoryview(after), memoryview(before)
        while queue:
            top = heapq.heappop(queue)
            merged, pair = top >> 2 * SHIFT, top & (1 << 2 * SHIFT) - 1
            first, second = pair >> SHIFT, pair & MASK
            places = index.pop(pair)
            if len(places) >= MANY and first != second:
                p = np.unique(np.array(places, dtype=np.int32))
                q = after[p]
                good = (token[p] == first) & (q >= 0)
                good[good] = token[q[good]] == second
                p, q = p[good], q[good]
                token[p] = merged
                token[q] = -1
                onward = after[q]
                after[p] = onward
                inner = onward >= 0
                before[onward[inner]] = p[inner]
                back = before[p]
                tail = back >= 0
                pairs = np.concatenate(
                    [
                        np.int64(merged) << SHIFT | token[onward[inner]].astype(np.int64),
                        token[back[tail]].astype(np.int64) << SHIFT | merged,
                    ]
                )
                post(pairs, np.concatenate([p[inner], back[tail]]))
                continue
            # Leftmost first: it decides among places that overlap.
            for p in sorted(places):
                q = a[p]
                if q < 0 or t[p] != first or t[q] != second:
                    continue
                t[p] = merged
                t[q] = -1
                onward, back = a[q], b[p]
                a[p] = onward
                if onward >= 0:
                    b[onward] = p
                    new = merged << SHIFT | t[onward]
                    if new in rank_of:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(queue, rank_of[new] << 2 * SHIFT | new)
                if back >= 0:
                    new = t[back] << SHIFT | merged
                    if new in rank_of:
                        if new in index:
                            index[new].append(back)
                        else:
                            index[new] = [back]
                            heapq.heappush(queue, rank_of[new] << 2 * SHIFT | new)
        alive = token >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return token[alive], count[np.concatenate([[0], ends])]


class Encoder:
    """Whole texts to token ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.match = regex.compile(pattern).findall

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as unsigned 32-bit numbers, and where each text begins and ends among them."""
        # Only a run of spaces lets the pattern look past the space that begins a part.
        plain = pc.invert(pc.match_substring(texts, "  ")).to_numpy(zero_copy_only=False)
        offsets, codes, parts = spaced_parts(pc.if_else(pa.array(plain), texts, ""))
        pieces: dict[str, int] = {}
        of_part: list[int] = []
        sizes = np.zeros(len(parts), dtype=np.int64)
        for k, part in enumerate(parts):
            found = self.match(part)
            sizes[k] = len(found)
            of_part += [pieces.setdefault(x, len(pieces)) for x in found]
        flat = np.array(of_part, dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        per_code = sizes[codes]
        places = flat[ragged(starts[codes], per_code)]
        per_text = np.zeros(len(texts), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(per_code)])[offsets]
        per_text[:] = np.diff(ends)
        if not plain.all():
            spaced = np.flatnonzero(~plain)
            whole = {}
            for k in spaced.tolist():
                found = self.match(texts[k].as_py())
                whole[k] = np.array([pieces.setdefault(x, len(pieces)) for x in found], dtype=np.int64)
            rows = [whole[k] if k in whole else places[ends[k] : ends[k + 1]] for k in range(len(texts))]
            per_text = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            places = np.concatenate(rows)
        ids, at = self.merges.replay([x.encode() for x in pieces])
        lengths = np.diff(at)[places]
        out = ids[ragged(at[places], lengths)].astype("<u4")
        piece_ends = np.concatenate([[0], np.cumsum(lengths)])
        return out, piece_ends[np.concatenate([[0], np.cumsum(per_text)])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.merges.token.__getitem__, ids.tolist()))


def encoded(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """The token ids of every whole text.

    Returns doc_id, n_tokens and ids (array of long); with `digests`, the SHA-256 of the ids as little-endian unsigned
    32-bit numbers and of the bytes they decode to take the place of the ids. A null or empty text has no tokens; ids of
    rows may be null or repeat; no rows give no rows; other columns are not read. The rank file is read on the driver
    and sent along: it does not grow with the data.
    """
    with open(rank_path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in chunks(batches, 1, 16_000_000):
            encoder = encoder or Encoder(read_ranks(data.value), pattern)
            ids, at = encoder.encode(texts_of(batch.column(1)))
            columns = [batch.column(0), pa.array(np.diff(at))]
            rows = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            if digests:
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()))
                columns.append(pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in rows], pa.string()))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                names = ["doc_id", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {out}")


def decoded(tokens: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that token ids stand for: doc_id, decoded (binary). Null ids give null; an unknown id is an error."""
    with open(rank_path, "rb") as file:
        data = tokens.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = None
        for batch in batches:
            if token is None:
                token = {rank: piece for piece, rank in read_ranks(data.value).items()}
            rows = [None if ids is None else b"".join(map(token.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, decoded binary"
    )
