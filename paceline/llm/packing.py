"""Fixed-length sequences from neighbouring documents along a space-filling curve.

Each document becomes a vector of hashed token counts, projected to few dimensions; its direction there gives a place on
a Hilbert curve. Rows are sorted by range along the curve and their tokens cut into sequences one after the other, so
that a sequence holds documents that resemble each other. The curve position is followed by bits of a hash of the id:
documents on one spot, such as copies, still spread over all tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceline.llm.common import chunks, texts_of, written

DIMS, BITS = 4, 10
#: Hashed document vectors have so many cells.
CELLS = 256
#: Bits of the id's hash below the curve position; with it a key fills a long.
TIE_BITS = 63 - DIMS * BITS
#: Parts of texts whose tokens a worker keeps for later batches.
KEPT_PARTS = 25_000


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with coordinates below 2 ** bits (Skilling's transform)."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for k in range(n):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] ^ swap
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            key = key << 1 | ((x[k] ^ flip) >> bit) & 1
    return key


def projection(vocabulary: int, seed: int) -> np.ndarray:
    """For each token id its step in every dimension: a hashed cell with a sign, projected. Whole numbers: sums are exact."""
    rng = np.random.default_rng(seed)
    rows = np.rint(rng.standard_normal((CELLS, DIMS)) * 1000).astype(np.int64)
    cell = rng.integers(0, CELLS, vocabulary)
    sign = rng.choice(np.array([-1, 1]), vocabulary)
    return rows[cell] * sign[:, None]


def curve_keys(ids: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The curve position of each document, from its token ids."""
    sums = np.stack([np.add.reduceat(steps[:, k][ids], starts) for k in range(DIMS)], axis=1).astype(np.float64)
    length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    unit = sums / np.maximum(length, 1.0)
    return hilbert(np.clip(np.floor((unit + 1) / 2 * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64))


class WordTokenizer:
    """Whole texts to ids with a lower-casing word tokenizer of the tokenizers library.

    Such a tokenizer drops white space and never looks across it, so each distinct part between white space is encoded
    once. Parts of plain Latin letters and ASCII signs are cut by the same pattern here and go straight to the model;
    all others pass through the whole tokenizer.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # Letters that lower-case to one letter and have no other composed form.
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else None for b in range(256)]
        hidden = iter(range(256, 512))
        self.shown = str.maketrans({b: c or chr(next(hidden)) for b, c in enumerate(shown)})
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}
        self.of_piece: dict[str, bytes] = {}
        # Most parts: one word of plain letters, and one mark behind it at most.
        self.simple = re.compile(r"([a-zß-öø-ÿ]+)([.,!]?)").fullmatch

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.of_piece.get(piece)
        if found is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            found = self.packed([token.id for token in self.model.tokenize(letters)])
            if len(self.of_piece) < KEPT_PARTS:
                self.of_piece[piece] = found
        return found

    def part(self, text: str) -> bytes:
        lower = text.lower()
        simple = self.simple(lower)
        if simple:
            word, mark = simple.groups()
            return self.piece(word) + self.piece(mark) if mark else self.piece(word)
        if self.plain(text):
            return b"".join(map(self.piece, self.pieces(lower)))
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: pa.Array, last: int) -> list[bytes]:
        """The packed ids of each text, followed by `last`."""
        lists = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        offsets = (offsets - offsets[0]).tolist()
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        known, rows = self.kept, []
        for part in words.dictionary.to_pylist():
            ids = known.get(part)
            if ids is None:
                ids = self.part(part)
                if len(known) < KEPT_PARTS:
                    known[part] = ids
            rows.append(ids)
        row, end = rows.__getitem__, self.packed([last])
        return [b"".join(map(row, codes[a:b].tolist())) + end for a, b in zip(offsets, offsets[1:])]


def tokenized(
    docs: DataFrame, definition: str, last: int = 2, seed: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The tokens of every whole text and its place on the curve: doc_id, key, doc_tokens, ids (little-endian, 16 or 32 bits)."""
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = steps = None
        for batch in chunks(batches, 2, 6_000_000):
            if words is None:
                words = _worker_tokenizer(sent.value)
                steps = projection(words.tokenizer.get_vocab_size(), seed)
            rows = words.encode(texts_of(batch.column(2)), last)
            sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // words.dtype.itemsize
            place = curve_keys(np.frombuffer(b"".join(rows), dtype=words.dtype), np.cumsum(sizes) - sizes, steps)
            tie = batch.column(1).to_numpy(zero_copy_only=False) & (1 << TIE_BITS) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place << TIE_BITS | tie), pa.array(sizes), pa.array(rows, pa.binary())],
                ["doc_id", "key", "doc_tokens", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.length(text)).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key bigint, doc_tokens bigint, ids binary")


_TOKENIZERS: dict[int, WordTokenizer] = {}


def _worker_tokenizer(definition: str) -> WordTokenizer:
    """One tokenizer, with the parts it has met, for all tasks that a worker process runs."""
    key = zlib.crc32(definition.encode())
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(definition)
    return _TOKENIZERS[key]


def sizes_of_tail(tokens: int) -> list[int]:
    """Powers of two that sum up to `tokens`, largest first."""
    return [1 << bit for bit in range(tokens.bit_length() - 1, -1, -1) if tokens >> bit & 1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 4096,
    last: int = 2,
    seed: int = 8,
    tokens_per_task: int = 4_000_000,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut all documents into pieces and put these into sequences of at most `length` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.
    Every id lies in one piece. All sequences are full but for the end of each task's stretch of the curve, which is
    cut into sequences whose lengths are powers of two; so none needs padding. A null or empty text is the id `last`
    alone. Ids may be null or repeat; ties on the curve are broken by a hash of id and text length, then by id. No rows
    give no rows; other columns are not read. The tokenizer's file is read on the driver; it does not grow with the data.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    width = 2 if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else 4
    stored = written(tokenized(docs, definition, last, seed, id_col, text_col), "packing-tokens")
    total = stored.agg(F.sum("doc_tokens")).first()[0] or 0
    tasks = max(1, -(-total // tokens_per_task))
    ordered = stored.repartitionByRange(tasks, "key", "doc_id").sortWithinPartitions("key", "doc_id", "doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        open_pieces: list[tuple[object, int, np.ndarray, int]] = []
        filled = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, n in open_pieces:
                data = ids.astype("<u4").tobytes()
                out.append((doc, start, len(ids), zlib.crc32(data), n, number, offset, ids))
                offset += len(ids)
            number += 1
            open_pieces.clear()

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 8
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in columns[7]], pa.list_(pa.int64())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, n, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids = np.frombuffer(data, dtype=f"<u{width}")
                start = 0
                while start < n:
                    taken = min(length - filled, n - start)
                    open_pieces.append((doc, start, ids[start : start + taken], n))
                    start += taken
                    filled += taken
                    if filled == length:
                        close()
                        filled = 0
            if out:
                yield table()
        # The end of the stretch: no padding when lengths are powers of two.
        rest = list(open_pieces)
        open_pieces.clear()
        for size in sizes_of_tail(filled):
            while size:
                doc, start, ids, n = rest[0]
                taken = min(size, len(ids))
                open_pieces.append((doc, start, ids[:taken], n))
                size -= taken
                if taken == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + taken, ids[taken:], n)
            close()
        if out:
            yield table()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, " + ", ".join(f"{name} bigint" for name in names[1:])
    if with_ids:
        names.append("ids")
        fields += ", ids array<bigint>"
    return ordered.mapInArrow(run, fields)
