"""Selection by cross-entropy difference: a target and a background language model score each document.

Both are bigram models over words with one vocabulary and one smoothing. Counts are taken over all documents. The whole
models keep every word and every pair of words, each under 64 bits of its own, in tables that grow with the corpus; nothing
of them is broadcast or comes to the driver but sums. A block of documents lists its own words and pairs once, with counts;
the lists meet by ranges of keys, each block gets the counts of the corpus for what it listed, and is scored.

A bounded form takes a vocabulary of the most frequent words, other words by classes of their length, and pairs in hashed
cells; it broadcasts models of that size.

A word's loss under a model is minus the logarithm of an interpolation of the pair's share of what follows the first
word, the word's own share, and an equal share. A document's score is the mean difference of the losses, target
minus background: the lower, the more it resembles the target.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import chunks, texts_of, written
from paceline.llm.minhash import mixed

#: Classes of words outside the vocabulary, by length in bytes; the last takes all longer ones.
CLASSES = 24
#: Weights of the pair, the word and the equal share.
MIX = (0.6, 0.39, 0.01)
#: Bytes of text in a block of documents, and at most for each range of keys.
BLOCK_BYTES = 6_000_000
RANGE_BYTES = 4_000_000
#: Stands before a text, as the key of a word.
START = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Vocabulary:
    """Words in a fixed order; ids from len(words) on are the classes, the last id stands before a text."""

    words: pa.Array

    @property
    def size(self) -> int:
        return len(self.words) + CLASSES

    def ids(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.words)
        known = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(known >= 0, known, len(self.words) + np.minimum(length, CLASSES) - 1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased words between ASCII white space: offsets of the texts, distinct words, and a code per word."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.ascii_trim_whitespace(texts)))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    flat = lists.flatten().dictionary_encode()
    return offsets, flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def sequence(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words: the text each belongs to, its id, and the id before it (the start's for the first of a text)."""
    offsets, distinct, codes = words_of(texts)
    # Empty texts give one empty word, which is no word.
    ids = vocabulary.ids(distinct)
    real = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[real]
    word = ids[codes[real]]
    before = np.concatenate([[vocabulary.size], word[:-1]]) if len(word) else word
    before[np.flatnonzero(np.diff(owner, prepend=-1))] = vocabulary.size
    return owner, word, before


def cells(before: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """The hashed cell of each pair."""
    pair = (before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def fit_vocabulary(docs: DataFrame, size: int, text_col: str = "text") -> Vocabulary:
    """The `size` most frequent words over all documents, ties in order of the words. Only they come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 0):
            _, distinct, codes = words_of(texts_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(distinct)))], ["word", "n"])

    # Each batch is combined in its task, and once more before the shuffle.
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    top = counts.where("word != ''").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return Vocabulary(top.select("word").toArrow()["word"].combine_chunks().cast(pa.large_string()))


@dataclass(frozen=True)
class Model:
    """Counts of words, of words as the first of a pair, and of pairs by cell; all as shares of one total."""

    word: np.ndarray
    first: np.ndarray
    pair: np.ndarray

    def loss(self, before: np.ndarray, word: np.ndarray, cell: np.ndarray) -> np.ndarray:
        pair = self.pair[cell] / np.maximum(self.first[before], 1e-9)
        # Cells can be shared: a share is one at most.
        share = MIX[0] * np.minimum(pair, 1.0) + MIX[1] * self.word[word] / max(self.word.sum(), 1e-9)
        return -np.log(share + MIX[2] / len(self.word))


def fit(
    docs: DataFrame, target: str, vocabulary: Vocabulary, bits: int = 20, text_col: str = "text"
) -> tuple[Model, Model]:
    """Target model and background model; `target` is a boolean column, all other rows are background.

    Null in `target` counts as background. Either side may be empty: its model then gives every word an equal share.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sent.value.size
        totals = None
        for batch in chunks(batches, 0):
            if totals is None:
                totals = [[np.zeros(n, dtype=np.int64) for n in (size, size + 1, 1 << bits)] for _ in range(2)]
            owner, word, before = sequence(texts_of(batch.column(0)), sent.value)
            wanted = pc.fill_null(batch.column(1), False).to_numpy(zero_copy_only=False)[owner]
            cell = cells(before, word, bits)
            for side, rows in ((0, ~wanted), (1, wanted)):
                for array, values in zip(totals[side], (word, before, cell)):
                    array += np.bincount(values[rows], minlength=len(array))
        for kind in range(3) if totals else ():
            used = np.flatnonzero(totals[0][kind] + totals[1][kind])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), kind, dtype=np.int32)), pa.array(used), *(pa.array(totals[s][kind][used]) for s in (0, 1))],
                ["kind", "place", "background", "target"],
            )

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(target).cast("boolean").alias("target"))
    counts = rows.mapInArrow(run, "kind int, place bigint, background bigint, target bigint")
    # As many rows as words and cells at most, whatever the corpus holds.
    found = counts.groupBy("kind", "place").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    found = written(found, "pair-counts").toArrow()
    kind, place = found["kind"].to_numpy(), found["place"].to_numpy()
    arrays = {}
    for side in ("background", "target"):
        value = found[side].to_numpy().astype(np.float64)
        arrays[side] = [
            np.bincount(place[kind == k], weights=value[kind == k], minlength=n)
            for k, n in enumerate((vocabulary.size, vocabulary.size + 1, 1 << bits))
        ]
    # Matched: the background's counts are brought to the target's total.
    totals = {side: arrays[side][0].sum() for side in arrays}
    if totals["background"] and totals["target"]:
        arrays["background"] = [a * (totals["target"] / totals["background"]) for a in arrays["background"]]
    models = {side: Model(*(a.astype(np.float32) for a in arrays[side])) for side in arrays}
    return models["target"], models["background"]


def scored(
    docs: DataFrame, vocabulary: Vocabulary, target: Model, background: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (means per word), score (their difference).

    A text without words, or null, has no losses: they and its score are 0. Ids may be null or repeat; no rows give no
    rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, target, background))
    bits = len(target.pair).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, general = sent.value
        for batch in chunks(batches, 1):
            owner, word, before = sequence(texts_of(batch.column(1)), known)
            cell = cells(before, word, bits)
            n = np.bincount(owner, minlength=batch.num_rows)
            losses = [
                np.bincount(owner, weights=m.loss(before, word, cell), minlength=batch.num_rows) / np.maximum(n, 1)
                for m in (wanted, general)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(losses[0]), pa.array(losses[1]), pa.array(losses[0] - losses[1])],
                ["doc_id", "n_words", "target_loss", "background_loss", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, target_loss double, background_loss double, score double")


def _packed(values: np.ndarray) -> bytes:
    """First all lowest bytes, then the next ones: small numbers compress well so."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sorted_packed(keys: np.ndarray) -> bytes:
    """Steps between sorted keys, whose highest bytes are 0."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _released() -> None:
    """Memory that a block took goes back before the next, as workers idle beside other stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def pair_keys(keys: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits for each pair of words, from the words' own 64; words by place in `keys`."""
    sums = (keys * np.uint64(0x9E3779B97F4A7C15))[before]
    sums += (keys * np.uint64(0xD6E8FEB86659FD93))[word]
    return mixed(sums)


def _pairs(word: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's texts, words by place in `keys`: place before each word (len(keys) at a start), distinct pairs, pair of each word."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(keys)
    distinct, pair = np.unique(pair_keys(np.append(keys, START), before, word), return_inverse=True)
    return before, distinct, pair


def _blocks(marked: DataFrame) -> DataFrame:
    """A row for each block of documents: their ids, numbers of words and sides, their words by place, and the sorted word keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch in chunks(batches, 1, BLOCK_BYTES):
            block += 1
            offsets, words, codes = words_of(texts_of(batch.column(1)))
            # Empty texts give one empty word, which is no word.
            no_word = pc.equal(words, "").to_numpy(zero_copy_only=False)
            real = ~no_word[codes]
            lengths = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets])
            hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
            keys, place = np.unique(hashes[~no_word], return_inverse=True)
            places = np.zeros(len(words), dtype=np.int32)
            places[~no_word] = place
            wanted = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            held = (_packed(lengths.astype(np.int32)), wanted.tobytes(), _packed(places[codes[real]]), _sorted_packed(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), ids, *(pa.array([x], pa.binary()) for x in held)],
                ["block", "ids", "lengths", "wanted", "places", "keys"],
            )
            _released()

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"block bigint, ids array<{kind}>, lengths binary, wanted binary, places binary, keys binary")


def _listed(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and range of keys, the sorted keys that the block holds, with counts in the background and the target.

    Pairs have two counts, words four: all, and those that another word follows.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def cut(keys: np.ndarray, *counts: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        ends = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))
        for a, b in zip(ends[:-1], ends[1:]):
            yield _sorted_packed(keys[a:b]), _packed(np.concatenate([c[a:b] for c in counts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, lengths, wanted, word, keys = (batch.column(c)[k].as_py() for c in range(5))
                lengths, word, keys = _unpacked(lengths, np.int32), _unpacked(word, np.int32), _sorted_unpacked(keys)
                before, distinct, pair = _pairs(word, lengths, keys)
                in_target = np.repeat(np.frombuffer(wanted, np.uint8).astype(bool), lengths)
                sides = (~in_target, in_target)
                pairs = cut(distinct, *(np.bincount(pair[s], minlength=len(distinct)) for s in sides))
                of = [np.bincount(word[s], minlength=len(keys)) for s in sides]
                first = [np.bincount(before[s], minlength=len(keys) + 1)[:-1] for s in sides]
                ranges = [(block, n, *p, *w) for n, (p, w) in enumerate(zip(pairs, cut(keys, *of, *first))) if p[0] or w[0]]
                if ranges:
                    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
                    names = ["block", "bucket", "pairs", "pair_counts", "words", "word_counts"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ranges), kinds)], names)
                del ranges, pair, distinct, before
                _released()

    rows = blocks.select("block", "lengths", "wanted", "places", "keys")
    return rows.mapInArrow(run, "block bigint, bucket int, pairs binary, pair_counts binary, words binary, word_counts binary")


def _summed(keys: list[bytes], counts: list[bytes], width: int) -> tuple[int, np.ndarray, list[bytes]]:
    """Number of distinct keys, sums of each count over all lists, and for each list its keys' counts over all lists."""
    own = [_sorted_unpacked(k) for k in keys]
    distinct, at = np.unique(np.concatenate(own), return_inverse=True)
    split = np.cumsum([len(k) for k in own])[:-1]
    values = np.concatenate([_unpacked(c, np.int64).reshape(width, -1) for c in counts], axis=1)
    total = np.stack([np.bincount(at, weights=v, minlength=len(distinct)) for v in values]).astype(np.int64)
    return len(distinct), total.sum(axis=1), [_packed(np.ascontiguousarray(total[:, a]).ravel()) for a in np.split(at, split)]


def _answered(lists: DataFrame) -> DataFrame:
    """For each block and range, in the order of the block's keys, the counts of the corpus; null blocks hold sums of a range."""

    def run(table: pa.Table) -> pa.Table:
        values = table.select(["pairs", "pair_counts", "words", "word_counts"]).to_pydict()
        _, _, pairs = _summed(values["pairs"], values["pair_counts"], 2)
        n, sums, words = _summed(values["words"], values["word_counts"], 4)
        del values
        _released()
        m = table.num_rows
        return pa.table({
            "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
            "bucket": pa.array([*table["bucket"].to_pylist(), None], pa.int32()),
            "pair_counts": pa.array([*pairs, None], pa.binary()),
            "word_counts": pa.array([*words, None], pa.binary()),
            "sums": pa.array([*[None] * m, [n, *sums.tolist()]], pa.list_(pa.int64())),
        })

    return lists.groupBy("bucket").applyInArrow(
        run, "block bigint, bucket int, pair_counts binary, word_counts binary, sums array<bigint>"
    )


def _settled(df: DataFrame, name: str) -> DataFrame:
    """`written`, and the shuffle files that led to the table go at once: texts are not on disk twice."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def whole_models(docs: DataFrame, target: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`scored` by models of every word and pair in `docs`; `target` is a boolean column, other rows and null are background.

    `size`: bytes of text about, from which the number of ranges of keys follows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(target).cast("boolean"), F.lit(False)).alias("target"),
    )
    # Ranges grow in number with the corpus, not in size.
    buckets = 2 << (size // RANGE_BYTES).bit_length() - 1 if size >= RANGE_BYTES else 2
    blocks = _settled(_blocks(rows), "word-blocks")
    lists = _listed(blocks, buckets)
    answers = _settled(_answered(lists), "word-answers")
    n, *sums = answers.where("block IS NULL").agg(*(F.sum(F.col("sums")[k]) for k in range(5))).first()
    every = [s or 0 for s in sums]
    # Each text with words has one word that is not followed by another.
    texts = [every[s] - every[2 + s] for s in (0, 1)]

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        ids = blocks["ids"].combine_chunks().flatten()
        lengths, word = (_unpacked(blocks[name][0].as_py(), np.int32) for name in ("lengths", "places"))
        keys = _sorted_unpacked(blocks["keys"][0].as_py())
        before, _, pair = _pairs(word, lengths, keys)
        answers = answers.sort_by("bucket")
        seen = [
            np.concatenate([np.zeros((width, 0), np.int64), *(_unpacked(c, np.int64).reshape(width, -1) for c in answers[name].to_pylist())], axis=1)
            for name, width in (("pair_counts", 2), ("word_counts", 4))
        ]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        losses = []
        for side in (1, 0):
            first = np.append(seen[1][2 + side], texts[side])
            share = MIX[0] * seen[0][side][pair] / np.maximum(first[before], 1) + MIX[1] * seen[1][side][word] / max(every[side], 1)
            loss = np.bincount(owner, weights=-np.log(share + MIX[2] / max(n or 0, 1)), minlength=len(lengths))
            losses.append(loss / np.maximum(lengths, 1))
        del seen, share, first, before, pair, owner
        _released()
        columns = [ids, pa.array(lengths.astype(np.int64)), *map(pa.array, losses), pa.array(losses[0] - losses[1])]
        return pa.table(columns, ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = blocks.select("block", "ids", "lengths", "places", "keys").groupBy("block")
    replies = answers.where("block IS NOT NULL").select("block", "bucket", "pair_counts", "word_counts").groupBy("block")
    return parts.cogroup(replies).applyInArrow(run, f"doc_id {kind}, n_words bigint, target_loss double, background_loss double, score double")


def cross_entropy_difference(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    vocabulary_size: int | None = None,
    bits: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row with its losses under models of the documents labelled 1 and of all others; see `scored`.

    The models are whole, unless `vocabulary_size` and `bits` are both given, which bound them.
    Labels are joined to the documents by id; of several labels of one id the largest counts.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).alias("label"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if (vocabulary_size is None) != (bits is None):
        raise ValueError("vocabulary_size and bits bound the models together")
    # Labels grow with the documents, so they are never broadcast: the plan is the same at every size.
    marked = rows.join(known.where("label = 1").hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id", "text", F.col("label").isNotNull().alias("target")
    )
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return whole_models(marked, "target", size)
    vocabulary = fit_vocabulary(rows, vocabulary_size)
    target, background = fit(marked, "target", vocabulary, bits)
    return scored(rows, vocabulary, target, background)
