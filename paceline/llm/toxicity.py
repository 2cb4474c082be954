"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, letters of other scripts that look Latin, digits and signs that stand for letters. An Aho-Corasick automaton then finds all entries of the lexicon in one pass; an entry must begin a word, and
one that is a whole word must end it too. A match inside an exception phrase does not count. The weights found are summed,
divided by a slowly growing function of the length, and turned into a probability.

The lexicon is learnt from labelled rows: for words and beginnings of words, how much more often documents with the label
hold them. Beginnings that always continue the same way are replaced by the longer one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import chunks, labelled_sample, written

# Letters of other scripts by the Latin letter they look like.
HOMOGLYPHS = {
    "а": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ё": "e", "һ": "h", "і": "i", "ι": "i",
    "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "н": "h", "п": "n", "η": "n", "о": "o", "ο": "o", "р": "p", "ρ": "p",
    "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ν": "v", "ѵ": "v", "ѡ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l",
}
# Digits and signs by the letter they stand for inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

#: Full-width Latin letters follow the ASCII letters at a fixed distance.
WIDE = {0xFF21 + k: chr(ord("a") + k) for k in range(26)} | {0xFF41 + k: chr(ord("a") + k) for k in range(26)}
GLYPHS = str.maketrans(HOMOGLYPHS) | WIDE
DIGITS = str.maketrans(SUBSTITUTES)
#: A stretch of letters, digits and signs.
MIXED = re.compile(r"[\w@$]+")
WORD = re.compile(r"[^\W\d_]+")


def _restored(match: re.Match) -> str:
    """Digits and signs before the last letter of a word as letters; numbers and what follows a word stay."""
    word = match[0]
    end = len(word.rstrip("0123456789@$_"))
    return word[:end].translate(DIGITS) + word[end:]


def fold(text: str) -> str:
    """Lower case, with look-alike letters and substituted digits put back."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(GLYPHS)
    if any(c in text for c in "01345780@$"):
        text = MIXED.sub(_restored, text)
    return text


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights; `whole` entries must end where a word ends. Bounded by `fit`'s parameters."""

    weights: dict[str, float]
    whole: frozenset[str] = frozenset()
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    intercept: float = -2.0
    automaton: object = field(default=None, compare=False)

    def ready(self) -> Lexicon:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (entry, weight, entry in self.whole))
        for phrase in self.exceptions:
            # A phrase can be an entry as well; the exception wins.
            found.add_word(phrase, (phrase, None, True))
        if len(found):
            found.make_automaton()
        return Lexicon(self.weights, self.whole, self.exceptions, self.slope, self.intercept, found)


def total_weight(folded: str, lexicon: Lexicon) -> float:
    """The summed weights of the matches.

    Of entries that begin at one place the heaviest counts; exceptions clear it; what an entry weighs grows with the
    logarithm of how often it stands there, so that a weak one is not made strong by repetition.
    """
    if not lexicon.automaton or not len(lexicon.automaton):
        return 0.0
    best: dict[int, tuple[float, str]] = {}
    spans: list[tuple[int, int]] = []
    n = len(folded)
    for end, (entry, weight, whole) in lexicon.automaton.iter(folded):
        start = end - len(entry) + 1
        if start and folded[start - 1].isalpha() or whole and end + 1 < n and folded[end + 1].isalpha():
            continue
        if weight is None:
            spans.append((start, end))
        elif weight > best.get(start, (0.0,))[0]:
            best[start] = (weight, entry)
    times = Counter(hit for start, hit in best.items() if not any(a <= start <= b for a, b in spans))
    return sum(weight * (1.0 + math.log(n)) for (weight, _), n in times.items())


def normalised(weight: float, n_chars: int) -> float:
    """One match in a long text still tells: weight and length count by their logarithms."""
    return math.log1p(weight) / (1.0 + 0.2 * math.log10(1.0 + n_chars / 1000.0))


def probability(text: str | None, lexicon: Lexicon) -> float:
    if not text:
        return float(1.0 / (1.0 + math.exp(-lexicon.intercept)))
    z = lexicon.intercept + lexicon.slope * normalised(total_weight(fold(text), lexicon), len(text))
    return 1.0 / (1.0 + math.exp(-min(max(z, -60.0), 60.0)))


#: Terms that the documents with the label may bring up; a million would still fit a task.
MAX_TERMS = 200_000
_FIELDS = "kind string, term string, n bigint"


def _as_rows(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    kinds, terms = pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string())
    return pa.RecordBatch.from_arrays([kinds, terms, pa.array([counts[k] for k in keys], pa.int64())], ["kind", "term", "n"])


def counted_terms(sample: DataFrame, shortest: int, longest: int, least_docs: int, exceptions: tuple[str, ...]) -> DataFrame:
    """kind, term, with, without: words and beginnings of words, outside exceptions, by the documents that hold them.

    Only terms that `least_docs` documents with the label hold are looked for in the others; they are at most
    `MAX_TERMS`, the most frequent first, so they travel to the tasks.
    """
    phrases = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(exceptions))) + r")\b") if exceptions else None

    def terms_of(text: str) -> set[tuple[str, str]]:
        folded = fold(text)
        words = {w for w in WORD.findall(folded if phrases is None else phrases.sub(" ", folded)) if len(w) >= shortest}
        return {("word", w) for w in words} | {("start", w[:k]) for w in words for k in range(shortest, min(longest, len(w)) + 1)}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 0, 500_000):
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text))
            yield _as_rows(counts)

    total = F.sum("n").alias("n")
    held = sample.where("label <> 0").select("text").mapInArrow(first, _FIELDS).groupBy("kind", "term").agg(total)
    held = held.where(F.col("n") >= least_docs).orderBy(F.desc("n"), "kind", "term").limit(MAX_TERMS)
    held = written(held.withColumnRenamed("n", "with"), "labelled-terms")
    found = held.select("kind", "term").toArrow()
    sent = sample.sparkSession.sparkContext.broadcast(set(zip(found["kind"].to_pylist(), found["term"].to_pylist())))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in chunks(batches, 0, 500_000):
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text) & sent.value)
        yield _as_rows(counts)

    others = sample.where("label = 0").select("text").mapInArrow(second, _FIELDS).groupBy("kind", "term").agg(total)
    joined = held.join(others, ["kind", "term"], "left")
    return joined.select("kind", "term", "with", F.coalesce("n", F.lit(0)).alias("without"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    max_rows: int = 20_000,
    max_entries: int = 5_000,
    least_docs: int = 4,
    least_odds: float = 20.0,
    shortest: int = 3,
    longest: int = 12,
    exceptions: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Lexicon:
    """Learn a lexicon from at most `max_rows` labelled documents; without labelled rows it is empty.

    An entry is held by at least `least_docs` documents with the label, and `least_odds` times as likely there as
    elsewhere, with nineteen chances in twenty. Of entries the `max_entries` held by most documents stay. Both bound what comes to the driver.
    `exceptions` are phrases in which a match does not count, next to those the sample shows: a word pair around an
    entry that documents without the label hold more often.
    """
    sample = written(labelled_sample(docs, labels, label, max_rows, id_col, text_col), "labelled-texts")
    sizes = {row["label"] != 0: row["n"] for row in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    if not positive or not negative:
        return Lexicon({}, exceptions=tuple(map(fold, exceptions)), intercept=-2.0 if not positive else 2.0)
    lexicon = _chosen(sample, positive, negative, max_entries, least_docs, least_odds, shortest, longest, tuple(map(fold, exceptions)))
    phrases = _exceptions(sample, lexicon, least_docs, positive, negative)
    if phrases:
        # The entries are weighed anew without what stands in a phrase.
        every = tuple(sorted({*lexicon.exceptions, *phrases}))
        lexicon = _chosen(sample, positive, negative, max_entries, least_docs, least_odds, shortest, longest, every)
    slope, intercept = _calibrated(sample, lexicon)
    return Lexicon(lexicon.weights, lexicon.whole, lexicon.exceptions, slope, intercept)


def _chosen(
    sample: DataFrame, positive: int, negative: int, max_entries: int, least_docs: int, least_odds: float, shortest: int,
    longest: int, exceptions: tuple[str, ...],
) -> Lexicon:
    odds = ((F.col("with") + 0.1) / positive) / ((F.col("without") + 0.1) / negative)
    chosen = (
        counted_terms(sample, shortest, longest, least_docs, exceptions)
        .where(F.log(odds) - 1.64 * F.sqrt(1 / F.col("with") + 1 / (F.col("without") + 0.5)) >= math.log(least_odds))
        .select("kind", "term", "with", F.log(odds).alias("weight"))
        .orderBy(F.desc("with"), "term", "kind")
        .limit(max_entries * 8)
        .collect()
    )
    starts = {r["term"]: r for r in chosen if r["kind"] == "start"}
    words = {r["term"]: r for r in chosen if r["kind"] == "word"}
    longer: dict[str, list[int]] = {}
    for term, row in starts.items():
        longer.setdefault(term[:-1], []).append(row["with"])
    weights: dict[str, float] = {}
    whole = set()
    for term, row in starts.items():
        # A beginning that always goes on in one way is the longer one; where it is always one word, it is that word.
        if row["with"] in longer.get(term, ()):
            continue
        parent = starts.get(term[:-1])
        if parent is not None and parent["weight"] >= row["weight"] and parent["with"] > 1.5 * row["with"]:
            # Its shorter form says as much and catches more.
            continue
        weights[term] = row["weight"]
        if term in words and words[term]["with"] == row["with"]:
            whole.add(term)
    for term, row in words.items():
        if len(term) > longest:
            weights[term] = row["weight"]
            whole.add(term)
    weights = dict(list(weights.items())[:max_entries])
    return Lexicon(weights, frozenset(whole & weights.keys()), exceptions)


def _exceptions(sample: DataFrame, lexicon: Lexicon, least_docs: int, positive: int, negative: int) -> list[str]:
    """Word pairs around a match that documents without the label hold at least as often as those with it."""
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = sent.value.ready()
        rows: list[tuple[str, int]] = []
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                if total_weight(folded, ready) == 0:
                    continue
                pairs = re.findall(r"(?=\b([^\W\d_]+ [^\W\d_]+)\b)", folded)
                rows += [(p, int(label != 0)) for p in set(pairs) if total_weight(p, ready) > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["pair", "label"]
        )

    pairs = sample.select("text", "label").mapInArrow(run, "pair string, label bigint")
    counts = pairs.groupBy("pair").agg(F.sum("label").alias("with"), F.count(F.lit(1)).alias("n"))
    without = F.col("n") - F.col("with")
    # Bounded by the sample: each pair is held by `least_docs` documents of it.
    found = counts.where((without >= least_docs) & (without / negative >= F.col("with") / positive)).select("pair")
    return [row["pair"] for row in found.collect()]


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Slope and intercept of the logistic curve over the sample's weights (Newton's method, slightly damped)."""
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = sent.value.ready()
        for batch in batches:
            x = [normalised(total_weight(fold(t), ready), len(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "label"])

    # At most `max_rows` pairs of numbers.
    rows = sample.select("text", "label").mapInArrow(run, "x double, label int").toArrow()
    x, y = rows["x"].to_numpy(), rows["label"].to_numpy() != 0
    # Two made-up rows keep the curve finite where the weights part the labels.
    x = np.concatenate([x, [0.0, x.max(initial=1.0)]])
    y = np.concatenate([y, [True, False]]).astype(float)
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (y - p) - 1e-3 * beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the score of each whole text in `score_col`, which replaces a column of that name.

    The score lies in 0 to 1; a null or empty text gets that of a text without matches. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = sent.value.ready()
        for series in texts:
            yield series.map(lambda text: probability(text, ready)).astype("float64")

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))
