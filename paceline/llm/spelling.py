"""Spelling variants: words one edit apart, found by PartEnum signatures and an equi-join.

A word's letter multiset is a binary vector whose dimensions are (letter, occurrence) pairs: "level" holds l#1, l#2,
e#1, e#2, v#1. One inserted, deleted or replaced letter changes at most two dimensions, so near words lie within
Hamming distance 2. PartEnum (partition, then enumerate) turns that bound into exact signatures: the dimensions are
hashed into `parts` first-level parts, each cut into `subparts` second-level parts. Two vectors within distance k
agree on some first-level part up to k2 = ceil((k + 1) / parts) - 1 dimensions, and so on all of its second-level
parts but k2 of them: one signature per (part, set of k2 dropped subparts) is the projection on the rest. Vectors
within distance 2 share a signature; the join on signatures (plus word length) gives candidates, and the edit
distance of each candidate pair is then checked exactly.

Words are short, so a projection holds few dimensions and many words share it. Measured on the check's small table
(282,392 words), same-length candidate pairs: 1.18e9 with 2 parts of 6 subparts (12 signatures), 1.08e8 with one
part of 8 subparts (28 signatures, each 3/4 of the dimensions); the default is the latter.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import written

# Fixed values of the contract: the letters of a run and the folding of A-Z only.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every maximal letter run of every text, lower-cased in A-Z and thinned: one row per occurrence, column word.

    h is the unsigned crc32 of UTF-8 "<doc_id>:<run>" (a null doc_id counts as empty text); where 97 divides h, the
    run loses its code point h % length. Null texts have no runs; runs are found in the whole text.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(RUN), 0)).alias("_run"),
    )
    low = runs.select("_id", F.translate("_run", UPPER, LOWER).alias("low"))
    hashed = low.select("low", F.crc32(F.concat("_id", F.lit(":"), "low").cast("binary")).alias("h"))
    cut = (F.col("h") % F.char_length("low")).cast("int")
    thinned = F.concat(F.expr("substring(low, 1, cut)"), F.expr("substring(low, cut + 2)"))
    return hashed.select("low", "h", cut.alias("cut")).select(
        F.when(F.col("h") % 97 == 0, thinned).otherwise(F.col("low")).alias("word")
    )


def counted_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, **columns) -> DataFrame:
    """Distinct words of at least `least_length` code points seen at least `least_count` times: word, n, length."""
    words = occurrences(docs, **columns).where(F.char_length("word") >= least_length)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    return counted.withColumn("length", F.char_length("word"))


def signature_sets(parts: int, subparts: int, distance: int = 2) -> list[tuple[int, frozenset[int]]]:
    """PartEnum's signatures: (first-level part, second-level parts left out)."""
    dropped = ceil((distance + 1) / parts) - 1
    return [(p, frozenset(s)) for p in range(parts) for s in combinations(range(subparts), dropped)]


def signatures(words: DataFrame, parts: int = 1, subparts: int = 8) -> DataFrame:
    """One row per (word, signature): word, length, sig, size, digest.

    A signature's value is the number of dimensions in its projection and the xor of their 64-bit hashes; every
    dimension is distinct within a word, so the xor is a set hash. An empty projection is a value too (0, 0).
    """
    letters = words.select("word", "length", F.explode(F.split("word", "")).alias("ch"))
    per_letter = letters.groupBy("word", "length", "ch").agg(F.count(F.lit(1)).alias("times"))
    dims = per_letter.select("word", "length", "ch", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k"))
    dims = dims.select(
        "word",
        "length",
        F.xxhash64("ch", "k").alias("hash"),
        F.pmod(F.xxhash64("ch", "k", F.lit("part")), F.lit(parts)).alias("part"),
        F.pmod(F.xxhash64("ch", "k", F.lit("subpart")), F.lit(subparts)).alias("subpart"),
    )
    sets = signature_sets(parts, subparts)

    def inside(part: int, left_out: frozenset[int]) -> Column:
        cond = F.col("part") == part
        return cond & ~F.col("subpart").isin(*left_out) if left_out else cond

    aggs = []
    for i, (part, left_out) in enumerate(sets):
        aggs.append(F.coalesce(F.bit_xor(F.when(inside(part, left_out), F.col("hash"))), F.lit(0)).alias(f"x{i}"))
        aggs.append(F.count(F.when(inside(part, left_out), F.lit(1))).alias(f"c{i}"))
    # Every word has at least one dimension, so every word has a row here.
    wide = dims.groupBy("word", "length").agg(*aggs)
    entries = F.array(*[F.struct(F.lit(i).alias("sig"), F.col(f"c{i}").alias("size"), F.col(f"x{i}").alias("digest")) for i in range(len(sets))])
    return wide.select("word", "length", F.inline(entries))


def near_pairs(words: DataFrame, parts: int = 1, subparts: int = 8) -> DataFrame:
    """Pairs (a, b), a < b, of words one inserted, deleted or replaced code point apart.

    Candidates share a signature and differ in length by at most one; each is checked by the edit distance.
    """
    posted = signatures(words, parts, subparts)
    # Postings go once to each side; lengths within one are a condition of the pair, not a second copy of the postings.
    key = ["sig", "size", "digest"]
    left = posted.select(*key, F.col("word").alias("a"), F.col("length").alias("la"))
    right = posted.select(*key, F.col("word").alias("b"), F.col("length").alias("lb"))
    close = ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b"))) | (F.col("lb") == F.col("la") + 1)
    found = left.join(right, key).where(close)
    found = found.where(F.levenshtein("a", "b", 1) == 1)
    ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.distinct()


def variant_groups(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, parts: int = 1, subparts: int = 8, **columns
) -> DataFrame:
    """Each counted word with its form and root: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least twice
    the word's own, else null; form_n is the form's n. The root follows forms to the last word (the word itself if it
    has no form). Forms at least double n, so chains are short and end. No words (empty table, only short or rare
    runs): no rows.
    """
    words = written(counted_words(docs, least_length, least_count, **columns), "spelling-words")
    pairs = near_pairs(words, parts, subparts)
    counts = words.select("word", "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.join(counts.withColumnRenamed("word", "b").withColumnRenamed("n", "nb"), "b")
    best = both.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("neg"), F.col("b").alias("w"))).alias("best")
    )
    joined = counts.join(best.withColumnRenamed("a", "word"), "word", "left")
    has_form = F.col("best").isNotNull() & (-F.col("best.neg") >= 2 * F.col("n"))
    table = joined.select(
        "word",
        F.when(has_form, F.col("best.w")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, -F.col("best.neg")).cast("long").alias("form_n"),
    )
    return with_roots(written(table, "spelling-forms"))


def with_roots(table: DataFrame) -> DataFrame:
    """Follow each word's form to the end of its chain, one step per round, until no root moves."""
    forms = table.where(F.col("form").isNotNull()).select(F.col("word").alias("at"), F.col("form").alias("next"))
    roots = table.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        stepped = roots.join(forms, roots["root"] == forms["at"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        stepped = written(stepped, "spelling-roots")
        if not stepped.where("moved").limit(1).count():
            roots = stepped.select("word", "root")
            break
        roots = stepped.select("word", "root")
    return table.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
