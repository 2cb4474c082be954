"""Near-duplicates by an inverted join over MinHash coordinates.

1. Each text becomes its set of word shingles and a signature: the least value of the set under each of many hash
   functions. Equal sets form one class, so copies cost nothing further on.
2. A class is posted under each pair of coordinate and value. Two sets of similarity s agree in a coordinate with
   probability s, so similar ones share at least `matches` of them but for a negligible chance (at 64 coordinates and 32
   matches below 1e-7 for similarity 0.8 itself). A class with fewer shared values has no partner.
3. For the others the full sets are made, and the shingles counted that no other candidate holds. They bound how large a
   partner can be; where none can be large enough the class is done. This takes out texts that share a long passage, and
   the less faithful members of large groups of near copies.
4. What is left is posted anew, under its rarest values only: two classes with `matches` in common meet in the first
   (shared - matches + 1) of each in order of frequency. The long lists are skipped and only looked up, through the
   signatures, when the agreements of a pair are counted.
5. Within a list no pairs are formed at first. Each list names a leader, its members are compared with that one only, and
   classes found similar become one component. A few rounds with other leaders join large groups of near copies at a cost
   in proportion to the postings. Then the pairs of a list that lie in different components, and whose bounds allow it,
   are compared; see `open_pairs`. So each pair above the threshold is compared, or already in one component.
6. A pair counts when its signatures agree often enough and its full sets confirm it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import chunks, ragged, texts_of, written
from paceline.llm.graph import components

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and how many words each text has.

    Words are stretches without white space of ASCII; A to Z count as a to z.
    """
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    n = len(data)
    inside = ~_GAP[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[ends] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    # A polynomial of the bytes, from differences of one running sum.
    power = np.full(n, _BASE, dtype=np.uint64)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    sums = np.add.accumulate((_LOWER[data] + np.uint64(1)) * power)
    power = np.full(n, _INVERSE, dtype=np.uint64)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    before = np.where(start > 0, sums[start - 1], np.uint64(0)) if n else sums
    value = (sums[stop] - before) * power[start] if n else sums
    hashes = mixed(value + (stop - start + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.diff(np.searchsorted(start, ends))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: `size` words, or all words where there are fewer."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    per_text = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    at = ragged(starts, per_text)
    stop = np.repeat(ends, per_text)
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        here = at + k < stop
        value[here] = mixed(value[here] * np.uint64(_BASE) + words[at[here] + k] + np.uint64(k + 1))
    return [np.unique(part) for part in np.split(value, np.cumsum(per_text)[:-1])] if len(counts) else []


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of the set under each function, 32 bits."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 8192):
        part = a[:, None] * x[None, k : k + 8192]
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def coordinate_functions(coords: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, coords, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, coords, dtype=np.uint32)


def signatures(docs: DataFrame, shingle: int, coords: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """For each row: doc_id, text_hash, n_shingles, digest of its set, and signature (both null for an empty set)."""
    a, b = coordinate_functions(coords, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2, 1_500_000):
            sets = shingle_sets(texts_of(batch.column(2)), shingle)
            full = [s for s in sets if len(s)]
            flat = np.concatenate([signature(s, a, b) for s in full]) if full else np.zeros(0, np.uint32)
            sizes = np.array([coords if len(s) else 0 for s in sets], dtype=np.int32)
            values = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int32))
            )
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), values],
                ["doc_id", "text_hash", "n_shingles", "digest", "signature"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, digest binary, signature array<int>"
    )


def coordinate_values(classes: DataFrame) -> DataFrame:
    """node, token: each class under each of its coordinates and values, packed into one number."""
    place, value = F.col("place").cast("long"), F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)
    rows = classes.select("node", F.posexplode("signature").alias("place", "value"))
    return rows.select("node", F.shiftleft(place, 32).bitwiseOR(value).alias("token"))


def alone(rows: DataFrame, item: str) -> DataFrame:
    """node, n_alone: how many of a node's items no other node holds. An item stands once per node at most."""
    holders = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    return holders.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("n_alone"))


def candidates(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """The classes that share at least `matches` values with others."""
    lonely = alone(coordinate_values(classes), "token").where(F.col("n_alone") > coords - matches)
    return classes.join(lonely, "node", "left_anti")


def bounded(signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds `high`, the largest partner a class can have; classes that can have none are left out.

    With c common of n and m shingles, similar sets have c * (100 + percent) >= percent * (n + m); c is at most what
    the class shares with any other. And m is at least n * percent / 100.
    """
    lonely = alone(sets.select("node", F.explode("shingles").alias("shingle")), "shingle")
    shared = F.col("n_shingles") - F.coalesce("n_alone", F.lit(0))
    high = F.floor(shared * (100 + percent) / percent - F.col("n_shingles"))
    rows = signs.join(lonely, "node", "left").select("node", "signature", "n_shingles", high.alias("high"))
    return rows.where(F.col("high") * 100 >= F.col("n_shingles") * percent)


def rare_postings(signs: DataFrame, matches: int) -> DataFrame:
    """node, token: each class under the rarest of the values it shares with others, as many as the threshold needs."""
    tokens = coordinate_values(signs)
    shared = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-values")
    # At most one entry per coordinate.
    held = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    size = F.size("held")
    rarest = F.slice("held", F.lit(1), size - F.lit(matches - 1))
    return held.where(size >= matches).select("node", F.explode(rarest.getField("token")).alias("token"))


def agreeing(left: str, right: str) -> Column:
    """In how many coordinates two signatures agree."""
    same = F.zip_with(left, right, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def confirmed(pairs: DataFrame, signs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `matches` coordinates and whose full sets reach the similarity."""
    one = signs.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = signs.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    likely = pairs.join(one, "a").join(two, "b").where(agreeing("sa", "sb") >= matches).select("a", "b", "na", "nb")
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    held = likely.join(first, "a").join(second, "b").select("a", "b", "na", "nb", common.alias("common"))
    return held.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def spokes(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members of each list beside the list's leader, once per leader: `apart` are the shingles that only one of the two
    holds, `near` says whether they are similar.

    The leader is the member that can have the largest partners, so the lists of a group share a few of them.
    """
    order = F.struct((-F.col("high_common")).alias("first"), F.xxhash64("node").alias("order"), "node", "comp", "n_shingles")
    named = rows.groupBy("token").agg(F.min(order).alias("lead"))
    lead = (F.col("lead.node").alias("leader"), F.col("lead.comp").alias("lead_comp"), F.col("lead.n_shingles").alias("n_lead"))
    beside = rows.join(named, "token").where("node != lead.node").select("node", "comp", "n_shingles", "high_common", *lead).distinct()
    leading = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("led"))
    both = beside.join(sets.select("node", "shingles"), "node").join(leading, "leader")
    apart = F.concat(F.array_except("shingles", "led"), F.array_except("led", "shingles"))
    found = both.withColumn("apart", apart).withColumn("d", F.size("apart").cast("long")).drop("shingles", "led")
    return found.withColumn("near", F.col("d") * (100 + percent) <= (F.col("n_shingles") + F.col("n_lead")) * (100 - percent))


def pairs_beside_leaders(found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of spokes of one leader, not both near it, that may be similar.

    With d shingles between a class of n and the leader, two classes are similar if they agree in x of these differences,
    2x >= d + d' - q * (n + n') for q = (100 - percent) / (100 + percent). As one of them is not near the leader, its d is
    above q times the shingles of both; so x exceeds half of the other's d + q * (n_leader - n). Independent changes to one
    text do not agree so far. In order of frequency the first agreement stands among the first d - x + 1 differences of
    that other class, and both have to have x left from there on.
    """
    up, down = 100 + percent, 100 - percent
    items = found.select("leader", "node", F.explode("apart").alias("item"))
    shared = written(items.groupBy("leader", "item").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-differences")
    held = items.join(shared, ["leader", "item"]).groupBy("leader", "node").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("held"))
    # Differences of one class alone come first, they are only counted.
    placed = found.drop("apart").join(held, ["leader", "node"]).withColumn("single", F.col("d") - F.size("held"))
    placed = placed.select("*", F.posexplode(F.col("held.item")).alias("pos", "item"))
    left = F.col("d") - F.col("single") - F.col("pos")
    least = F.floor((F.col("d") * up + (F.col("n_lead") - F.col("n_shingles")) * down) / (2 * up)) + 1
    rows = ("leader", "item", "node", "comp", "n_shingles", "high_common", "d", "near", left.alias("left"))
    placed = written(placed.select(*rows, (left >= least).alias("early")), "differences")
    x, y = placed.where("not near").alias("x"), placed.where("early").alias("y")
    same = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.item") == F.col("y.item"))
    other = F.when(F.col("y.near"), F.col("x.comp") != F.col("y.comp")).otherwise(F.col("x.comp") < F.col("y.comp"))
    fits = (F.col("x.n_shingles") <= F.col("y.high_common")) & (F.col("y.n_shingles") <= F.col("x.high_common"))
    needed = (F.col("x.d") + F.col("y.d")) * up - (F.col("x.n_shingles") + F.col("y.n_shingles")) * down
    pairs = x.join(y, same & other & fits & (F.least("x.left", "y.left") * (2 * up) >= needed))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def open_pairs(lists: DataFrame, sets: DataFrame, rare: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of open lists that lie in different components and may be similar, and those known to be.

    Either two classes share a shingle that at most `rare` open classes hold: then the short list of that shingle
    brings them together. Or they share none: then such shingles do not count for what they can have in common, which
    leaves few members of a large group of near copies. Each list of these names a leader again. A member near it is
    linked to it; a pair with a member that is not must share differences from it, see `pairs_beside_leaders`.
    """
    nodes = lists.select("node", "comp", "n_shingles", "high").distinct()
    held = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    seldom = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rare)
    held = written(held.join(seldom, "shingle"), "rare-holders")
    few = held.groupBy("node").agg(F.count(F.lit(1)).alias("n_rare"))
    common = F.col("n_shingles") - F.coalesce("n_rare", F.lit(0))
    nodes = nodes.join(few, "node", "left").withColumn("high_common", F.floor(common * (100 + percent) / percent - F.col("n_shingles")))
    nodes = written(nodes, "open-nodes")

    seldom = held.where("n > 1").join(nodes, "node")
    x, y = seldom.alias("x"), seldom.alias("y")
    fits = (F.col("x.n_shingles") <= F.col("y.high")) & (F.col("y.n_shingles") <= F.col("x.high"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") < F.col("y.comp")) & fits)
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    able = nodes.where(F.col("high_common") * 100 >= F.col("n_shingles") * percent)
    rows = lists.select("token", "node").join(able, "node")
    ends = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("top"), F.min("n_shingles").alias("least"))
    rows = rows.join(ends.where("low < top"), "token").where(F.col("least") <= F.col("high_common"))
    found = written(spokes(rows, sets, percent), "spokes")
    linked = found.where("near and comp != lead_comp").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    return met.union(pairs_beside_leaders(found, percent)).distinct(), linked


def merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp after the links between nodes are added."""
    of_a = members.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    of_b = members.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    ends = links.join(of_a, "a").join(of_b, "b").select("ca", "cb")
    roots = components(ends, "ca", "cb").select(F.col("node").alias("comp"), "root")
    return written(members.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "members")


def near_dedup(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    coords: int = 64,
    matches: int = 32,
    rounds: int = 3,
    rare: int = 16,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row with the smallest id among the texts it is linked to, directly or through others.

    Texts are linked when the shingle sets share at least `percent` of a hundred of their union; links are confirmed on
    full sets of 64-bit hashes. Returns doc_id, n_shingles, component_id, kept, text_hash; kept holds where the id is the
    component's. A null text or one without words has no shingles, is linked with nothing and stays. A null id is never the
    component's unless all of its ids are null. Rows that share an id are told apart by their texts. No rows give no rows;
    other columns are not read. `rounds` and `rare` change the plan only, never the
    result.
    """
    rows = written(signatures(docs, shingle, coords, seed, id_col, text_col), "signatures")
    rest = [c for c in ("doc_id", "text_hash")]
    one = F.struct(F.col("doc_id").isNull().alias("none"), *rest)
    classes = rows.where("n_shingles > 0").groupBy("digest", "n_shingles", "signature").agg(F.min(one).alias("first"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    signs = written(candidates(classes, coords, matches), "candidates")

    # The texts of the candidates, and their full sets.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    wanted = signs.select("node", "first.doc_id", "first.text_hash").alias("w")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_hash") == F.col("w.text_hash"))
    found = texts.alias("t").join(wanted, same).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 1_500_000):
            sets = [s.view(np.int64) for s in shingle_sets(texts_of(batch.column(1)), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    sets = written(found.mapInArrow(full, "node bigint, shingles array<bigint>"), "candidate-sets")

    signs = written(bounded(signs, sets, percent), "bounded-candidates")
    postings = rare_postings(signs, matches).join(signs.select("node", "n_shingles", "high"), "node")
    postings = written(postings, "postings")

    members = signs.select("node", F.col("node").alias("comp"))
    for turn in range(rounds):
        lists = postings.join(members, "node")
        # First the member that can have the largest partners: the most faithful one of a group.
        order = -F.col("high") if turn == 0 else F.lit(0)
        leader = F.struct(order.alias("first"), F.xxhash64("node", F.lit(turn)).alias("order"), "node", "comp", "n_shingles", "high")
        named = lists.groupBy("token").agg(F.min(leader).alias("leader"), F.min("comp").alias("low"), F.max("comp").alias("top"))
        named = written(named.where("low < top").select("token", "leader"), "leaders")
        if named.isEmpty():
            break
        pairs = lists.join(named, "token").where(F.col("comp") != F.col("leader.comp"))
        pairs = pairs.where((F.col("n_shingles") <= F.col("leader.high")) & (F.col("leader.n_shingles") <= F.col("high")))
        pairs = pairs.select(F.col("node").alias("a"), F.col("leader.node").alias("b")).distinct()
        members = merged(members, confirmed(pairs, signs, sets, matches, percent))

    lists = postings.join(members, "node")
    open_lists = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("top"), F.min("n_shingles").alias("least"))
    lists = lists.join(written(open_lists.where("low < top").select("token", "least"), "open-lists"), "token")
    lists = written(lists.where("least <= high").drop("least"), "open-postings")
    if not lists.isEmpty():
        pairs, linked = open_pairs(lists, sets, rare, percent)
        pairs = written(pairs, "open-pairs")
        members = merged(members, confirmed(pairs, signs, sets, matches, percent).union(linked))

    firsts = classes.select("node", "digest", F.col("first.doc_id").alias("first_id")).join(members, "node", "left")
    firsts = written(firsts.withColumn("comp", F.coalesce("comp", "node")), "class-components")
    least = firsts.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_digest = written(firsts.join(least, "comp").select("digest", "component_id"), "digest-components")
    joined = rows.join(of_digest, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
