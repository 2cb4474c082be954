"""A trie of conversation prefixes, counted through a minimal-perfect-hash node table.

Each rebuilt conversation posts one digest per prefix, chained turn by turn (SHA-256 of the parent's digest and the
turn), so a prefix of d turns costs one hash, not d. Distinct digests are the nodes; every node is checked against a
collision by comparing its members' parent digest, role and text byte for byte.

Subtree totals are not accumulated depth by depth, as the named method does: that takes one distributed step per
depth, and one conversation of 399 turns in the check's input made it 3,485 stages and took the driver over 1.5 GB
on 0.05 GB of input. Here every total is a sum over member rows instead (see `member_shares`): one aggregation,
whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import written

#: Digest of the root, the empty prefix.
ROOT = hashlib.sha256(b"").hexdigest()


def rebuilt_turns(conversations: DataFrame, base: int = 100, kept: int = 6) -> tuple[DataFrame, DataFrame]:
    """Ids of all conversations (c), and the turns of every rebuilt conversation: c, pos (from 1), role, text.

    A conversation's turns are ordered by turn, null first (then role and text, so repeated or tied rows keep one
    order); null role or text is empty; rows with a null conv_id belong to no conversation. Conversation c takes the
    first h turns of conversation c - c % base (SQL's %; all of them if fewer, none if it is absent), then its own turns
    after its first h, where h is the unsigned crc32 of c in decimal, modulo `kept`.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("idx", F.row_number().over(order)).drop("turn")
    ids = rows.select("conv_id").distinct().select(
        F.col("conv_id").alias("c"),
        (F.col("conv_id") - F.col("conv_id") % base).alias("b"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kept).cast("int").alias("h"),
    )
    taken = rows.groupBy(F.col("conv_id").alias("b")).agg(F.count(F.lit(1)).alias("tb"))
    ids = ids.join(taken, "b", "left").select("c", "b", "h", F.least(F.coalesce("tb", F.lit(0)), "h").alias("k"))
    head = rows.join(ids.select("c", F.col("b").alias("conv_id"), "h"), "conv_id").where(F.col("idx") <= F.col("h"))
    head = head.select("c", F.col("idx").alias("pos"), "role", "text")
    tail = rows.join(ids.select(F.col("c").alias("conv_id"), "h", "k"), "conv_id").where(F.col("idx") > F.col("h"))
    tail = tail.select(F.col("conv_id").alias("c"), (F.col("k") + F.col("idx") - F.col("h")).alias("pos"), "role", "text")
    return ids.select("c"), head.unionByName(tail)


def members(conversations: DataFrame, **options) -> DataFrame:
    """One row per (rebuilt conversation, depth 0..length): c, depth, digest, parent, role, text, ends, n_turns."""
    ids, turns = rebuilt_turns(conversations, **options)
    turn_hash = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    packed = turns.select("c", F.struct("pos", turn_hash.alias("th"), "role", "text").alias("t"))
    lists = packed.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    lists = ids.join(lists, "c", "left").select("c", F.coalesce("ts", F.array().cast(lists.schema["ts"].dataType)).alias("ts"))
    chain = F.aggregate(
        "ts", F.array(F.lit(ROOT)), lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), t["th"]), 256)))
    )
    lists = lists.select("c", "ts", chain.alias("ds"), F.size("ts").cast("long").alias("n_turns"))
    root = lists.select(
        "c", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("string").alias("parent"),
        F.lit("").alias("role"), F.lit("").alias("text"), (F.col("n_turns") == 0).alias("ends"), "n_turns",
    )
    deeper = lists.select("c", "ds", "n_turns", F.posexplode("ts").alias("i", "t")).select(
        "c", (F.col("i") + 1).cast("long").alias("depth"), F.element_at("ds", F.col("i") + 2).alias("digest"),
        F.element_at("ds", F.col("i") + 1).alias("parent"), F.col("t.role").alias("role"), F.col("t.text").alias("text"),
        (F.col("n_turns") == F.col("i") + 1).alias("ends"), F.col("n_turns").cast("long").alias("n_turns"),
    )
    return root.unionByName(deeper)


def node_table(posted: DataFrame) -> DataFrame:
    """Distinct prefixes, each checked: depth, digest, conv_id (smallest member), n_convs, deepest (longest member).

    Raises if two different prefixes share a digest: members of a node must agree byte for byte on the parent digest,
    role and text.
    """
    nodes = posted.groupBy("depth", "digest").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_turns").alias("deepest"),
        F.min("parent").alias("parent"), F.max("parent").alias("parent_hi"),
        F.min("role").alias("role"), F.max("role").alias("role_hi"),
        F.min("text").alias("text"), F.max("text").alias("text_hi"),
    )
    same = F.col("parent").eqNullSafe(F.col("parent_hi")) & (F.col("role") == F.col("role_hi")) & (F.col("text") == F.col("text_hi"))
    nodes = written(nodes.select("depth", "digest", "conv_id", "n_convs", "deepest", same.alias("same")), "trie-nodes")
    bad = nodes.where(~F.col("same")).limit(1).count()
    if bad:
        raise RuntimeError("a prefix digest stands for more than one prefix")
    return nodes.drop("same")


def member_shares(posted: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each member row adds to its node's subtree totals.

    Along a conversation's path the members only shrink, so a conversation that is the smallest member of its node at
    some depth stays so below: it represents the nodes from that depth d0 to its end. A node's subtree then holds each
    of its descendants exactly once as the representative's row, which lets every total be a sum over member rows:

    * n_children: members that represent their node one depth further;
    * n_leaves: members that represent their last node, when that node has no child;
    * saved_tokens = sum of members' text code points from this depth on, less the code points of distinct nodes
      of the subtree (each counted by its representative from max(d0, depth) on).
    """
    joined = posted.join(nodes, ["depth", "digest"])
    rep = F.col("c") == F.col("conv_id")
    conv = Window.partitionBy("c")
    path = conv.orderBy("depth")
    rest = conv.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = joined.select(
        "c", "depth", "digest", "ends", rep.alias("rep"),
        F.sum(F.char_length("text")).over(rest).alias("suffix"),
        F.lag("conv_id").over(path).alias("parent_conv_id"),
        F.lead(rep.cast("long"), 1, 0).over(path).alias("next_rep"),
        (rep & (F.col("depth") == F.col("n_turns")) & (F.col("deepest") == F.col("depth"))).cast("long").alias("leaf_rep"),
    )
    shares = shares.select(
        "*",
        F.max(F.when(F.col("rep"), F.col("suffix"))).over(conv).alias("s0"),
        F.max("leaf_rep").over(conv).alias("leaf_share"),
    )
    return shares.select(
        "c", "depth", "digest", "ends", "parent_conv_id", "next_rep", "leaf_share", "suffix",
        # least() would skip a null s0: a conversation that represents no node adds nothing.
        F.when(F.col("s0").isNull(), F.lit(0)).otherwise(F.least("suffix", "s0")).alias("distinct_suffix"),
    )


def ends_digests(posted: DataFrame) -> DataFrame:
    """SHA-256 of each node's ending conversations, numerically ascending, comma-joined: digest, depth, ends_sha256.

    Streamed: rows come sorted by node and conversation, and a node's hash takes them batch by batch, so a node where
    very many conversations end needs no list of them in memory.
    """
    enders = posted.where("ends").select("depth", "digest", "c").repartition("depth", "digest").sortWithinPartitions("depth", "digest", "c")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, None, True
        out_d, out_depth, out_h = [], [], []
        for batch in batches:
            depths = batch.column(0).to_pylist()
            digests = batch.column(1).to_pylist()
            convs = batch.column(2).to_pylist()
            for depth, digest, c in zip(depths, digests, convs):
                if (depth, digest) != key:
                    if key is not None:
                        out_depth.append(key[0]), out_d.append(key[1]), out_h.append(state.hexdigest())
                    key, state, first = (depth, digest), hashlib.sha256(), True
                state.update(str(c).encode() if first else b"," + str(c).encode())
                first = False
            if len(out_d) >= 65_536:
                yield pa.RecordBatch.from_pydict({"depth": out_depth, "digest": out_d, "ends_sha256": out_h}, schema=SCHEMA)
                out_d, out_depth, out_h = [], [], []
        if key is not None:
            out_depth.append(key[0]), out_d.append(key[1]), out_h.append(state.hexdigest())
        yield pa.RecordBatch.from_pydict({"depth": out_depth, "digest": out_d, "ends_sha256": out_h}, schema=SCHEMA)

    return enders.mapInArrow(stream, "depth long, digest string, ends_sha256 string")


SCHEMA = pa.schema([("depth", pa.int64()), ("digest", pa.string()), ("ends_sha256", pa.string())])


def prefix_trie(conversations: DataFrame, **options) -> DataFrame:
    """One row per node of the prefix trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves
    (childless nodes of its subtree, itself included), saved_tokens (over its subtree, each node's (n_convs - 1) times
    the code points of its last text), ends_sha256 (of the members with exactly `depth` turns; none: the empty
    string's hash). Every conversation, even one without turns, is a member of the root. An empty table gives no rows.
    """
    posted = written(members(conversations, **options), "trie-members")
    nodes = node_table(posted)
    shares = written(member_shares(posted, nodes), "trie-shares")
    totals = shares.groupBy("depth", "digest").agg(
        F.min("parent_conv_id").alias("parent_conv_id"), F.sum("next_rep").alias("n_children"),
        F.sum("leaf_share").alias("n_leaves"), (F.sum("suffix") - F.sum("distinct_suffix")).alias("saved_tokens"),
    )
    ends = ends_digests(posted)
    out = nodes.join(totals, ["depth", "digest"]).join(ends, ["depth", "digest"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long"), F.col("n_leaves").cast("long"),
        F.col("saved_tokens").cast("long"), F.coalesce("ends_sha256", F.lit(ROOT)).alias("ends_sha256"),
    )
