"""The prefix trie of conversations, by vertical bitmaps.

Conversations are dealt to shards, ranges of their ids of at most SHARD conversations. A shard's index has, for every
(position, turn), the bitset of its conversations with that turn at that position, and for every length the bitset of
those that end there. From the root (all bits set) a node's children are the intersections of its bitset with the
postings of the next position; their numbers of bits are the members, and what meets the bitset of ends is the node's
list of ends. A conversation that is alone in its node goes on as a plain list of turns.

Nodes are named by a running digest of their turns, so those of different shards meet by one aggregation: however many
conversations share a first turn, each shard sends one row for it. Sums over subtrees don't walk the trie level by
level. A node belongs to its smallest member; the nodes of a member are a vertical chain, and chains hang below one
another. Totals go up that smaller tree by pointer doubling, then along each chain by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .common import lookup
from .mixing import word_count

#: Conversations of a shard (bits of its bitsets) at most, and turns after which a shard is closed.
SHARD, TURNS = 4096, 1 << 18
#: Bytes of a node's name.
NAME = 16
#: Name of the prefix without turns.
ROOT = bytes(NAME)

_NODE = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("words", pa.int64()), ("shard", pa.int64()), ("ends", pa.string())])
_NODE_DDL = "node binary, parent binary, depth bigint, n bigint, m bigint, words bigint, shard bigint, ends string"


def turn_digests(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, digest, words) of every row with a conversation id; null roles and texts are empty."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), word_count(text).alias("words"))
    return rows.filter(F.col("conv").isNotNull())


class Shard:
    """Postings of the conversations of one shard; ids ascend."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.turns: list[list[tuple[bytes, int]]] = []
        self.size = 0

    def add(self, conv: int, turns: list[tuple[bytes, int]]) -> None:
        self.ids.append(conv)
        self.turns.append(turns)
        self.size += len(turns)

    def full(self) -> bool:
        return len(self.ids) >= SHARD or self.size >= TURNS

    def nodes(self) -> Iterator[tuple]:
        """A row of _NODE for each node, depth first."""
        postings: dict[tuple[int, bytes], int] = {}
        ended: dict[int, int] = {}
        for k, turns in enumerate(self.turns):
            bit = 1 << k
            ended[len(turns)] = ended.get(len(turns), 0) | bit
            for d, (digest, _) in enumerate(turns):
                postings[d, digest] = postings.get((d, digest), 0) | bit
        shard = self.ids[0]
        stack = [((1 << len(self.ids)) - 1, 0, ROOT, None, 0)]
        while stack:
            bits, depth, name, parent, words = stack.pop()
            k = (bits & -bits).bit_length() - 1
            if bits & (bits - 1) == 0:
                yield from self._alone(k, depth, name, parent, words, shard)
                continue
            end = bits & ended.get(depth, 0)
            yield name, parent, depth, bits.bit_count(), self.ids[k], words, shard, self._listed(end) if end else None
            rest = bits ^ end
            while rest:
                k = (rest & -rest).bit_length() - 1
                digest, words = self.turns[k][depth]
                child = bits & postings[depth, digest]
                stack.append((child, depth + 1, _child(name, digest), name, words))
                rest ^= child

    def _alone(self, k: int, depth: int, name: bytes, parent: bytes | None, words: int, shard: int) -> Iterator[tuple]:
        conv, turns = self.ids[k], self.turns[k]
        for digest, more in turns[depth:]:
            yield name, parent, depth, 1, conv, words, shard, None
            name, parent, depth, words = _child(name, digest), name, depth + 1, more
        yield name, parent, depth, 1, conv, words, shard, str(conv)

    def _listed(self, bits: int) -> str:
        places = bin(bits)[:1:-1]
        out, k = [], places.find("1")
        while k >= 0:
            out.append(str(self.ids[k]))
            k = places.find("1", k + 1)
        return ",".join(out)


def _child(name: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(name + digest, digest_size=NAME).digest()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[bytes, int]]]]:
    """(block, conversation, its turns) of sorted rows."""
    block = conv = None
    turns: list[tuple[bytes, int]] = []
    for batch in batches:
        for b, c, digest, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if c != conv:
                if conv is not None:
                    yield block, conv, turns
                block, conv, turns = b, c, []
            turns.append((digest, words))
    if conv is not None:
        yield block, conv, turns


def shard_nodes(turns: DataFrame, *, block: int | None = None, lent: int = 1) -> DataFrame:
    """The nodes of every shard's trie; turns as turn_digests returns them.

    With block, conversation c starts with the first h turns of conversation c - c % block (all if fewer, none if
    absent) in place of its own first h; h is the checksum of c's digits modulo lent.
    """
    group = F.col("conv") - F.col("conv") % F.lit(block) if block else F.col("conv")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % F.lit(lent)
    rows = turns.select(group.alias("block"), "conv", "digest", "words", h.alias("h"), "turn")
    rows = rows.repartitionByRange("block").sortWithinPartitions("block", "conv", "turn", "digest").select("block", "conv", "digest", "words", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard = Shard()
        now, first = None, []
        lending: dict[int, int] = {}

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lending.update(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True))
                yield batch

        for b, conv, own in _conversations(noted(batches)):
            if b != now:
                now, first = b, []
            if conv == b:
                first = own[: lent - 1]
            n = lending.pop(conv)
            shard.add(conv, first[:n] + own[n:] if block else own)
            if shard.full():
                held += shard.nodes()
                shard = Shard()
            while len(held) >= 1 << 16:
                yield _batch(held[: 1 << 16])
                held = held[1 << 16 :]
        if shard.ids:
            held += shard.nodes()
        if held:
            yield _batch(held)

    return rows.mapInArrow(run, _NODE_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)


def _end_digests(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end. A node's lists stream by in order of their shards, so
    that no task holds more than one of them."""
    lists = parts.filter("ends IS NOT NULL").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node == now:
                    state.update(b"," + ends.encode())
                    continue
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return lists.mapInArrow(run, "node binary, ends_sha256 string")


def _chain_totals(nodes: DataFrame) -> DataFrame:
    """(m, top, up_m, up_depth, saved, leaves) of each member's chain of nodes: the depth of its first node, the member
    and depth above it (null for the root's chain), and the sums over all that hangs below its first node."""
    own = F.sum((F.col("n") - 1) * F.col("words"))
    chains = nodes.groupBy("m").agg(F.min("depth").alias("top"), F.max("depth").alias("last"), F.min_by("parent", "depth").alias("up"), own.alias("saved"))
    names = nodes.select("node", F.col("m").alias("up_m"))
    chains = lookup(stash(chains, "chains"), names, "up", "node", ["up_m"]).withColumn("up_depth", F.when(F.col("up_m").isNotNull(), F.col("top") - 1))
    chains = stash(chains.select("m", "top", "last", "saved", "up_m", "up_depth"), "chain-tree")
    inner = chains.filter("up_m IS NOT NULL").select(F.col("up_m").alias("im"), F.col("up_depth").alias("il")).distinct()
    leaf = F.when(F.col("im").isNull(), 1).otherwise(0).cast("long")
    sums = chains.join(inner, (F.col("m") == F.col("im")) & (F.col("last") == F.col("il")), "left").select("m", "top", "up_m", "up_depth", "saved", leaf.alias("leaves"), F.col("up_m").alias("above"))
    while True:
        sums = stash(sums, "chain-sums")
        rising = sums.filter("above IS NOT NULL")
        if rising.isEmpty():
            return sums.drop("above")
        more = rising.groupBy(F.col("above").alias("to")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        sums = lookup(sums, sums.select(F.col("m").alias("jump"), F.col("above").alias("next")), "above", "jump", ["next"])
        sums = sums.join(more, F.col("m") == F.col("to"), "left")
        sums = sums.select("m", "top", "up_m", "up_depth", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")), F.col("next").alias("above"))


def prefix_trie(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int | None = None, lent: int = 1) -> DataFrame:
    """One row for each distinct prefix of the conversations' turns, the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member and
    the number of turns name a node; members are the conversations that start with the prefix; leaves are nodes without
    children in the node's subtree, itself included; saved_tokens sums (members - 1) x words of the node's last text
    over the subtree; ends_sha256 is the digest of the ids that end here, ascending and joined by commas. block and
    lent: see shard_nodes.

    Turns are ordered by turn, null first; rows that repeat a turn number all count, ordered by the digest of role and
    text. Null roles and texts are empty. Rows without conversation id belong to no conversation. An empty table gives
    an empty result. Other columns are not read.
    """
    parts = stash(shard_nodes(turn_digests(conversations, conv=conv, turn=turn, role=role, text=text), block=block, lent=lent), "shard-nodes")
    nodes = parts.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("m").alias("m"), F.first("words").alias("words"))
    nodes = stash(nodes, "trie-nodes")
    chains = stash(_chain_totals(nodes), "chain-totals")
    hung = chains.filter("up_m IS NOT NULL").groupBy(F.col("up_m").alias("hm"), F.col("up_depth").alias("hd")).agg(F.count(F.lit(1)).alias("k"), F.sum("saved").alias("below"), F.sum("leaves").alias("ends_below"))
    rows = nodes.join(hung, (F.col("m") == F.col("hm")) & (F.col("depth") == F.col("hd")), "left")
    rows = rows.join(chains.select(F.col("m").alias("cm"), "top", "up_m"), F.col("m") == F.col("cm"))
    rows = rows.join(_end_digests(parts).withColumnRenamed("node", "en"), F.col("node") == F.col("en"), "left")
    upward = Window.partitionBy("m").orderBy(F.desc("depth"))
    none = F.lit(0).cast("long")
    last, hanging = F.row_number().over(upward) == 1, F.coalesce("k", none)
    to_here = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("last", last).withColumn("leaf", F.when(F.col("last") & (hanging == 0), 1).otherwise(0))
    return rows.select(
        F.col("m").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("up_m")).otherwise(F.col("m")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (hanging + F.when(F.col("last"), 0).otherwise(1)).cast("long").alias("n_children"),
        F.sum(F.coalesce("ends_below", none) + F.col("leaf")).over(to_here).alias("n_leaves"),
        F.sum(F.coalesce("below", none) + (F.col("n") - 1) * F.col("words")).over(to_here).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The same rows as prefix_trie(conversations, block=20, lent=4). The checksum is spelled out bit by bit.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, md5(length(role)::VARCHAR || ':' || role || text) AS tok, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) - 1 AS pos
  FROM turns
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), mended AS (
  SELECT i.conv_id, o.pos, o.tok, o.words FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos < i.h
  UNION ALL
  SELECT i.conv_id, o.pos, o.tok, o.words FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos >= i.h
), steps AS (
  SELECT conv_id, words, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, md5(string_agg(tok, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM mended
), members AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS words, NULL AS parent FROM ids
  UNION ALL
  SELECT conv_id, depth, node, words, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') FROM steps
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(parent) AS parent FROM members GROUP BY node, depth
), kids AS (
  SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT m.node, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN kids k ON k.parent = n.node GROUP BY m.node
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, node FROM members QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.parent = n.node JOIN sums s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
