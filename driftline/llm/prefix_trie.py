"""A trie of conversations by their first turns, in flat tables of nodes.

Turns are dealt out by ranges of (conversation, turn), so that a conversation of
any length lies in several ranges, and every step works on segments: the turns
of one conversation in one range. The digest of a prefix is the exclusive or of
128-bit hashes of its turns with their places, so segments are combined by one
value each.

Nodes are the distinct prefix digests; one hash aggregation gives their members.
Sums over subtrees go through parent slots. A node belongs to its smallest
member; of a conversation's path it owns the nodes from some depth on. So paths
are dealt into shards of bounded size by pieces of a conversation, every shard
enumerates the distinct digests on its paths, gives them slots by a minimal
perfect hash that is verified against the digests, scatters what the owned nodes
bring into flat arrays, and adds slots to their parents' slots, deepest first.
Each node's weight lies in one shard, so the shards' sums for a node add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.columns import pick
from driftline.session import materialise

#: Conversations that share a base, and the number of different heads (0 to 5 turns).
GROUP, HEADS = 100, 6
#: Turns in a shard on average, and in a piece of one conversation at most.
SHARD_TURNS, PIECE_TURNS = 60_000, 16_384
#: Children from which a parent's row is sent to every task, and the most rows sent that way.
HOT_CHILDREN, HOT_PARENTS = 50_000, 100_000

_ROOT = (0, 0)
_EARLIER = (Window.unboundedPreceding, -1)


# --- the rebuilt conversations ---------------------------------------------------------------------------------------


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in order: ``conv``, ``part`` (range), ``at`` (1-based place within the range), 128 bits of digest and ``chars``."""
    rows = pick(conversations, conv, turn, role, text).toDF("conv", "turn", "role", "text").filter(F.col("conv").isNotNull())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda i: F.xxhash64(F.substring(digest, 1 + 16 * i, 16))
    rows = rows.select(
        F.col("conv").cast("bigint").alias("conv"),
        "turn",
        digest.alias("digest"),
        half(0).alias("a"),
        half(1).alias("b"),
        F.length(text).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("row"),  # equal rows may lie in different ranges
    )
    ranged = rows.repartitionByRange("conv", "turn", "digest", "row").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("conv", "part").orderBy("turn", "digest", "row")
    placed = ranged.select("conv", "part", F.row_number().over(order).cast("bigint").alias("at"), "a", "b", "chars")
    return materialise(placed, "trie-turns")


def _segments(turns: DataFrame) -> DataFrame:
    """One row for each conversation and range: its turns before, its head and what its base gives to it."""
    found = turns.groupBy("conv", "part").agg(F.max("at").alias("n"))
    whole = Window.partitionBy("conv")
    found = found.select(
        "conv",
        "part",
        F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(*_EARLIER)), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("total"),
        (F.count(F.lit(1)).over(whole) > 1).alias("several"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("head"),
        (F.col("conv") - F.col("conv") % GROUP).alias("base"),
    )
    # the first turns of a base may lie in several ranges
    is_base = F.col("conv") % GROUP == 0
    starts = found.filter(is_base & (F.col("before") < HEADS)).select("conv", "part", "before")
    first = turns.filter(is_base & (F.col("at") < HEADS)).join(starts, ["conv", "part"])
    first = first.select(F.col("conv").alias("base"), F.struct((F.col("before") + F.col("at")).alias("pos"), "a", "b", "chars").alias("turn"))
    first = first.filter(F.col("turn.pos") < HEADS).groupBy("base").agg(F.sort_array(F.collect_list("turn")).alias("given"))
    joined = found.join(first, "base", "left")
    head = F.col("head").cast("int")
    given = F.coalesce(F.slice("given", F.lit(1), head), F.array().cast(first.schema["given"].dataType))
    joined = joined.withColumn("given", given)
    kept = F.greatest(F.col("total") - F.col("head"), F.lit(0))
    joined = joined.withColumn("size", F.size("given") + kept)
    return materialise(joined.select("conv", "part", "before", "several", "head", "given", "size"), "trie-segments")


def _mixed(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "pos", "a", "b")


def _paths(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations: ``conv``, ``part``, ``pos`` (depth), ``size`` and digests.

    ``da``, ``db`` are the digest of the prefix that ends here, ``pa``, ``pb`` that of the one before.
    """
    place = F.col("before") + F.col("at")
    own = turns.join(segments, ["conv", "part"]).filter(place > F.col("head"))
    own = own.select("conv", "part", "several", "size", (place - F.col("head") + F.size("given")).alias("pos"), "a", "b", "chars")
    given = segments.filter(F.col("before") == 0).select("conv", "part", "several", "size", F.inline("given"))
    rows = own.unionByName(given)
    rows = rows.select("conv", "part", "several", "size", "pos", "chars", _mixed(1).alias("ma"), _mixed(2).alias("mb"))
    within = Window.partitionBy("conv", "part").orderBy("pos")
    rows = rows.withColumns({"la": F.bit_xor("ma").over(within), "lb": F.bit_xor("mb").over(within)})
    rows = materialise(rows, "trie-paths")
    # a range has a first and a last conversation, so at most two segments of it go on elsewhere: the table is
    # bounded by the number of ranges
    ends = rows.filter("several").groupBy("conv", "part").agg(F.max_by(F.struct("la", "lb"), "pos").alias("end"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(*_EARLIER)
    carried = ends.select("conv", "part", F.bit_xor("end.la").over(earlier).alias("ca"), F.bit_xor("end.lb").over(earlier).alias("cb"))
    rows = rows.join(F.broadcast(carried), ["conv", "part"], "left")
    rows = rows.withColumns({f"d{x}": F.col(f"l{x}").bitwiseXOR(F.coalesce(f"c{x}", F.lit(0).cast("bigint"))) for x in "ab"})
    rows = rows.withColumns({f"p{x}": F.when(F.col("pos") == 1, F.lit(0)).otherwise(F.col(f"d{x}").bitwiseXOR(F.col(f"m{x}"))) for x in "ab"})
    return rows.select("conv", "part", "pos", "size", "chars", "da", "db", "pa", "pb")


# --- slots and sums within a shard -----------------------------------------------------------------------------------


def _scramble(x: np.ndarray) -> np.ndarray:
    """64 bits from 64 bits, every one from all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests.

    Each level hashes the digests that are left to twice as many places; those
    alone at their place keep it, the others go on to the next level. A digest's
    slot is the number of places taken before its own.
    """

    def __init__(self, digests: np.ndarray):
        """``digests``: an array of n rows of two unsigned 64-bit numbers, no two alike."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = digests, 0
        while len(left):
            size = 2 * len(left)
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            slots = np.cumsum(alone) - 1 + taken
            taken += int(alone.sum())
            self.levels.append((alone, slots))
            left = left[~alone[place]]
        self.keys = np.zeros_like(digests)
        found, _ = self._slots(digests)
        self.keys[found] = digests
        self.verify(digests, found)

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        mixed = _scramble(digests[:, 0] + step) ^ _scramble(digests[:, 1] ^ step)
        return (_scramble(mixed) % np.uint64(size)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = np.zeros(len(digests), dtype=np.int64)
        open_ = np.arange(len(digests))
        for level, (alone, numbers) in enumerate(self.levels):
            place = self._place(digests[open_], level, len(alone))
            hit = alone[place]
            slots[open_[hit]] = numbers[place[hit]]
            open_ = open_[~hit]
        return slots, open_

    def verify(self, digests: np.ndarray, slots: np.ndarray) -> None:
        if not np.array_equal(self.keys[slots], digests):
            raise ValueError("a digest does not own its slot")

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; an error for one that is not in the table."""
        found, missing = self._slots(digests)
        if len(missing):
            raise ValueError("a digest has no slot")
        self.verify(digests, found)
        return found


def _digests(table: dict[str, np.ndarray], names: str) -> np.ndarray:
    return np.stack([table[names[0] + x].view(np.uint64) for x in "ab"], axis=1)


def shard_sums(
    depth: np.ndarray, own: np.ndarray, parent: np.ndarray, leaves: np.ndarray, saved: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests of a shard with the sums of ``leaves`` and ``saved`` over what lies below them in it.

    ``own`` and ``parent`` are digests, ``leaves`` and ``saved`` what each row brings to its node, ``starts`` marks
    rows whose parent lies in another piece of the conversation; nothing goes up from those.
    """
    inner = ~starts
    distinct = np.unique(np.concatenate([own, parent[inner]]), axis=0)  # the root is a parent only
    table = SlotTable(distinct)
    n = len(distinct)
    slot = table.slots(own)
    up = np.full(n, -1, dtype=np.int64)
    up[slot[inner]] = table.slots(parent[inner])
    depth_of = np.zeros(n, dtype=np.int64)
    depth_of[slot] = depth
    sums = np.zeros((n, 2), dtype=np.int64)
    np.add.at(sums, slot, np.stack([leaves, saved], axis=1))
    order = np.argsort(-depth_of, kind="stable")
    edges = np.flatnonzero(np.diff(depth_of[order])) + 1
    for level in np.split(order, edges):
        level = level[up[level] >= 0]
        np.add.at(sums, up[level], sums[level])
    return table.keys, sums


def _sum_shard(table: pa.Table) -> pa.Table:
    columns = {name: table.column(name).to_numpy() for name in table.column_names}
    keys, sums = shard_sums(
        columns["pos"], _digests(columns, "d"), _digests(columns, "p"), columns["leaves"], columns["saved"], columns["start"]
    )
    return pa.table({"da": keys[:, 0].view(np.int64), "db": keys[:, 1].view(np.int64), "leaves": sums[:, 0], "saved": sums[:, 1]})


def _piece(pos: Column) -> Column:
    return F.floor((pos - 1) / PIECE_TURNS)


def _subtree_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every node ``leaves`` and ``saved``, summed over its subtree; a node may have several rows, which add up."""
    nothing = F.lit(0).cast("bigint")
    steps = paths.select("conv", "pos", "da", "db", "pa", "pb", nothing.alias("leaves"), nothing.alias("saved"))
    # an owned node once more, as a row of its owner's path that brings its weight
    weights = nodes.select(
        "conv", "pos", "da", "db", "pa", "pb",
        (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    # a conversation of several pieces: what all later pieces bring lies on the last node of each piece
    long = paths.filter((F.col("size") > PIECE_TURNS) & ((F.col("pos") == F.col("size")) | (F.col("pos") % PIECE_TURNS == 0)))
    by_piece = weights.groupBy("conv", _piece(F.col("pos")).alias("piece")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    last = long.select("conv", "pos", "da", "db", "pa", "pb", _piece(F.col("pos")).alias("piece")).join(by_piece, ["conv", "piece"], "left")
    later = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(*_EARLIER)
    last = last.withColumns({name: F.coalesce(F.sum(name).over(later), nothing) for name in ("leaves", "saved")})
    rows = steps.unionByName(weights).unionByName(last.filter((F.col("leaves") > 0) | (F.col("saved") > 0)).drop("piece"))
    shards = max(1, -(-paths.count() // SHARD_TURNS))
    rows = rows.withColumn("start", (F.col("pos") > 1) & ((F.col("pos") - 1) % PIECE_TURNS == 0))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("conv", _piece(F.col("pos"))), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(_sum_shard, "da bigint, db bigint, leaves bigint, saved bigint")


# --- members that end at a node --------------------------------------------------------------------------------------


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each run of rows of a node, over their strings joined by commas; holds one string at a time."""
    node, digest = None, None
    schema = pa.schema([("da", pa.int64()), ("db", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        made = []
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (a, b) == node:
                digest.update(b",")
            else:
                if node is not None:
                    made.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256()
            digest.update(ids.encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made), schema, strict=True)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*node, digest.hexdigest()), schema, strict=True)], schema=schema)


def _ends(ends: DataFrame) -> DataFrame:
    """The hash of the conversations that end at each node, ascending.

    Ranges ascend with the conversations, so each range joins its own ids
    first; SHA-256 goes on from there over strings, one after the other.
    """
    strings = ends.groupBy("da", "db", "part").agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    ordered = strings.repartition("da", "db").sortWithinPartitions("da", "db", "part").select("da", "db", "ids")
    return ordered.mapInArrow(_hash_runs, "da bigint, db bigint, ends_sha256 string")


# --- the table of nodes ----------------------------------------------------------------------------------------------


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``parent_conv`` for every node: the smallest member of its parent.

    Parents of very many children, whose number is bounded by HOT_PARENTS, go to every task; the children of the
    others are joined by a shuffle.
    """
    n = nodes.count()
    named = nodes.select(F.col("da").alias("pa"), F.col("db").alias("pb"), F.col("conv").alias("parent_conv"), "n_children")
    hot = F.col("n_children") > max(HOT_CHILDREN, n // HOT_PARENTS)
    children = nodes.filter("pos > 0").join(F.broadcast(named.filter(hot).drop("n_children")), ["pa", "pb"], "left")
    rest = children.filter(F.col("parent_conv").isNull()).drop("parent_conv").join(named.filter(~hot & (F.col("n_children") > 0)).drop("n_children"), ["pa", "pb"])
    root = nodes.filter("pos = 0").withColumn("parent_conv", F.lit(None).cast("bigint"))
    return children.filter(F.col("parent_conv").isNotNull()).unionByName(rest).unionByName(root)


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for every distinct sequence of first turns of the rebuilt conversations, the empty one included.

    Turns are ordered by ``turn``, null first, ties by the MD5 of length of the
    role, colon, role and text; rows that repeat all of it are turns of their
    own. A null role or text counts as empty; rows without a conversation are
    left out. A conversation c is rebuilt from the first h turns of conversation
    c - c % 100 (the remainder has the sign of c) and its own turns after its
    first h, h = crc32(c) % 6. Other columns are left out. Without rows there
    are no nodes, not even a root.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id``, ``n_convs``
    members, ``n_children``, ``n_leaves`` and ``saved_tokens`` over the subtree,
    ``ends_sha256`` hash of the members that end here.
    """
    turns = _turns(conversations, conv, turn, role, text)
    segments = _segments(turns)
    paths = materialise(_paths(turns, segments), "trie-prefixes")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    ended = (F.col("pos") == F.col("size")).cast("bigint")
    nodes = paths.groupBy("da", "db", "pos").agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv").alias("conv"),
        F.sum(ended).alias("n_ends"),
        F.min("chars").alias("chars"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
    )
    nodes = materialise(nodes, "trie-nodes")

    every = segments.filter(F.col("before") == 0)
    a, b = (F.lit(x).cast("bigint") for x in _ROOT)
    facts = ("pos", "conv", "n_convs", "pa", "pb")
    unknown = [F.lit(None).cast("bigint").alias(name) for name in facts]
    nothing = [zero.alias(name) for name in ("children", "leaves", "saved")]
    known = nodes.select("da", "db", *facts, *nothing)
    root = every.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv")).filter("n_convs > 0")
    root = root.select(a.alias("da"), b.alias("db"), zero.alias("pos"), "conv", "n_convs", *unknown[-2:], *nothing)
    child = nodes.select(F.col("pa").alias("da"), F.col("pb").alias("db"), *unknown, one.alias("children"), *nothing[1:])
    sums = _subtree_sums(paths, nodes).select("da", "db", *unknown, nothing[0], "leaves", "saved")
    whole = known.unionByName(root).unionByName(child).unionByName(sums).groupBy("da", "db")
    whole = whole.agg(
        *[F.max(name).alias(name) for name in facts],
        F.sum("children").alias("n_children"),
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
    )
    whole = materialise(whole, "trie-sums")

    ends = paths.filter(F.col("pos") == F.col("size")).select("da", "db", "part", "conv")
    ends = ends.unionByName(every.filter(F.col("size") == 0).select(a.alias("da"), b.alias("db"), "part", "conv"))
    found = _with_parents(whole).join(_ends(ends), ["da", "db"], "left")
    return found.select(
        F.col("conv").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.greatest("leaves", one).alias("n_leaves"),  # a root without children is a leaf
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
