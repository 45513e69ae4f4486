"""Prefix trie of conversations, as balanced parentheses in shards.

Conversations are paths of turn keys.  Distinct paths in order are cut in
shards by range; each shard's trie is a string of parentheses with a value for
each node in preorder.  A tree of range minima over blocks of the excess finds
the parenthesis that closes a node, and with it the subtree as one stretch of
the preorder: leaves are a rank of "()", sums are differences of running sums.
Nodes on a shard's first or last path may go on in its neighbours; these
spines are merged by key, and give their sums to all nodes above them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from planarium.llm._pack import packed, unpacked
from planarium.llm._store import written

#: Distinct paths of a shard; their nodes are held by one task.
SHARD_PATHS = 1 << 14
#: Bytes of a turn's key.
KEY = 16
NO_MEMBER = np.iinfo(np.int64).max
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_PATH = "array<struct<key: binary, size: int>>"


class Parentheses:
    """A string of parentheses (1 opens) with a tree of excess minima over its blocks."""

    BLOCK = 256

    def __init__(self, bits: np.ndarray):
        self.bits, self.n = bits, len(bits)
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        self.opened = np.cumsum(bits, dtype=np.int64)
        pair = np.zeros(self.n, dtype=np.int64)
        pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.cumsum(pair)
        self._levels = self._minima(self.excess)

    def _minima(self, excess: np.ndarray) -> list[np.ndarray]:
        """Minima of blocks, of pairs of blocks, and so on up to one."""
        high = np.iinfo(np.int64).max
        low = np.append(excess, np.full(-len(excess) % self.BLOCK, high)).reshape(-1, self.BLOCK).min(axis=1) if len(excess) else np.array([high])
        levels = [low]
        while len(low) > 1:
            low = np.append(low, high)[: len(low) + len(low) % 2].reshape(-1, 2).min(axis=1)
            levels.append(low)
        return levels

    def _below(self, excess: np.ndarray, levels: list[np.ndarray], at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each position the first one after it whose excess is at most `most` (there must be one)."""
        out = np.full(len(at), -1, dtype=np.int64)

        def scan(which: np.ndarray, begin: np.ndarray) -> np.ndarray:
            """Look through the rest of the block of `begin`; the queries that found nothing there."""
            begin = begin.copy()
            end = np.minimum((begin // self.BLOCK + 1) * self.BLOCK, self.n)
            while len(which):
                inside = begin < end
                hit = np.zeros(len(which), dtype=bool)
                hit[inside] = excess[begin[inside]] <= most[which[inside]]
                out[which[hit]] = begin[hit]
                if not inside.any():
                    break
                keep = ~hit
                which, begin, end = which[keep], begin[keep] + 1, end[keep]
            return which

        # A block that starts right behind the query is searched through the tree like any other.
        every, begin = np.arange(len(at)), at + 1
        inner = begin % self.BLOCK != 0
        left = np.sort(np.concatenate([scan(every[inner], begin[inner]), every[~inner]]))
        node, level = begin[left] // self.BLOCK - (begin[left] % self.BLOCK == 0), np.zeros(len(left), dtype=np.int64)
        found = np.zeros(len(left), dtype=bool)
        for k, low in enumerate(levels):  # up: the next node to the right, if a left child's sibling reaches low enough
            go = ~found
            nxt = node + 1
            fits = go & (node % 2 == 0) & (nxt < len(low))
            fits[fits] = low[nxt[fits]] <= most[left[fits]]
            node, level, found = np.where(fits, nxt, np.where(go, node // 2, node)), np.where(fits, k, level), found | fits
        for k in range(len(levels) - 1, 0, -1):  # down: the left child if it reaches low enough
            at_level = level == k
            child = node * 2
            goes_left = levels[k - 1][np.where(at_level, child, 0)] <= most[left]
            node, level = np.where(at_level, np.where(goes_left, child, child + 1), node), np.where(at_level, k - 1, level)
        scan(left, node * self.BLOCK)
        return out

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        return self._below(self.excess, self._levels, at, self.excess[at] - 1)

    def enclose(self, at: np.ndarray) -> np.ndarray:
        """The opening parenthesis of the parent of each opening one (not of the root): the same search from the right."""
        back = np.cumsum((1 - self.bits[::-1].astype(np.int64)) * 2 - 1)
        here = self.n - 1 - at
        return self.n - 1 - self._below(back, self._minima(back), here, back[here] - 1)


def turn_key(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, KEY)


def paths_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, path): keys and text sizes of a conversation's turns in order.

    Turns are ordered by turn (null first), then role and text; null role or
    text counts as empty, repeated rows are turns of their own, rows without
    conv_id belong to no conversation.  Only keys are gathered, never texts: a
    conversation takes 20 bytes a turn in its task.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = rows.select("conv_id", F.row_number().over(order).alias("pos"), turn_key(F.col("role"), F.col("text")).alias("key"), F.octet_length("text").alias("size"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "size"))), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size")))
    return turns.groupBy("conv_id").agg(path.alias("path"))


def rebuilt(paths: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Paths that begin with the first h turns of conversation c - c % every (h: crc32 of c as text, modulo `most`), then go on as their own."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = paths.select(F.col("conv_id").alias("base"), F.slice("path", 1, most).alias("head"))
    none = F.array().cast(_PATH)
    joined = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("path", h + 1, F.size("path"))).alias("path"))


def _ends(members: DataFrame) -> DataFrame:
    """Rows (path_key, ends_sha256): hash of all members' ids in order.

    Ids of a path are gathered by stretches of 65 536 values, so never more
    than that at once, and hashed one stretch after another.
    """
    part = members.groupBy("path_key", F.shiftright("conv_id", 16).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches):
        key, sha = None, None
        for b in batches:
            keys, shas = [], []
            for k, ids in zip(b.column("path_key").to_pylist(), b.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["path_key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["path_key", "ends_sha256"])

    return part.repartition("path_key").sortWithinPartitions("path_key", "part").mapInArrow(hashed, "path_key binary, ends_sha256 string")


_SHARD = "shard long, n_bits long, parens binary, keys binary, sizes binary, ends binary, low binary, sha binary"


def _encoded(batches):
    """One row for a partition of ordered distinct paths (path, n, low, ends_sha256): its trie.

    In preorder: keys and text sizes (the root's are 0), how many conversations
    end at a node, their smallest id, and the hash of all of them.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    path = rows.column("path").combine_chunks()
    edges = path.offsets.to_numpy().astype(np.int64)
    items = path.values
    raw = items.field("key").cast(pa.binary(KEY))
    key = np.frombuffer(raw.buffers()[1], dtype=np.uint8)[raw.offset * KEY : (raw.offset + len(raw)) * KEY].reshape(-1, KEY)
    size = items.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.ascontiguousarray(key).view("<u8")
    length = np.diff(edges)
    shared = np.zeros(len(length), dtype=np.int64)
    for i in range(1, len(length)):
        m = min(length[i - 1], length[i])
        same = (words[edges[i - 1] : edges[i - 1] + m] == words[edges[i] : edges[i] + m]).all(axis=1)
        shared[i] = m if same.all() else same.argmin()
    # What opens for each path (the root before all), and what closes behind it.
    opens = length - shared
    opens[0] += 1
    runs = np.empty(2 * len(opens), dtype=np.int64)
    runs[0::2], runs[1::2] = opens, np.append(length[:-1] - shared[1:], length[-1] + 1)
    bits = np.repeat(np.arange(len(runs)) % 2 == 0, runs).astype(np.uint8)
    new = np.arange(edges[-1] - edges[0]) - np.repeat(edges[:-1] - edges[0], length) >= np.repeat(shared, length)
    at = np.flatnonzero(new) + edges[0]
    end = np.cumsum(opens) - 1  # the node at which each path ends
    nodes = 1 + len(at)
    ends, low = np.zeros(nodes, np.int64), np.full(nodes, NO_MEMBER, np.int64)
    ends[end], low[end] = rows.column("n").to_numpy(), rows.column("low").to_numpy()
    sha = np.zeros((nodes, 32), np.uint8)
    sha[end] = np.frombuffer(bytes.fromhex("".join(rows.column("ends_sha256").to_pylist())), np.uint8).reshape(-1, 32)
    whole = lambda x: pa.array([x.tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(bits)], pa.int64()), whole(np.packbits(bits)), whole(np.concatenate([np.zeros((1, KEY), np.uint8), key[at]])),
            pa.array([packed(np.append(0, size[at]), "<i8")], pa.binary()), pa.array([packed(ends, "<i8")], pa.binary()), pa.array([packed(low, "<i8")], pa.binary()), whole(sha),
        ],
        ["shard", "n_bits", "parens", "keys", "sizes", "ends", "low", "sha"],
    )


def _low_between(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the stretches x[a:b], none of them empty, by a table of all stretches of 2^k."""
    table, k = [x], 0
    while 2 << k <= len(x):
        table.append(np.minimum(table[-1][: -(1 << k)], table[-1][1 << k :]))
        k += 1
    level = np.frexp((b - a).astype(float))[1] - 1
    out = np.empty(len(a), dtype=x.dtype)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][a[m]], table[k][b[m] - (1 << int(k))])
    return out


_NODE = "shard long, spine boolean, key binary, above array<binary>, parent_key binary, depth int, size long, low long, parent_low long, n_convs long, n_children long, n_leaves long, saved long, sha string"


def _nodes_of(row: dict) -> pa.RecordBatch:
    """All nodes of a shard; those on its first and last path are spine, with sums that leave the spine itself out."""
    bits = np.unpackbits(np.frombuffer(row["parens"], np.uint8))[: row["n_bits"]]
    p = Parentheses(bits)
    opens = np.flatnonzero(bits)
    n = len(opens)
    close = p.find_close(opens)
    last = np.arange(n) + (close - opens + 1) // 2  # the stretch of the preorder that is a node's subtree
    depth = p.excess[opens] - 1
    parent = np.full(n, -1)
    parent[1:] = p.opened[p.enclose(opens[1:])] - 1
    size, ends, low = (unpacked(row[c], "<i8") for c in ("sizes", "ends", "low"))
    spine = np.zeros(n, dtype=bool)
    spine[: int(np.argmin(bits)) or 1] = True  # the first path is the first run of opening ones
    at = n - 1
    while at >= 0:
        spine[at], at = True, parent[at]
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    inside = lambda x: (lambda t: t[last] - t[:n])(total(x))
    n_convs = inside(ends)
    spine_leaf = spine & (last - np.arange(n) == 1)
    # Rank of "()": pairs that end within the subtree less those before it; leaves of the spine are settled once it is merged.
    leaves = p.pairs[close - 1] - np.where(opens > 0, p.pairs[opens - 1], 0) - inside(spine_leaf)
    saved = inside(np.where(spine, 0, (n_convs - 1) * size))
    children = np.bincount(parent[1:][~spine[1:]], minlength=n)
    least = _low_between(low, np.arange(n), last)
    raw = row["keys"]
    turn = lambda i: raw[i * KEY : (i + 1) * KEY]
    key, above = {0: hashlib.sha256(b"").digest()[:KEY]}, {0: []}
    for i in np.flatnonzero(spine)[1:].tolist():
        up = int(parent[i])
        key[i], above[i] = hashlib.sha256(key[up] + turn(i)).digest()[:KEY], [*above[up], key[up]]
    of_spine = parent >= 0
    of_spine[of_spine] = spine[parent[of_spine]]
    sha = row["sha"]
    shas = [sha[i * 32 : i * 32 + 32].hex() if ends[i] else None for i in range(n)]
    inner = ~spine & ~of_spine
    columns = [
        pa.array(np.full(n, row["shard"])), pa.array(spine), pa.array([key.get(i) for i in range(n)], pa.binary()), pa.array([above.get(i) for i in range(n)], pa.list_(pa.binary())),
        pa.array([key[int(u)] if o else None for u, o in zip(parent, of_spine)], pa.binary()), pa.array(depth.astype(np.int32)), pa.array(size), pa.array(least), pa.array(least[parent], mask=~inner),
        pa.array(n_convs), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(shas, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.strip().split(" ")[0] for c in _NODE.split(", ")])


def _nodes(batches):
    for b in batches:
        for row in b.to_pylist():
            yield _nodes_of(row)


def encode(members: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """Tries of paths (conv_id, path): a row for each shard, written to the shared folder.

    Copies of a path are counted before they are shuffled; shards are ranges of
    distinct paths, so a prefix that many conversations share goes to as many
    shards as it needs.
    """
    path_key = F.unhex(F.sha2(F.array_join(F.transform("path", lambda t: F.hex(t["key"])), ""), 256))
    members = written(members.select("conv_id", "path"), "paths")
    ends = _ends(members.select(path_key.alias("path_key"), "conv_id"))
    paths = members.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).withColumn("path_key", path_key)
    paths = written(paths.join(ends, "path_key").drop("path_key"), "distinct_paths")
    shards = max(1, -(-paths.count() // shard_paths))
    return written(paths.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(_encoded, _SHARD), "shards")


def nodes(shards: DataFrame) -> DataFrame:
    """A row for each node of encoded tries: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    every = written(shards.mapInArrow(_nodes, _NODE), "nodes")
    spine = every.where("spine")
    merged = spine.groupBy("key").agg(
        F.first("above").alias("above"), F.first("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.min("low").alias("low"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("sha").alias("sha"),
    )
    merged = written(merged, "spine")
    kids = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    # What a spine node itself saves, and whether it is a leaf, counts for it and all nodes above.
    own = merged.select(F.explode(F.concat("above", F.array("key"))).alias("key"), ((F.col("n_convs") - 1) * F.col("size")).alias("s"), (F.col("n_children") == 0).cast("long").alias("l"))
    own = own.groupBy("key").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    up = merged.select(F.col("key").alias("parent_key"), F.col("low").alias("up_low"))
    spine_out = merged.join(own, "key").join(up, "parent_key", "left").select(
        "low", "depth", "up_low", "n_convs", "n_children", (F.col("n_leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved"), "sha"
    )
    # The smallest member of a spine node, sent back to each shard that it goes through.
    back = spine.select("shard", "key").join(merged.select("key", F.col("low").alias("up_low")), "key").select("shard", F.col("key").alias("parent_key"), "up_low")
    inner = every.where("not spine and parent_key is null").select("low", "depth", F.col("parent_low").alias("up_low"), "n_convs", "n_children", "n_leaves", "saved", "sha")
    border = every.where("not spine and parent_key is not null").join(back, ["shard", "parent_key"]).select("low", "depth", "up_low", "n_convs", "n_children", "n_leaves", "saved", "sha")
    out = inner.unionByName(border).unionByName(spine_out)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return out.select(
        long("low", "conv_id"), long("depth", "depth"), long("up_low", "parent_conv_id"), long("n_convs", "n_convs"), long("n_children", "n_children"), long("n_leaves", "n_leaves"),
        long("saved", "saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def prefix_nodes(conversations: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations; without any conversation there is no node, not even a root.

    A node is told by its smallest member and its depth.  Columns other than
    conv_id, turn, role and text are ignored, whatever their names.
    """
    return nodes(encode(rebuilt(written(paths_of(conversations), "conversations")), shard_paths))
