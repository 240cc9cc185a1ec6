"""The prefix trie of conversations, one balanced-parentheses sequence per shard, shared spines merged.

Conversations are ordered by their path (the digests of their turns, one after the other) and cut into shards by ranges of
(path, conv_id), so a group of equal conversations of any size is spread like everything else. A shard writes its part of
the trie as parentheses in preorder. `Parentheses` finds where subtrees close through a tree of block minima of the
excess; leaves are counted by ranks of "()", sums over subtrees are differences of cumulative arrays.

In this order a node can only lie in several shards if it lies on the path of a shard's first or last conversation. These
nodes, the spine, leave the shard as partial values and are merged by key: first members, then what the spine itself adds
to its ancestors (each spine node counts in the first shard that has it, and sums run up a shard's two boundary paths).
All other nodes are final in their shard. So no node, however many members it has, needs its members in one place; only
the ids that end at one node pass through one task, as chunks of text for the digest.

Two turns are the same if role and text are (by a 128-bit digest of both). Cases: null role or text count as empty; rows
without a conv_id belong to no conversation; rows of one turn go by role and text digest; repeated rows are turns of
their own; conversations without turns (after rebuilding) are members of the root; an empty table has no node, not even
the root; extra columns are ignored. A conversation's digests (about 40 bytes a turn, not its texts) form one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.text import stored

#: Hex digits of a turn's digest.
WIDTH = 32


class Parentheses:
    """A sequence of parentheses (1 opens, -1 closes) with minima of the excess by blocks and pairs of blocks above them."""

    def __init__(self, steps: np.ndarray, block: int = 64):
        self.steps, self.block = steps, block
        self.excess = np.cumsum(steps, dtype=np.int64)
        high = np.iinfo(np.int64).max
        n = max(1, -(-len(steps) // block))
        self.rows = np.full(n * block, high, np.int64)
        self.rows[: len(steps)] = self.excess
        self.rows = self.rows.reshape(n, block)
        levels = [self.rows.min(axis=1)]
        while len(levels[-1]) > 1:
            low = levels[-1] if len(levels[-1]) % 2 == 0 else np.r_[levels[-1], high]
            levels[-1] = low
            levels.append(low.reshape(-1, 2).min(axis=1))
        self.minima, self.offset = np.concatenate(levels), np.cumsum([0, *map(len, levels)])

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at `at` close."""
        out = np.full(len(at), -1, np.int64)
        target, home = self.excess[at] - 1, at // self.block
        for k in range(0, len(at), 1 << 14):  # in its own block?
            part = slice(k, k + (1 << 14))
            hit = (self.rows[home[part]] <= target[part, None]) & (np.arange(self.block) > (at[part] % self.block)[:, None])
            first = hit.argmax(axis=1)
            out[part] = np.where(hit.any(axis=1), home[part] * self.block + first, -1)
        left = np.flatnonzero(out < 0)
        node, level = home[left] + 1, np.zeros(len(left), np.int64)
        climbing = np.ones(len(left), bool)
        while climbing.any():  # to the first block, or pair of pairs of blocks, that gets low enough
            low = self.minima[self.offset[level] + node] <= target[left]
            up = climbing & ~low & (node % 2 == 1)
            climbing &= ~low
            node = np.where(climbing, node + 1, node)
            node, level = np.where(up, node // 2, node), np.where(up, level + 1, level)
        while (level > 0).any():  # and down to its first block that does
            down = level > 0
            node, level = np.where(down, node * 2, node), np.where(down, level - 1, level)
            node += down & (self.minima[self.offset[level] + node] > target[left])
        hit = self.rows[node] <= target[left, None]
        out[left] = node * self.block + hit.argmax(axis=1)
        return out

    def leaf_rank(self) -> np.ndarray:
        """How many "()" begin at or before each place."""
        return np.cumsum((self.steps == 1) & np.r_[self.steps[1:] == -1, False])


def rebuilt(conversations: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """conv_id, path (string), sizes (code points by turn): the first `head` turns (at most `most`) of the conversation
    `base`, then the conversation's own after its first `head`. head and base are expressions of conv_id."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", key.alias("key"), F.length(text).alias("size")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    heads = whole.select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("head")).join(whole.select(base.alias("base")).distinct(), "base", "left_semi")
    both = whole.select("conv_id", "own", base.alias("base"), head.alias("h")).join(heads, "base", "left")
    path = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return both.select("conv_id", path.alias("p")).select("conv_id", F.array_join(F.transform("p", lambda t: t["key"]), "").alias("path"), F.transform("p", lambda t: t["size"]).alias("sizes"))


FIELDS = (
    ("kind", "string"), ("shard", "int"), ("side", "int"), ("common", "int"), ("key", "string"), ("parent_key", "string"), ("depth", "bigint"), ("conv_id", "bigint"), ("parent_conv_id", "bigint"),
    ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("n_chars", "bigint"), ("childless", "boolean"), ("ends", "string"),
)


def shard_nodes(ordered: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Rows of three kinds of every partition of `ordered` (conv_id, path, sizes; sorted by path and conv_id): `node`, final;
    `spine`, partial, without what spine nodes themselves add; `ends`, ids that end at a spine node, in order, in chunks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        ids, depth, parent, chars, first_row, ends, steps, opened = [], [0], [-1], [0], [0], [[]], [1], [0]
        stack, path, first_path = [0], "", None
        for batch in batches:
            for conv, p, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes"))):
                first_path = p if first_path is None else first_path
                same = min(len(p), len(path)) // WIDTH
                if p[: same * WIDTH] != path[: same * WIDTH]:
                    low, high = 0, same
                    while high - low > 1:  # the longest common beginning, in whole turns
                        mid = (low + high) // 2
                        low, high = (mid, high) if p[: mid * WIDTH] == path[: mid * WIDTH] else (low, mid)
                    same = low
                steps += [-1] * (len(stack) - 1 - same)
                del stack[same + 1 :]
                for d in range(same, len(sizes)):
                    opened.append(len(steps))
                    steps.append(1)
                    parent.append(stack[-1])
                    stack.append(len(depth))
                    depth.append(d + 1)
                    chars.append(sizes[d])
                    first_row.append(len(ids))
                    ends.append([])
                ends[stack[-1]].append(conv)
                ids.append(conv)
                path = p
        if first_path is None:
            return
        steps += [-1] * len(stack)
        yield from _rows(shard, first_path, path, *(np.array(x, np.int64) for x in (ids, depth, parent, chars, first_row, opened)), ends, Parentheses(np.array(steps, np.int8)), chunk)

    return ordered.mapInArrow(encode, ", ".join(f"{n} {t}" for n, t in FIELDS))


def _rows(shard: int, first: str, last: str, ids, depth, parent, chars, first_row, opened, ends, tree: Parentheses, chunk: int) -> Iterator[pa.RecordBatch]:
    n = len(depth)
    close = tree.find_close(opened)
    until = np.cumsum(tree.steps == 1)[close]  # nodes are numbered in preorder: a subtree is number .. until - 1
    own = np.arange(n)
    sums = lambda x: np.r_[0, np.cumsum(x)][until] - np.r_[0, np.cumsum(x)][own]
    n_convs = sums(np.fromiter(map(len, ends), np.int64, n))
    row_end = first_row + n_convs
    lowest = np.minimum.reduceat(np.r_[ids, np.iinfo(np.int64).max], np.c_[first_row, row_end].ravel())[::2]

    # the spine: what lies on the first or the last path
    on, side = np.zeros(n, bool), np.zeros(n, np.int64)
    on[: len(first) // WIDTH + 1] = True  # in preorder the first path comes first
    at = n - 1
    while depth[at] > len(last) // WIDTH:
        at = parent[at]
    tail = []
    while at >= 0:
        tail.append(at)
        at = parent[at]
    fresh = [v for v in tail if not on[v]]
    on[fresh], side[fresh] = True, 1
    common = len(tail) - len(fresh) - 1

    leaf_rank = tree.leaf_rank()
    childless = close == opened + 1
    leaves = leaf_rank[close] - leaf_rank[opened] + childless
    closed = ~on
    saved = sums(np.where(closed, (n_convs - 1) * chars, 0))
    leaves = leaves - sums(on & childless)
    children = np.bincount(parent[1:], weights=closed[1:], minlength=n).astype(np.int64)  # of the spine: those that are closed
    children = np.where(on, children, np.bincount(parent[1:], minlength=n))

    keys: dict[int, str] = {}
    for route in (first, last):
        m, v = hashlib.md5(), 0
        keys[0] = m.hexdigest()
        walk = range(len(first) // WIDTH + 1) if route is first else tail[::-1]
        for d, v in enumerate(walk):
            if d:
                m.update(route[(d - 1) * WIDTH : d * WIDTH].encode())
                keys[int(v)] = m.hexdigest()
    up = parent.tolist()
    spine = on.tolist()
    texts = [None if spine[v] else hashlib.sha256(",".join(map(str, ends[v])).encode()).hexdigest() for v in range(n)]
    listed = lambda x, t=pa.int64(): pa.array(x, t)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        m = b - a
        yield pa.RecordBatch.from_arrays(
            [
                listed(["spine" if s else "node" for s in spine[a:b]], pa.string()), listed([shard] * m, pa.int32()), listed(side[a:b].astype(np.int32), pa.int32()), listed([common] * m, pa.int32()),
                listed([keys.get(v) for v in range(a, b)], pa.string()), listed([keys.get(u) for u in up[a:b]], pa.string()), listed(depth[a:b]), listed(lowest[a:b]),
                listed([None if u < 0 or spine[u] else int(lowest[u]) for u in up[a:b]]), listed(n_convs[a:b]), listed(children[a:b]), listed(leaves[a:b]), listed(saved[a:b]), listed(chars[a:b]),
                listed(childless[a:b], pa.bool_()), listed(texts[a:b], pa.string()),
            ],
            [f for f, _ in FIELDS],
        )
    parts = [(v, k, ",".join(map(str, ends[v][k : k + chunk]))) for v in np.flatnonzero(on).tolist() for k in range(0, len(ends[v]), chunk)]
    if parts:
        m, null = len(parts), lambda t: pa.nulls(len(parts), t)
        yield pa.RecordBatch.from_arrays(
            [
                listed(["ends"] * m, pa.string()), listed([shard] * m, pa.int32()), null(pa.int32()), null(pa.int32()), listed([keys[v] for v, _, _ in parts], pa.string()), null(pa.string()),
                listed([k for _, k, _ in parts]), *[null(pa.int64())] * 7, null(pa.bool_()), listed([t for _, _, t in parts], pa.string()),
            ],
            [f for f, _ in FIELDS],
        )


def _ends_digest(chunks: DataFrame) -> DataFrame:
    """key, ends: the digest of each spine node's ids, fed chunk by chunk in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if h:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["key", "ends"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends"])

    return chunks.select("key", "shard", "depth", "ends").repartition("key").sortWithinPartitions("key", "shard", "depth").mapInArrow(digest, "key string, ends string")


def trie(conversations: DataFrame, head: Column, base: Column, most: int, shard_turns: int = 100_000) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. shard_turns: about how many turns a shard holds."""
    spark = conversations.sparkSession
    routes = stored(rebuilt(conversations, head, base, most), "routes")
    total = routes.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))
    made = stored(shard_nodes(routes.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")), "nodes")

    spine = made.where("kind = 'spine'")
    merged = spine.groupBy("key").agg(
        F.sum("n_convs").alias("all_convs"), F.min("conv_id").alias("all_min"), F.min("childless").alias("bare"), F.min("shard").alias("owner"), F.sum("n_children").alias("closed_children"))
    kids = spine.where("parent_key IS NOT NULL").select("key", "parent_key").distinct().groupBy("parent_key").agg(F.count("*").alias("spine_children")).withColumnRenamed("parent_key", "key")
    known = spine.join(merged, "key")
    mine = F.col("shard") == F.col("owner")
    adds = known.withColumns({"own_leaf": (mine & F.col("bare")).cast("long"), "own_saved": F.when(mine, (F.col("all_convs") - 1) * F.col("n_chars")).otherwise(0)})
    upward, whole = Window.partitionBy("shard", "side").orderBy(F.desc("depth")), Window.partitionBy("shard")
    run = lambda c: F.sum(c).over(upward) + F.when((F.col("side") == 0) & (F.col("depth") <= F.col("common")), F.coalesce(F.sum(F.when(F.col("side") == 1, F.col(c))).over(whole), F.lit(0))).otherwise(0)
    summed = adds.withColumns({"leaves": F.col("n_leaves") + run("own_leaf"), "saved": F.col("saved_tokens") + run("own_saved")})
    final = summed.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("all_min").alias("conv_id"), F.first("all_convs").alias("n_convs"), F.first("closed_children").alias("closed_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    above = merged.select(F.col("key").alias("parent_key"), F.col("all_min").alias("parent_conv_id"))
    no_ids = F.lit(hashlib.sha256(b"").hexdigest())
    top = final.join(kids, "key", "left").join(_ends_digest(made.where("kind = 'ends'")), "key", "left").join(above, "parent_key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("closed_children") + F.coalesce("spine_children", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", no_ids).alias("ends_sha256"))
    # nodes right below the spine get their parent's smallest member from the spine of their own shard
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    nodes = made.where("kind = 'node'")
    below = nodes.where("parent_key IS NOT NULL").drop("parent_conv_id").join(known.select("shard", F.col("key").alias("parent_key"), F.col("all_min").alias("parent_conv_id")), ["shard", "parent_key"])
    return top.unionByName(nodes.where("parent_key IS NULL").select(*columns)).unionByName(below.select(*columns))
