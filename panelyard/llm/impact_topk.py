"""Exact top-k inner products by an impact-ordered index, processed score at a time.

Vectors are integers. A shard of vectors is indexed by segments: all postings of one dimension whose values fall into
one level of quantised impact. For a block of queries the segments are processed by descending impact, adding the
level's middle value to accumulators. What is not yet processed can add at most the next level's impact times the
query's weights left over, and what is processed is off by at most half a level's width; once the upper bound of every
other vector is below the k-th best lower bound, the rest cannot matter: only the possible members are then scored
exactly. Shards and query blocks meet by a shuffle on the shard number.

Vectors with components so large that sums of doubles could be inexact are not indexed: their scores are computed one
by one, as long or, where those could overflow, as Python integers. So every score is exact at any size; one that does
not fit a long is ranked by its true value and given as the nearest long.

Cases: a vector that is null, or holds a null or a component that is not finite (or whose quantised value is no long,
where SQL fails), takes no part; shorter vectors count as padded with zeros; rows with the same vec_id as
the query are its own and no candidates; a repeated query row gives its result once; an empty table gives an empty
result; extra columns are ignored; rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantised values below this can be indexed, as far as the number of dimensions lets sums of doubles stay exact.
LIMIT = 1 << 20
LONG = 1 << 63


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null if the vector takes no part."""
    values = F.transform(embedding, lambda x: x.cast("double") * scale)
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -float(LONG)) & (x < float(LONG)))
    return F.when(embedding.isNotNull() & fine, F.transform(values, lambda x: F.floor(x).cast("long")))


class ImpactIndex:
    """Postings of one shard by segments, (impact bound, level value, dimension, rows), in eight steps of descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = 12):
        self.ids, self.vectors = ids, vectors
        self.width = max(1, -(-int(np.abs(vectors).max(initial=0) + 1) // levels))
        level = vectors // self.width  # a posting's value lies in [level * width, level * width + width - 1]
        segments = []
        for d in range(vectors.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            found, first = np.unique(level[order, d], return_index=True)
            for value, rows in zip(found.tolist(), np.split(order, first[1:])):
                low, high = value * self.width, value * self.width + self.width - 1
                segments.append((max(abs(low), abs(high)), (low + high) / 2, d, rows))
        segments.sort(key=lambda s: -s[0])
        ends = np.linspace(0, len(segments), 9).astype(int)[1:]
        self.bounds = [segments[e][0] if e < len(segments) else 0 for e in ends]  # of what is left after a step
        middle, step = np.zeros(vectors.shape), np.zeros(vectors.shape, np.int8)
        for i, (_, value, d, rows) in enumerate(segments):
            middle[rows, d], step[rows, d] = value, np.searchsorted(ends, i, "right")
        # of each step: the postings' middle values, and which postings these are (dimensions, rows)
        self.steps = [(np.where(step == j, middle, 0).T.copy(), (step == j).astype(np.float64).T.copy()) for j in range(len(ends))]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of the k best of this shard for each query, ties to the smaller id."""
        n, q = len(self.ids), len(queries)
        weights = queries.astype(np.float64)  # (queries, dimensions)
        sizes = np.abs(weights)
        score, left = np.zeros((q, n)), np.repeat(sizes.sum(axis=1)[:, None], n, axis=1)
        slack = sizes.sum(axis=1, keepdims=True) * (self.width - 1) / 2
        out: list = [None] * q
        live = np.arange(q)
        own_row = own[:, None] == self.ids[None, :]
        for i, (bound, (middle, now)) in enumerate(zip(self.bounds, self.steps)):
            if not len(live):
                break
            score += weights[live] @ middle  # the segments of a step as one product: sums are exact in any order
            left -= sizes[live] @ now
            reach = bound * left + slack[live]
            low = score - reach
            low[own_row[live]] = -np.inf
            kth = np.partition(low, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(live), 1), -np.inf)
            possible = (score + reach >= kth) & ~own_row[live]
            # the proof: whoever is not possible is below k others; stop where the possible are few, or all is processed
            done = possible.sum(axis=1) <= max(4 * k, n // 64)
            if i + 1 == len(self.bounds):
                done[:] = True
            for c in np.flatnonzero(done):
                some = np.flatnonzero(possible[c])
                exact = self.vectors[some] @ queries[live[c]]
                best = np.lexsort((self.ids[some], -exact))[:k]
                out[live[c]] = (exact[best], self.ids[some][best])
            if done.any():
                score, left, live = score[~done], left[~done], live[~done]
        return [x if x is not None else (np.empty(0, np.int64), np.empty(0, np.int64)) for x in out]


def exact_top(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same as ImpactIndex.top, from all scores, at any size of the values; scores are Python integers if need be."""
    most = np.abs(vectors.astype(np.float64)).max(initial=0) * np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)
    kind = np.int64 if most < LONG // 2 else object
    scores = queries.astype(kind) @ vectors.T.astype(kind)
    out = []
    for row, q in zip(scores, own):
        some = np.flatnonzero(ids != q)
        if kind is object:
            best = np.array(sorted(some.tolist(), key=lambda i: (-row[i], ids[i]))[:k], np.int64)
        else:
            best = some[np.lexsort((ids[some], -row[some]))[:k]]
        out.append((row[best], ids[best]))
    return out


def small(vectors: np.ndarray) -> np.ndarray:
    """Whether each vector can be indexed: with such queries all sums stay below 2**51, in halves, so exact in doubles."""
    limit = min(float(LIMIT), (2.0**51 / max(1, vectors.shape[1])) ** 0.5)
    return np.abs(vectors.astype(np.float64)).max(axis=1, initial=0) < limit


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = rows.flatten()
    sizes = vectors.value_lengths().to_numpy()
    m = np.zeros((len(ids), max(1, sizes.max(initial=0))), np.int64)
    m[np.arange(m.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return np.array(ids), m


def _sized(matrix: np.ndarray, size: int) -> np.ndarray:
    """With so many columns; those left out would meet zeros only."""
    return np.pad(matrix[:, :size], ((0, 0), (0, max(0, size - matrix.shape[1]))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, shard_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product with each query.

    Both inputs: vec_id, embedding. Every query meets every shard, in blocks: a task has a shard's rows, indexes them once, and
    then reads one block after the other. The blocks go there by a shuffle, as their copies for all shards are many times what
    a join could take for their size, and send to the driver."""

    def packed(df: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
        some = df.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), scale).alias("v")).where("id is not null and v is not null")
        parts = 1 + some.count() // rows
        dealt = some.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(parts, name)
        return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias("rows")), parts

    shards, n = packed(vectors, "shard", shard_rows)
    blocks, _ = packed(queries.dropDuplicates(["vec_id"]), "block", query_rows)
    copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), "block", "rows")
    met = shards.select("shard", F.lit(-1).alias("block"), "rows").union(copies).repartition(n, "shard").sortWithinPartitions("shard", "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for shard, block, rows in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), batch["rows"]):
                own, wanted = _matrix(rows.values)
                if block < 0:  # a shard's own rows are the first with its number
                    at, ids, matrix = shard, own, wanted
                    plain = small(matrix)
                    index = ImpactIndex(ids[plain], matrix[plain])
                if block < 0 or shard != at:  # a number that no row has
                    continue
                wanted = _sized(wanted, matrix.shape[1])
                asked = small(wanted)
                pairs = []
                for a in range(0, len(own), 128):
                    some, of, few = wanted[a : a + 128], own[a : a + 128], asked[a : a + 128]
                    if few.any() and plain.any():
                        pairs += zip(of[few], index.top(some[few], of[few], k))
                    if few.any() and not plain.all():
                        pairs += zip(of[few], exact_top(ids[~plain], matrix[~plain], some[few], of[few], k))
                    if not few.all():
                        pairs += zip(of[~few], exact_top(ids, matrix, some[~few], of[~few], k))
                scores = [int(x) for _, (s, _) in pairs for x in s]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": [int(q) for q, (s, _) in pairs for _ in s], "vec_id": [int(x) for _, (_, v) in pairs for x in v], "score": [max(-LONG, min(LONG - 1, x)) for x in scores],
                        "high": [x >> 96 for x in scores], "middle": [(x >> 48) & ((1 << 48) - 1) for x in scores], "low": [x & ((1 << 48) - 1) for x in scores],
                    }, pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score", "high", "middle", "low")]),
                )

    found = met.mapInArrow(score, "query_id bigint, vec_id bigint, score bigint, high bigint, middle bigint, low bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
