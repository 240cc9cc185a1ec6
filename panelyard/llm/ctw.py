"""Language-model scores by context-tree weighting over bytes.

Each byte (of the lower-cased text, then one end symbol) is eight binary decisions. For each decision and each context
of the last 0..depth bytes, training counts of both outcomes give a Krichevsky-Trofimov estimate; context-tree weighting
mixes the estimates of all depths: a node's block probability is the even mix of its own and the product of its
children's, and the trained tree predicts with the mix of the estimates along the context's path, weighted by what each
depth explained of the training data. With the tree fixed, the probability of a byte depends on its last `depth` bytes
alone, so scoring is a walk through a table of contexts.

All training text is counted, as sums of (depth + 1)-byte strings (grams), and every context of it has its nodes. A gram
is written with its context's last byte first, so that the subtree below the last `TOP` bytes is a range of grams, which
one task builds; what lies above is summed and built at the driver, where its size does not grow with the corpus (at most
255 nodes for each of 256 ** (TOP - 1) contexts). The tree is kept as a stored table of the probability of each gram.

Scoring looks up the commonest grams (at most `max_contexts`, whatever the corpus) in a broadcast table, and joins all
others to the stored one; grams that training never saw are walked down the tree as far as their context is known. Which
grams are broadcast changes the speed, not the result.

The base score is a word unigram with one added. Words of at least 1/`max_words` of all training tokens (so at most
`max_words` of them) are looked up in a broadcast table; all other words are joined by hash.

Cases: a null text counts as empty and is scored as its end symbol; without training rows every symbol has probability
1/256 or, for the base, 1/1; repeated rows are scored alike and trained on each time; rows with a null id are
never trained on; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.text import as_long, hash_words, lower_ascii, pieces, stored

END = 255  # never a byte of UTF-8 text; before the text and after it


@dataclass
class Model:
    """child[n, b]: the context that n and one byte further back make (n itself if there is none); logp[n, b]: log10
    probability of the next byte in context n. Context 0 is the empty one."""

    depth: int
    child: np.ndarray
    logp: np.ndarray

    def symbols(self, text: bytes) -> np.ndarray:
        """log10 probability of each byte of the text and of its end."""
        raw = np.frombuffer(bytes([END]) * self.depth + lower_ascii(text) + bytes([END]), np.uint8).astype(np.int32)
        n, child = len(raw) - self.depth, self.child.ravel()
        at = np.take(child, raw[self.depth - 1 : self.depth - 1 + n])  # of the empty context
        deepest = at != 0
        for d in range(2, self.depth + 1):
            further = np.take(child, (at << 8) + raw[self.depth - d : self.depth - d + n])
            deepest &= further != at
            np.copyto(at, further, where=deepest)
        return np.take(self.logp.ravel(), (at << 8) + raw[self.depth :])


def _grams(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (first byte highest) and counts of all strings of `size` symbols, the texts having ends around them."""
    gap = bytes([END]) * (size - 1)
    raw = np.frombuffer(gap + b"".join(lower_ascii(t) + gap for t in texts), np.uint8)
    n = len(raw) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.zeros(n, np.uint64)
    for j in range(size):
        key = (key << np.uint64(8)) | raw[j : j + n]
    # each text's strings end on its bytes and on its first end symbol, not on the ends that follow
    last_two_end = (key & np.uint64(0xFFFF)) == np.uint64(0xFFFF)
    return np.unique(key[~last_two_end], return_counts=True)


def _turned(grams: np.ndarray, depth: int) -> np.ndarray:
    """The same grams with the bytes of their contexts in reverse, so that the contexts of one suffix are a range."""
    out = np.zeros(len(grams), np.uint64)
    for j in range(1, depth + 1):
        out = (out << np.uint64(8)) | ((grams >> np.uint64(8 * j)) & np.uint64(255))
    return (out << np.uint64(8)) | (grams & np.uint64(255))


def gram_counts(train: DataFrame, depth: int) -> DataFrame:
    """(gram, n) over all training texts (column text, binary), contexts turned. A text's first symbol after nothing but ends is kept by
    `_grams` unless the text is empty; the end of an empty text is counted apart, as the gram of ends alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
        keys, sums, empty = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            empty += sum(not t for t in texts)
            k, c = _grams([t for t in texts if t], depth + 1)
            both = np.concatenate([keys, _turned(k, depth)])
            keys, inverse = np.unique(both, return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([sums, c]), len(keys)).astype(np.int64)
            if len(keys) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(sums)], schema=schema)
                keys, sums = keys[:0], sums[:0]
        if empty:
            keys, sums = np.append(keys, np.uint64((1 << 8 * (depth + 1)) - 1)), np.append(sums, empty)
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(as_long(keys[k : k + 100_000])), pa.array(sums[k : k + 100_000])], schema=schema)

    return train.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x >= 1/2: eight steps up, then Stirling's series."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _kt(a: np.ndarray, b: np.ndarray, rows: int = 512) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones, some rows at a time."""
    out = np.empty(a.shape)
    for k in range(0, len(a), rows):
        x, y = a[k : k + rows], b[k : k + rows]
        seen = (x + y) > 0
        out[k : k + rows] = 0.0
        x, y = x[seen], y[seen]
        out[k : k + rows][seen] = _log_gamma(x + 0.5) + _log_gamma(y + 0.5) - _log_gamma(x + y + 1.0) - log(np.pi)
    return out


def build(grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> Model:
    """The trained tree as tables in memory, for small trees and for tests. Decision nodes of a byte are 1..255: 1, then twice the node plus the bit."""
    contexts = {d: np.unique(np.append(grams[d][0], 0) if not d else grams[d][0]) for d in range(depth + 1)}
    for d in range(1, depth + 1):  # a context needs all its suffixes
        contexts[d] = contexts[d][np.isin(contexts[d] & ((1 << 8 * (d - 1)) - 1), contexts[d - 1])]
    weight, p_own, p_other = {}, {}, {}
    deeper: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for d in range(depth, -1, -1):
        context, byte, n = grams[d]
        keep = np.isin(context, contexts[d])
        row, byte, n = np.searchsorted(contexts[d], context[keep]), byte[keep], n[keep].astype(np.float64)
        zeros, ones = (np.zeros((len(contexts[d]), 256)) for _ in range(2))
        for bit in range(8):
            at = row * 256 + ((1 << bit) | (byte >> (8 - bit)))
            one = ((byte >> (7 - bit)) & 1).astype(bool)
            for counts, mask in ((zeros, ~one), (ones, one)):
                counts += np.bincount(at[mask], n[mask], counts.size).reshape(counts.shape)
        block = own = _kt(zeros, ones)
        p_own[d] = ((ones + 0.5) / (zeros + ones + 1.0)).astype(np.float32)
        p_other[d], weight[d] = p_own[d], np.ones(own.shape, np.float32)
        if deeper is not None and len(contexts[d + 1]):
            # the children of a context are its extensions; all that have no context of their own are one child more
            parent = np.searchsorted(contexts[d], contexts[d + 1] & ((1 << 8 * d) - 1))
            za, oa = zeros.copy(), ones.copy()
            np.subtract.at(za, parent, deeper[1])
            np.subtract.at(oa, parent, deeper[2])
            below = _kt(za, oa)
            np.add.at(below, parent, deeper[0])
            top = np.maximum(own, below)
            block = top + np.log(0.5 * np.exp(own - top) + 0.5 * np.exp(below - top))
            leaf = ~np.isin(np.arange(len(contexts[d])), parent)
            block[leaf] = own[leaf]
            weight[d] = np.exp(log(0.5) + own - block).astype(np.float32)
            weight[d][leaf] = 1.0
            p_other[d] = np.where(za + oa > 0, (oa + 0.5) / (za + oa + 1.0), p_own[d]).astype(np.float32)
        deeper = (block, zeros, ones)
    size = np.cumsum([0, *(len(contexts[d]) for d in range(depth + 1))])
    child = np.repeat(np.arange(size[-1], dtype=np.int32)[:, None], 256, axis=1)
    logp = np.zeros((size[-1], 256), np.float32)
    symbols = np.arange(256)
    for d in range(depth + 1):
        # node by node: this depth's estimate by its weight, the rest of the weight to what lies deeper
        above, left = np.float32(0), np.float32(1)
        if d:
            parent = np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 8 * (d - 1)) - 1))
            above, left = mixed[parent], rest[parent]
            child[size[d - 1] + parent, contexts[d] >> (8 * (d - 1))] = size[d] + np.arange(len(contexts[d]))
        mixed, rest = above + left * weight[d] * p_own[d], left * (1 - weight[d])
        # where the walk ends here, what is left falls to the estimate of all extensions without a context of their own
        final = np.clip(mixed + rest * p_other[d], 1e-12, 1 - 1e-7)
        total = np.zeros((len(contexts[d]), 256))
        for bit in range(8):
            node = (1 << bit) | (symbols >> (8 - bit))
            p = final[:, node]
            total += np.log10(np.where((symbols >> (7 - bit)) & 1, p, 1 - p))
        logp[size[d] : size[d + 1]] = total
    return Model(depth, child, logp)


#: Bytes of context that a subtree of one task has in common.
TOP = 3
#: Grams that a task builds at once (and what is left of the last subtree).
CHUNK = 200_000


def _parent(node: np.ndarray, bit: int) -> np.ndarray:
    """The node of the same bits whose context lacks the oldest byte. A node is its turned context, then `bit` bits."""
    return ((node >> (bit + 8)) << bit) | (node & ((1 << bit) - 1))


def _sums(group: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, inverse = np.unique(group, return_inverse=True)
    return found, *(np.bincount(inverse, v, len(found)) for v in values)


def _weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block probability (log), weight of the own estimate, and that estimate of each node; below: its children's
    blocks, None for the deepest."""
    own = _kt(zeros, ones, 1 << 16)
    block = own if below is None else np.logaddexp(own, below) + log(0.5)
    weight = np.ones(len(own)) if below is None else np.exp(log(0.5) + own - block)
    return block, weight, (ones + 0.5) / (zeros + ones + 1.0)


def _subtrees(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[dict, list]:
    """For each depth from `top` and each bit (nodes, weights, estimates), and (nodes, zeros, ones, blocks) of `top`.

    key: sorted grams of whole subtrees, n: how often each was trained on."""
    levels: dict[int, list] = {}
    deeper: list | None = None
    for d in range(depth, top - 1, -1):
        if d < depth:
            key, n = _sums(_parent(key, 8), n)
        levels[d], now = [], []
        for bit in range(8):
            prefix = key >> (8 - bit)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])[: len(key)]
            nodes = prefix[first]
            ones = np.add.reduceat(n * ((key >> (7 - bit)) & 1), first) if len(first) else np.empty(0)
            zeros = np.add.reduceat(n, first) - ones if len(first) else np.empty(0)
            below = None if deeper is None else np.bincount(np.searchsorted(nodes, _parent(deeper[bit][0], bit)), deeper[bit][3], len(nodes))
            block, weight, p = _weighted(zeros, ones, below)
            levels[d].append((nodes, weight, p))
            now.append((nodes, zeros, ones, block))
        deeper = now
    return levels, deeper


def _walk(key: np.ndarray, levels: dict, depth: int) -> np.ndarray:
    """log10 probability of each gram's last byte after its context: node by node each depth's estimate by its weight;
    where the context is not known further, what is left falls to the last estimate."""
    total, byte, seen = np.zeros(len(key)), key & 255, {}
    for bit in range(8):
        mixed, rest, last = np.zeros(len(key)), np.ones(len(key)), np.full(len(key), 0.5)
        for d in range(depth + 1):
            nodes, weight, p = levels[d][bit]
            node = ((key >> (8 * (depth - d + 1))) << bit) | (byte >> (8 - bit))
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            there = nodes[at] == node if len(nodes) else np.zeros(len(key), bool)
            w, q = np.full(len(key), 1.0 if d == depth else 0.5), np.full(len(key), 0.5)
            w[there], q[there] = weight[at[there]], p[at[there]]
            on = seen.setdefault(d, there)  # nodes before the first bit are the contexts themselves
            mixed[on] += (rest * w * q)[on]
            last[on] = q[on]
            rest[on] *= 1 - w[on]
        final = np.clip(mixed + rest * last, 1e-12, 1 - 1e-7)
        total += np.log10(np.where((byte >> (7 - bit)) & 1, final, 1 - final))
    return total


def _whole(batches: Iterator[pa.RecordBatch], depth: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, n) of a sorted partition, some whole subtrees at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shift, size = 8 * (depth - top + 1), 0
    for batch in batches:
        held.append((batch.column("gram").to_numpy(), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            key, n = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key >> shift, key[-1] >> shift))
            if cut:
                yield key[:cut], n[:cut].astype(np.float64)
            held, size = [(key[cut:], n[cut:])], len(key) - cut
    if size:
        key, n = (np.concatenate(x) for x in zip(*held))
        yield key, n.astype(np.float64)


def _by_subtree(grams: DataFrame, depth: int, top: int) -> DataFrame:
    return grams.select("gram", "n").repartition(F.shiftright("gram", 8 * (depth - top + 1))).sortWithinPartitions("gram")


def upper_levels(counts: DataFrame, depth: int) -> dict[int, list]:
    """(nodes, weights, estimates) of each bit for the depths above the subtrees."""
    top = min(TOP, depth)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole(batches, depth, top):
            for bit, (nodes, zeros, ones, block) in enumerate(_subtrees(key, n, depth, top)[1]):
                node, *rest = _sums(_parent(nodes, bit), zeros, ones, block)
                yield pa.RecordBatch.from_pydict({"bit": np.full(len(node), bit, np.int32), "node": node, "zeros": rest[0], "ones": rest[1], "below": rest[2]})

    parts = _by_subtree(counts, depth, top).mapInArrow(sums, "bit int, node bigint, zeros double, ones double, below double")
    found = parts.groupBy("bit", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow().sort_by("node")
    levels: dict[int, list] = {d: [] for d in range(top)}
    bits = found["bit"].to_numpy()
    for bit in range(8):
        nodes, zeros, ones, below = (found[c].to_numpy()[bits == bit] for c in ("node", "zeros", "ones", "below"))
        for d in range(top - 1, -1, -1):
            block, weight, p = _weighted(zeros, ones, below)
            levels[d].append((nodes, weight, p))
            nodes, zeros, ones, below = _sums(_parent(nodes, bit), zeros, ones, block)
    return levels


def gram_logs(grams: DataFrame, upper: dict[int, list], depth: int, unseen: bool = False) -> DataFrame:
    """(gram, n, logp): log10 probability of the last byte of each gram, or of those alone that were never trained on."""
    top = min(TOP, depth)
    shared = grams.sparkSession.sparkContext.broadcast(upper)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole(batches, depth, top):
            levels = shared.value | _subtrees(key[n > 0], n[n > 0], depth, top)[0]
            if unseen:
                key, n = key[n == 0], n[n == 0]
            for k in range(0, len(key), 50_000):
                some = key[k : k + 50_000]
                yield pa.RecordBatch.from_pydict({"gram": some, "n": n[k : k + 50_000].astype(np.int64), "logp": _walk(some, levels, depth)})

    return _by_subtree(grams, depth, top).mapInArrow(logs, "gram bigint, n bigint, logp double")


def commonest(logs: DataFrame, most: int) -> int:
    """The count from which at most `most` grams are; counts are told apart by sixteenths of powers of two."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r[0], r[1], r[2]) for r in logs.groupBy(step.alias("step")).agg(F.min("n"), F.count("*")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, low, size in sizes:
        total += size
        if total > most:
            break
        least = low
    return least


class Lookup:
    """Grams with their logs: most are found in the slot their hash names, where the commonest stand; others by search."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, logp: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.logp = grams[order], logp[order].astype(np.float64)
        self.shift = np.uint64(64 - max(1, len(grams).bit_length() + 1))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        rising = np.argsort(n[order], kind="stable")
        slot = self._slot(self.grams[rising])
        self.slots[slot] = self.grams[rising]
        self.values = np.zeros(len(self.slots))
        self.values[slot] = self.logp[rising]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each gram (0 if it is not here), and whether it is here."""
        slot = self._slot(grams)
        here = self.slots[slot] == grams
        out = np.where(here, self.values[slot], 0.0)
        other = np.flatnonzero(~here)
        if len(other) and len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams[other]), len(self.grams) - 1)
            there = self.grams[at] == grams[other]
            out[other[there]], here[other[there]] = self.logp[at[there]], True
        return out, here


def symbols_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram (context turned) of each byte of all texts and of their ends, and where each text's begin."""
    gap = bytes([END]) * depth
    raw = np.frombuffer(b"".join(x for t in texts for x in (gap, lower_ascii(t), b"\xff")), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.arange(int(sizes.sum())) + np.repeat(depth * np.arange(1, len(texts) + 1), sizes)
    key = np.zeros(len(raw), np.int64)
    for j in [*range(1, depth + 1), 0]:
        key <<= 8
        key[j:] |= raw[: len(raw) - j]
    return key[at], np.cumsum(sizes) - sizes


def held_out(id_col: str = "doc_id") -> Column:
    """True for the seventh of ids that training must not see; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(True))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): hashes of the words of all training texts and their counts; the end of a text is hash 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("c", pa.int64())])
        found, sums, ends = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in pieces(batches):
            h, times = np.unique(hash_words(batch.column("text").to_pylist(), lower=True)[0], return_counts=True)
            found, inverse = np.unique(np.concatenate([found, h]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([sums, times]), len(found)).astype(np.int64)
            ends += batch.num_rows
            if len(found) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(as_long(found)), pa.array(sums)], schema=schema)
                found, sums = found[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(as_long(np.append(found, np.uint64(0)))), pa.array(np.append(sums, ends))], schema=schema)

    return train.mapInArrow(count, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def score(docs: DataFrame, train: DataFrame, depth: int = 5, max_contexts: int = 1 << 20, max_words: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of each row of docs.

    docs, train: doc_id, text."""
    spark = docs.sparkSession
    learn = train.select(F.col("text").cast("binary").alias("text"))
    trained = stored(gram_counts(learn, depth), "grams")
    upper = upper_levels(trained, depth)
    logs = stored(gram_logs(trained, upper, depth), "logs")
    least = commonest(logs, max_contexts)
    top = logs.where(F.col("n") >= least).toArrow()
    model = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("gram", "n", "logp")))
    counts = stored(word_counts(learn), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = counts.where((F.col("word") == 0) | (F.col("c") * max_words >= n)).toArrow()
    known, times = common["word"].to_numpy().astype(np.int64).view(np.uint64), common["c"].to_numpy().astype(np.int64)
    order = np.argsort(known)
    lookup = spark.sparkContext.broadcast((known[order], times[order]))
    rare = counts.where((F.col("word") != 0) & (F.col("c") * max_words < n))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, (known, c) = Lookup(*model.value), lookup.value
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64())), ("gram_times", pa.list_(pa.int32()))])
        logs = np.log10(c + 1.0)
        for batch in pieces(batches):
            out, texts = [], batch.column("text").to_pylist()
            hashes, bounds = hash_words(texts, lower=True)
            symbols, starts = symbols_of(texts, depth)
            logp, here = net.find(symbols)
            scores = np.add.reduceat(logp, starts)
            other = np.flatnonzero(~here)
            ends = np.searchsorted(other, np.append(starts, len(symbols)))
            for i, (t, a, b) in enumerate(zip(texts, bounds.tolist(), bounds[1:].tolist())):
                h, times = np.unique(np.append(hashes[a:b], np.uint64(0)), return_counts=True)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                there = known[at] == h if len(known) else np.zeros(len(h), bool)
                out.append((int(times.sum()), int(times[there].sum()), float((logs[at[there]] * times[there]).sum()), float(scores[i]), len(t), h[~there], times[~there], *np.unique(symbols[other[ends[i] : ends[i + 1]]], return_counts=True)))
            left = [np.concatenate([x[k] for x in out]) for k in (5, 6, 7, 8)]
            sizes, gram_sizes = (pa.array(np.cumsum([0, *(len(x[k]) for x in out)]).astype(np.int32)) for k in (5, 7))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), *(pa.array([x[k] for x in out], schema.types[2 + k]) for k in range(5)),
                    pa.ListArray.from_arrays(sizes, pa.array(as_long(left[0]))), pa.ListArray.from_arrays(sizes, pa.array(left[1].astype(np.int32))),
                    pa.ListArray.from_arrays(gram_sizes, pa.array(left[2])), pa.ListArray.from_arrays(gram_sizes, pa.array(left[3].astype(np.int32))),
                ], schema=schema,
            )

    seen = stored(rows.mapInArrow(each, "doc_id bigint, key bigint, n_tokens bigint, n_known bigint, logs double, score double, n_bytes bigint, words array<bigint>, times array<int>, grams array<bigint>, gram_times array<int>"), "scores")
    seen = seen.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    asked = seen.where("size(words) > 0").select("id", "key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("id", "key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = asked.join(rare, "word").groupBy("id", "key").agg(F.sum("times").alias("more"), F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("more_logs"))
    symbols = seen.where("size(grams) > 0").select("id", "key", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("id", "key", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
    rest = logs.where(F.col("n") < least).select("gram", "logp")
    new = stored(symbols.select("gram").distinct().join(rest, "gram", "left_anti").withColumn("n", F.lit(0).cast("long")), "new-grams")
    if not new.isEmpty():
        rest = rest.unionByName(stored(gram_logs(trained.unionByName(new), upper, depth, unseen=True), "new-logs").select("gram", "logp"))
    scored = symbols.join(rest, "gram").groupBy("id", "key").agg(F.sum(F.col("times") * F.col("logp")).alias("more_score"))
    alike = seen.groupBy("id", "key").agg(F.count("*").alias("alike"))
    return _finished(seen.drop("words", "times", "grams", "gram_times"), found, scored, alike, n, v)


def _finished(seen: DataFrame, found: DataFrame, scored: DataFrame, alike: DataFrame, n: int, v: int) -> DataFrame:
    """Puts the sums of the rare words and grams to the others. Rows of the same id and text were all asked for: each sum
    holds that many times one row's."""
    each = lambda c: F.col(c) / F.col("alike")
    sums = stored(found.join(scored, ["id", "key"], "full").join(alike, ["id", "key"]).select("id", "key", each("more").cast("long").alias("more"), each("more_logs").alias("more_logs"), each("more_score").alias("more_score")), "sums")
    joined = seen.join(sums, ["id", "key"], "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), "n_bytes", (-score / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
