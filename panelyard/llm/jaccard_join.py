"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word shingles. Shingles have one global order: by their counts in a counter sketch of the
whole corpus, then by hash; those whose counts stand out are frequent. A document's prefix is extended until it holds so
many tokens that no similar document can miss all of them; rare tokens of the prefix are signatures alone, frequent tokens
fall into classes and are signatures in pairs within a class. If x is similar to y, at most |x| - ceil(t |x|) tokens of
x's prefix are missing in y; a prefix whose tokens count, less one for each class of frequent ones, exceeds that number
cannot have lost all its signatures. (This holds for the document whose prefix ends first in the order; the other
prefix reaches at least as far.) The number of classes has to follow the size of the set, so sizes fall into tiers, and
a document belongs to each tier in which a similar document may be.

Documents with the same set are one component from the start. The smallest id of a signature's documents is their hub;
each document is first compared with the hub that it shares most signatures with, which joins most copies. Then only documents that are not in their group's largest
component are compared with the group's others: documents stand in blocks of bounded size, a document asks for a block
once however many groups name it, and a block is compared with a document at one go, token by token. So a group of many
copies costs a few comparisons for each, no pair of documents is ever a row, and no link between different components
is lost.

Blocks are compared by three bytes of each token first, which rules out nearly all that isn't similar, and by whole
tokens then. Signatures that come up once are mostly left out by a bitmap before they are shuffled; sets are made from the texts when
they are compared, and not kept.

Cases: a null text, and a text without words, has the empty set, is linked with nothing and is its own component; a
text of fewer words than a shingle is one shingle; copies are linked; rows with a null id are linked like others, and have
the smallest id that they reach, or null (ids are below 2**62); rows that share an id are each given, but are linked with
what any of them is linked with; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.graph import cut, merged
from panelyard.llm.sketches import COUNTER_BITS, Bitmap, Counters, bitmap_of, counters, shared_hashes
from panelyard.llm.text import as_long, discard, hash_words, mix, pieces, stored, window_hashes

#: The smallest set of each tier; tier k > 0 has FIRST_SIZE[k] // 2 classes of frequent shingles, the first tier has none.
FIRST_SIZE = (0, 16, 128, 1024, 8192, 65536, 524288)
#: Tokens found so much more often than others are frequent.
FREQUENT = 250
#: Tokens of the sets of a block.
BLOCK = 1 << 17
#: Rows without an id go by numbers from here on.
UNNAMED = 1 << 62


def shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted different hashes of the word shingles of each text."""
    h, bounds = hash_words(texts, lower=True)
    windows, out = window_hashes(h, size), []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        some = np.sort(windows[a : b - size + 1]) if b - a >= size else window_hashes(h[a:b], b - a) if b > a else h[:0]
        out.append(some[np.r_[True, some[1:] != some[:-1]]] if len(some) else some)
    return out


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


class Signer:
    """Signatures of a set, given the counts of its tokens. per_cent: the least Jaccard similarity of a link."""

    def __init__(self, counts: np.ndarray, per_cent: int):
        self.counts, self.per_cent = counts, per_cent
        mean = float(counts.sum()) / len(counts)
        # a counter above this holds a token that is frequent by itself, not just several rare ones
        self.rare = mean + 3 * mean**0.5 + FREQUENT

    def prefix_size(self, n: int) -> int:
        return n - -(-self.per_cent * n // 100) + 1

    def tiers(self, n: int) -> list[int]:
        """The tiers of the sizes, from n down to the smallest similar set, in which the pair is looked for."""
        own = max(k for k, first in enumerate(FIRST_SIZE) if first <= n)
        least = -(-self.per_cent * n // 100)
        return [k for k in range(own + 1) if k == own or FIRST_SIZE[k + 1] > least]

    def pure(self, tokens: np.ndarray) -> bool:
        """Whether the prefix has rare tokens alone, so that each of them is a signature."""
        rare = int((self.counts[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] <= self.rare).sum())
        return rare >= self.prefix_size(len(tokens))

    def sign(self, tokens: np.ndarray) -> np.ndarray:
        """Hashes of the signatures. A pair of similar sets is looked for in the tier of the smaller one."""
        n = len(tokens)
        if not n:
            return tokens
        need = self.prefix_size(n)
        count = self.counts[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
        frequent = count > self.rare
        rare, out = tokens[~frequent], []
        # by count, then by hash: the count is a function of the token, so the order is the same for all documents
        rare = rare[np.argsort(count[~frequent], kind="stable")]
        for tier in self.tiers(n):
            salt = np.uint64(0x9FB21C651E98DF25 * (tier + 1) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(rare[:need] + salt))
            short = need - len(rare)
            if short <= 0:
                continue
            often = tokens[frequent]
            often = often[np.lexsort((often, count[frequent]))]
            if not tier:
                out.append(mix(often[:short] + salt))
                continue
            group = (often % np.uint64(FIRST_SIZE[tier] // 2)).astype(np.int64)
            counted = np.ones(len(often), np.int64)
            counted[np.unique(group, return_index=True)[1]] = 0  # the first of each class
            end = int(np.searchsorted(np.cumsum(counted), short)) + 1
            order = np.argsort(group[:end], kind="stable")
            often, group = often[:end][order], group[:end][order]
            for distance in range(1, len(often)):
                same = group[distance:] == group[:-distance]
                if not same.any():
                    break
                out.append(mix(often[:-distance][same] * np.uint64(3) + often[distance:][same] * np.uint64(0x9E3779B97F4A7C15) + salt))
        return np.unique(np.concatenate(out))


def _keyed(docs: DataFrame) -> DataFrame:
    """(node, doc_id, text): a row without an id goes by a hash of its text that stands above all ids."""
    unnamed = F.expr(f"(xxhash64(coalesce(text, '')) & {UNNAMED - 1}L) + {UNNAMED}L")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).select(F.coalesce("doc_id", unnamed).alias("node"), "doc_id", "text")


def _described(texts: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(node, doc_id, n, set) of each row, and the counts of the corpus: both from one reading of the texts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), *Counters.schema])
        counts, seen = Counters(), set()
        for batch in pieces(batches):
            found = shingles(batch.column("text").to_pylist(), size)
            sets = [digest(x) if len(x) else None for x in found]
            new = [x for x, k in zip(found, sets) if k and k not in seen and not seen.add(k)]
            if new:
                counts.add(np.concatenate(new))
            none = [None] * batch.num_rows
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "doc_id": batch.column("doc_id"), "n": [len(x) for x in found], "set": sets, "slice": none, "salt": none, "blob": none}, schema)
        rows = counts.rows()
        none = [None] * len(rows["slice"])
        yield pa.RecordBatch.from_pydict({"node": none, "doc_id": none, "n": none, "set": none, **rows}, schema)

    both = stored(texts.mapInArrow(describe, "node bigint, doc_id bigint, n bigint, set binary, slice int, salt int, blob binary"), "sets")
    return both.where("node is not null").select("node", "doc_id", "n", "set"), counters(both.where("slice is not null").select("slice", "salt", "blob"))


def _kept(batches: Iterator[pa.RecordBatch], wanted: Bitmap) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(wanted.has(batch.column("h").to_numpy().view(np.uint64))))


def _postings(texts: DataFrame, firsts: DataFrame, counts: np.ndarray, size: int, per_cent: int, total: int) -> DataFrame:
    """(sig, node, n, pure) of the signatures of all sets; most of those that come up once are left out, and most copies of a
    set but the first (firsts: the first document of each set)."""
    signer = texts.sparkSession.sparkContext.broadcast(Signer(counts, per_cent))
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap_of(firsts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces(_kept(batches, wanted.value)):
            found = shingles(batch.column("text").to_pylist(), size)
            new = [i for i, x in enumerate(found) if len(x) and (k := digest(x)) not in seen and not seen.add(k)]
            sigs = [signer.value.sign(found[i]).tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(new, pa.int64())), pa.array([len(found[i]) for i in new], pa.int64()), pa.array([signer.value.pure(found[i]) for i in new], pa.bool_()), pa.array(sigs, pa.binary())], ["node", "n", "pure", "sigs"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in pieces(batches, "sigs"):
            yield batch, [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("sigs")]

    signed = stored(texts.withColumn("h", F.xxhash64("node")).mapInArrow(sign, "node bigint, n bigint, pure boolean, sigs binary"), "signatures")
    shared = texts.sparkSession.sparkContext.broadcast(shared_hashes(signed, lambda batches: (np.concatenate(x) for _, x in lists(batches)), total // 3))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sigs in lists(batches):
            every = np.concatenate(sigs)
            keep = shared.value.has(every)
            at = pa.array(np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])[keep])
            yield pa.RecordBatch.from_arrays([pa.array(as_long(every[keep])), *(batch.column(c).take(at) for c in ("node", "n", "pure"))], ["sig", "node", "n", "pure"])

    found = stored(signed.mapInArrow(index, "sig bigint, node bigint, n bigint, pure boolean"), "postings")
    discard(signed)
    return found


def link(docs: DataFrame, size: int = 5, per_cent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest doc_id that links of a similarity of at least
    `per_cent` reach."""
    texts = _keyed(docs)
    rows, counts = _described(texts, size)
    total = rows.agg(F.sum("n")).first()[0] or 0
    # copies of a set are one component from the start
    first = stored(rows.where("set is not null").groupBy("set").agg(F.min("node").alias("component"), F.max("node").alias("last")), "first")
    labels = cut(rows.join(first.where("component != last").select("set", "component"), "set").groupBy("node").agg(F.min("component").alias("component")))

    postings = _postings(texts, first.select("component"), counts, size, per_cent, total)
    # of groups with just the same documents (a shared passage makes many), one stays
    groups = postings.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("same")).where("hub != last")
    groups = groups.groupBy("hub", "last", "size", "same").agg(F.min("sig").alias("sig"), F.count("*").alias("weight")).select("sig", "hub", "weight")
    shared = stored(postings.join(groups, "sig"), "shared")
    discard(postings)
    # a document is first compared with the hub it has most signatures in common with; the others can wait
    often = shared.where("node != hub").groupBy("node", "hub").agg(F.sum("weight").alias("common"), F.first("n").alias("n")).where(F.col("common") * 500 >= F.col("n") * (100 - per_cent))
    pairs = stored(often.groupBy("node").agg(F.max(F.struct("common", "hub")).alias("best")).select("node", F.col("best.hub").alias("hub")), "pairs")
    tokens = pairs.select(F.col("hub").alias("node")).distinct().join(rows, "node").agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("hub"), F.lit(1 + tokens // BLOCK)).alias("block")
    places = _places(pairs.select(block, F.col("hub").alias("node")).distinct(), pairs.select(block, "node").distinct(), labels)
    labels = merged(labels, _linked(texts, places, size, per_cent))
    discard(pairs, places)
    open_ = _promising(_open(shared, labels), per_cent)
    discard(shared)
    rough = _places(*_blocks(open_, per_cent), labels)
    some = _possible(texts, rough, size, per_cent)
    discard(open_, rough)
    places = _places(some.where("member").select("block", "node"), some.where("not member").select("block", "node"), labels)
    labels = merged(labels, _linked(texts, places, size, per_cent))
    discard(some, places)

    named = rows.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    return named.withColumn("component_id", F.when(F.col("component_id") < UNNAMED, F.col("component_id")).otherwise(F.col("doc_id")))


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, n, pure, weight, component) of the groups whose documents are not yet in one component."""
    known = stored(shared.join(labels, "node", "left").select("sig", "node", "n", "pure", "weight", F.coalesce("component", "node").alias("component")), "known")
    groups = known.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("sig")
    open_ = stored(known.join(groups, "sig"), "open")
    discard(known)
    return open_


def _promising(open_: DataFrame, per_cent: int, steps: int = 8) -> DataFrame:
    """The rows of the documents that have signatures enough in common with others to be similar to one.

    Let x and y be similar, t the least similarity. They have a = t / (1 + t) (|x| + |y|) tokens or more in common, so of
    the first |x| - ceil(t |x|) + 1 tokens of x all but |x| - a are in y, and likewise for y; what prefixes have in common
    are the first common tokens of all, so it is the smaller of a - t |x| and a - t |y| at least. These are signatures
    if the prefix of x is of rare tokens alone (y then has them in its prefix, or has all its rare tokens there). The
    number depends on the other's size: sizes fall into `steps` ranges, and a document is kept if for one of them as
    many of its signatures stand in groups with documents of such a size."""
    t = per_cent / 100
    edges = [t ** (1 - 2 * k / steps) for k in range(steps + 1)]
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(1.05))).cast("int")
    classes = open_.groupBy("sig").agg(F.collect_set(size_class).alias("classes"))
    joined = open_.join(classes, "sig")
    meets = lambda low, high: F.exists("classes", lambda c: (F.pow(F.lit(1.05), c + 1) >= low * 0.999 * F.col("n")) & (F.pow(F.lit(1.05), c) <= high * 1.001 * F.col("n")))
    counted = joined.groupBy("node").agg(F.max("n").alias("size"), F.min("pure").alias("clear"), *(F.sum(F.when(meets(low, high), F.col("weight"))).alias(f"common_{k}") for k, (low, high) in enumerate(zip(edges, edges[1:]))))
    keep = ~F.col("clear")
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        least = min(t / (1 + t) * (1 + low) - t, t / (1 + t) * (1 + high) - t * high)
        keep = keep | (F.coalesce(f"common_{k}", F.lit(0)) >= F.greatest(F.lit(1.0), least * F.col("size") - 1))
    out = stored(open_.join(counted.where(keep).select("node"), "node", "left_semi"), "promising")
    discard(open_)
    return out


def _blocks(open_: DataFrame, per_cent: int, limit: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(block, node) of all documents of the groups, and (block, node) of those that have to be compared with a block.

    Two documents of a group that are in different components are not both in its largest one: each document of
    another component asks for the blocks of the group's documents, once for all its groups. Blocks hold `limit` tokens
    or so, of documents of one size class: of one large component, or of small ones."""
    # a little wider than the ratio of sizes that can link, so that such sizes are never two classes apart
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(101 / per_cent))).cast("int")
    open_ = open_.withColumn("size_class", size_class)
    nodes = open_.select("node", "n", "component", "size_class").distinct()
    # small components that share a signature often stand in the same block
    key = open_.groupBy("component", "size_class").agg(F.min("sig").alias("key"))
    totals = nodes.groupBy("component", "size_class").agg(F.sum("n").alias("total")).join(key, ["component", "size_class"])
    small = totals.where(F.col("total") * 8 < limit).groupBy("size_class").agg(F.sum("total").alias("small"))
    of_small = F.col("total") * 8 < limit
    part = lambda c, total: F.pmod(F.xxhash64(c), F.ceil(F.col(total) / limit))
    block = F.when(of_small, F.xxhash64("size_class", part("key", "small"))).otherwise(F.xxhash64("size_class", "component", part("node", "total")))
    dealt = nodes.join(totals, ["component", "size_class"]).join(small, "size_class", "left")
    members = stored(dealt.select("node", block.alias("block"), F.when(~of_small, F.col("component")).alias("owner")), "members")

    largest = open_.groupBy("sig", "component").agg(F.count("*").alias("size")).groupBy("sig").agg(F.max(F.struct("size", "component")).alias("most")).select("sig", F.col("most.component").alias("largest"))
    asking = open_.join(largest, "sig").where("component != largest").select("sig", "node", "component", F.explode(F.sequence(F.col("size_class") - 1, F.col("size_class") + 1)).alias("size_class"))
    chunk = F.pmod(F.xxhash64("block"), F.lit(64)).alias("chunk")
    asked = open_.select("sig", "node", "size_class").join(members, "node").groupBy("sig", "size_class", "owner", chunk).agg(F.collect_set("block").alias("blocks"))
    wanted = asking.join(asked, ["sig", "size_class"]).where("owner is null or owner != component")
    requests = wanted.groupBy("node", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks")).select("node", F.explode("blocks").alias("block"))
    return members.select("block", "node"), stored(requests, "requests")


def _places(members: DataFrame, requests: DataFrame, labels: DataFrame, most: int = 1024) -> DataFrame:
    """(node, component, places): the blocks in which each document is a member or asks.

    A place holds one block and at most about `most` of those that ask for it; a block that more ask for is copied."""
    asked = requests.groupBy("block").agg(F.ceil(F.count("*") / most).cast("int").alias("copies"))
    inside = members.join(asked, "block").select("node", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(True).alias("member"), F.lit(False).alias("asks"))
    asking = requests.join(asked, "block").select("node", "block", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"), F.lit(False).alias("member"), F.lit(True).alias("asks"))
    both = inside.unionByName(asking).groupBy("node", "block", "copy").agg(F.max("member").alias("member"), F.max("asks").alias("asks"))
    places = both.groupBy("node").agg(F.collect_list(F.struct("block", "copy", "member", "asks")).alias("places"))
    return stored(places.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "places"), "places")


def _dealt(texts: DataFrame, places: DataFrame, size: int, written: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(node, component, tokens, block, copy, member, asks): the set of each document at each of its places."""
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap_of(places.select("node")))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(_kept(batches, wanted.value)):
            found = shingles(part.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([written(x) for x in found], pa.binary())], ["node", "tokens"])

    # the bitmap lets few texts through that nothing asks for; the join drops them
    some = texts.select("node", "text", F.xxhash64("node").alias("h")).mapInArrow(load, "node bigint, tokens binary")
    return some.join(places, "node").select("node", "component", "tokens", F.explode("places").alias("place")).select("node", "component", "tokens", "place.*")


def _linked(texts: DataFrame, places: DataFrame, size: int, per_cent: int) -> DataFrame:
    """(a, b): documents that ask for a block with members of it that are similar enough, one of each other component."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        block, asking = rows[rows["member"]], rows[rows["asks"]]
        if len(block) and len(asking):
            nodes, components = block["node"].to_numpy(), block["component"].to_numpy()
            sets = Block([np.frombuffer(t, np.uint64) for t in block["tokens"]])
            for s, c, t in zip(asking["node"], asking["component"], asking["tokens"]):
                fine = sets.like(np.frombuffer(t, np.uint64), per_cent)
                fine = fine[components[fine] != c]
                out += [(s, x) for x in nodes[fine[np.unique(components[fine], return_index=True)[1]]]]
        return pd.DataFrame({"a": np.array([a for a, _ in out], np.int64), "b": np.array([b for _, b in out], np.int64)})

    return stored(_dealt(texts, places, size, np.ndarray.tobytes).groupBy("block", "copy").applyInPandas(compare, "a bigint, b bigint"), "links")


def _possible(texts: DataFrame, places: DataFrame, size: int, per_cent: int) -> DataFrame:
    """(block, node, member): what is left of the places if documents are compared by three bytes of each token: these
    never have less in common than the tokens."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        block, asking = rows[rows["member"]], rows[rows["asks"]]
        inside, asks = np.zeros(len(block), bool), np.zeros(len(asking), bool)
        if len(block) and len(asking):
            components = block["component"].to_numpy()
            sets = Block([unshortened(t) for t in block["tokens"]])
            for k, (c, t) in enumerate(zip(asking["component"], asking["tokens"])):
                fine = sets.like(unshortened(t), per_cent)
                fine = fine[components[fine] != c]
                inside[fine] = True
                asks[k] = len(fine) > 0
        kept = [block[inside], asking[asks]]
        return pd.DataFrame({"block": np.concatenate([x["block"].to_numpy() for x in kept]), "node": np.concatenate([x["node"].to_numpy() for x in kept]), "member": np.arange(inside.sum() + asks.sum()) < inside.sum()})

    found = _dealt(texts, places, size, shortened).groupBy("block", "copy").applyInPandas(compare, "block bigint, node bigint, member boolean")
    return stored(found.distinct(), "possible")


def shortened(tokens: np.ndarray) -> bytes:
    """The three leading bytes of each token."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, 5:]).tobytes()


def unshortened(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 8), np.uint8)
    out[:, 5:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.reshape(-1).view(np.uint64)


class Block:
    """Some sets, ready to be compared with others: their tokens in order, each with the set it is of."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, self.of = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        self.tokens, self.bounds = every[first], np.r_[first, len(every)]

    def like(self, tokens: np.ndarray, per_cent: int) -> np.ndarray:
        """The numbers of the sets that are similar enough (or, where tokens repeat, may be)."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        start, times = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        inside = np.repeat(start - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        common = np.bincount(self.of[inside], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= per_cent * (len(tokens) + self.sizes - common))
