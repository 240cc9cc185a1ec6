"""Benchmark decontamination with a block-partitioned positional inverted index.

`build_index` turns documents into blocks; a block holds, for every indexed term, the sorted positions at which
the term stands in the block's documents. `phrase_search` takes the windows of the test items, starts from each
window's rarest term, and intersects the offset-adjusted position lists of its other terms from rare to common.
`proximity_search` does the same for terms that only have to stand near each other.

Cases: a null text has no words; a null or wordless item has no window; an item of fewer than `window` words is one
window; repeated document rows each get their own result; rows with a null id are kept, with that null id; empty
tables give empty results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.text import pieces, stored

#: Lower-cases A-Z, keeps digits, letters and every byte of a non-ASCII character, and turns the rest into blanks.
_TABLE = bytes((ord(chr(b).lower()) if chr(b).isalnum() else 32) if b < 128 else b for b in range(256))

INDEX_SCHEMA = "block string, doc_ids array<bigint>, n_words array<int>, terms array<binary>, counts array<int>, postings binary"
HIT_SCHEMA = "block string, ord int, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int>>, items array<string>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: ids, lengths, and the position list of each term (of `vocabulary`, if given)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        known, pack = shared.value, zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
        for batch in pieces(batches):
            ids: dict[bytes, int] = {t: i for i, t in enumerate(known)} if known is not None else defaultdict(lambda: len(ids))
            names = list(known) if known is not None else None
            find = (lambda w, get=ids.get: get(w, -1)) if known is not None else ids.__getitem__
            codes, lengths = [], []
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                lengths.append(len(found))
                codes.append(np.fromiter(map(find, found), np.int32, len(found)))
            stream = np.concatenate(codes) if codes else np.empty(0, np.int32)
            at = np.flatnonzero(stream >= 0).astype(np.uint32)
            order = np.argsort(stream[at], kind="stable")
            at, of = at[order], stream[at][order]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
            counts = np.diff(np.r_[first, len(of)]).astype(np.int32)
            gaps = np.diff(at, prepend=np.uint32(0))
            gaps[first] = at[first]  # each list starts from its first position
            names = names if names is not None else list(ids)
            yield pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "doc_ids": [batch.column("id").to_pylist()], "n_words": [lengths], "terms": [[names[i] for i in of[first]]], "counts": [counts.tolist()], "postings": [pack.compress(gaps.tobytes())]}, schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(blocks, INDEX_SCHEMA)


class _Block:
    """The lists of one index row."""

    def __init__(self, row: dict):
        self.doc_ids, self.n_words = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.starts = np.r_[0, np.cumsum(self.n_words)]
        counts = np.array(row["counts"], np.int64)
        self.ends = np.r_[0, np.cumsum(counts)]
        gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["postings"]), np.uint32).astype(np.int64)
        total = np.cumsum(gaps)
        before = np.r_[0, total][self.ends[:-1]]
        self.positions = total - np.repeat(before, counts)
        self.places = {t: i for i, t in enumerate(row["terms"])}

    def list_of(self, term: bytes) -> np.ndarray:
        i = self.places.get(term)
        return self.positions[self.ends[i] : self.ends[i + 1]] if i is not None else self.positions[:0]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _inside(sorted_list: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    i = np.searchsorted(sorted_list, wanted)
    i[i == len(sorted_list)] = 0
    return sorted_list[i] == wanted if len(sorted_list) else np.zeros(len(wanted), bool)


def phrase_search(index: DataFrame, phrases: list[tuple[str, tuple[bytes, ...]]], weight: dict[bytes, int]) -> DataFrame:
    """Every document of the index with the spans (first word, end) of the phrases in it and their items.

    phrases: (item, terms). weight: how often each term occurs in the indexed corpus; a phrase with a term that never
    occurs is left out. Lists are intersected in the order of weight, so the shortest comes first.
    """
    by_anchor: dict[bytes, list] = defaultdict(list)
    items_of: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, terms in phrases:
        if all(weight.get(t) for t in terms):
            items_of[terms].add(item)
    for terms, items in items_of.items():
        order = sorted(range(len(terms)), key=lambda j: (weight[terms[j]], j))
        by_anchor[terms[order[0]]].append((terms, order, sorted(items)))
    shared = index.sparkSession.sparkContext.broadcast(dict(by_anchor))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _Block(row)
                spans, items = defaultdict(list), defaultdict(set)
                for anchor in block.places.keys() & anchors.keys():
                    for terms, order, names in anchors[anchor]:
                        start = block.list_of(anchor) - order[0]
                        start = start[start >= 0]
                        for j in order[1:]:
                            if not len(start):
                                break
                            start = start[_inside(block.list_of(terms[j]), start + j)]
                        if not len(start):
                            continue
                        doc = block.doc_of(start)
                        same = start + len(terms) <= block.starts[doc + 1]
                        for d, s in zip(doc[same].tolist(), (start - block.starts[doc])[same].tolist()):
                            spans[d].append((s, s + len(terms)))
                            items[d].update(names)
                n = len(block.doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [row["block"]] * n, "ord": list(range(n)), "doc_id": block.doc_ids, "n_words": block.n_words.tolist(),
                        "spans": [[{"first": a, "last": b} for a, b in merged(spans.get(d, []))] for d in range(n)],
                        "items": [sorted(items.get(d, ())) for d in range(n)],
                    },
                    pa.schema([("block", pa.string()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))]),
                )

    return index.mapInArrow(search, HIT_SCHEMA)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def proximity_search(index: DataFrame, queries: list[tuple[str, list[bytes]]], weight: dict[bytes, int], slop: int) -> DataFrame:
    """(item, doc_id, position): the rarest term of a query stands at `position`, and each of its other terms at most `slop` words away."""
    wanted = [(item, sorted(set(terms), key=lambda t: (weight.get(t, 0), t))) for item, terms in queries if terms]
    shared = index.sparkSession.sparkContext.broadcast([(i, t) for i, t in wanted if all(weight.get(x) for x in t)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, out = _Block(row), []
                for item, terms in shared.value:
                    at = block.list_of(terms[0])
                    for t in terms[1:]:
                        if not len(at):
                            break
                        doc = block.doc_of(at)
                        low, high = np.maximum(at - slop, block.starts[doc]), np.minimum(at + slop + 1, block.starts[doc + 1])
                        there = block.list_of(t)
                        at = at[np.searchsorted(there, low) < np.searchsorted(there, high)]
                    doc = block.doc_of(at)
                    out += [(item, block.doc_ids[d], int(p - block.starts[d])) for d, p in zip(doc.tolist(), at.tolist())]
                yield pa.RecordBatch.from_pydict({"item": [x[0] for x in out], "doc_id": [x[1] for x in out], "position": [x[2] for x in out]}, pa.schema([("item", pa.string()), ("doc_id", pa.int64()), ("position", pa.int64())]))

    return index.mapInArrow(search, "item string, doc_id bigint, position bigint")


def term_counts(index: DataFrame) -> dict[bytes, int]:
    """How often each indexed term occurs; index with a bounded vocabulary, as all counts come to the driver."""
    rows = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    return {bytes(r[0]): r[1] for r in rows.toLocalIterator()}


def windows_of(terms: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not terms:
        return []
    return [tuple(terms[i : i + window]) for i in range(max(1, len(terms) - window + 1))]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_words: int = 2_000_000) -> DataFrame:
    """Per document row: doc_id, n_words, spans of words inside a window of an item, and the items with such windows.

    docs: doc_id, text; items: item_id, text. Test words are held on driver and executors at most `max_words` at a
    time; a larger test set goes through the same index in slices, each exact, whose results are then joined by a key that
    each document row is given (and stored with) once.
    """
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and text is not null")
    weight = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + int(weight) // (2 * max_words)  # a word and its blank take two bytes at least
    rows = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows") if slices > 1 else docs
    found: DataFrame | None = None
    for k in range(slices):
        part = texts if slices == 1 else texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        phrases = [(r.item, w) for r in part.toLocalIterator() for w in windows_of(terms_of(bytes(r.text)), window)]
        index = stored(build_index(rows, {t for _, w in phrases for t in w}, "doc_id" if slices == 1 else "row"), "postings")
        hits = phrase_search(index, phrases, term_counts(index))
        if slices > 1:
            # blocks differ from slice to slice, so results meet by document row
            hits = hits.select(F.col("doc_id").alias("row"), "n_words", "spans", "items")
        found = hits if found is None else found.unionByName(hits)
    if slices == 1:
        return found.select("doc_id", "n_words", "spans", "items")
    joined = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.select("row", F.col("doc_id").cast("long").alias("doc_id")).join(joined, "row").select("doc_id", "n_words", "spans", "items")

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["spans"] = [{"first": a, "last": b} for a, b in merged([(s["first"], s["last"]) for s in r["spans"]])]
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return joined.mapInArrow(union, joined.schema)
