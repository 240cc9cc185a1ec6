"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is every document with a smaller id. Its index is cut into blocks by the leading bits of the hash of
`window` consecutive words; a block knows, for each window in it, the first document (by id) that has it, and where.
A document is parsed greedily: at a place whose window an indexed block knows, a factor is copied from there and grows
as long as the next windows continue the same reference; where it ends, the windows across its boundary are looked up
as well, so a long match with another reference that begins inside a factor is not lost. Factors are at least `window`
words long; the words they cover are duplicates.

Windows that only one document has are never shuffled: a bitmap of fixed size, made from all windows, holds those that
come up twice. Of the others a task sends each window of its own first document only; its other documents already know
an earlier one.

Cases: a null text has no words; a text shorter than a window is kept; a window that is repeated in the same document
alone is kept; rows with the same id never count as earlier than each other; rows with a null id are neither parsed nor
reference, and kept whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.sketches import FLUSH, bitmap_of, shared_hashes
from panelyard.llm.text import hash_words, pieces, stored, window_hashes, words

MATCH = np.dtype([("at", "<i4"), ("ref_at", "<i4"), ("ref", "<i8")])
ENTRY = np.dtype([("h", "<u8"), ("doc", "<i4"), ("at", "<i4")])
DOC = np.dtype([("id", "<i8"), ("key", "<i8")])
FACTORS = "array<struct<start:int,end:int,ref:bigint,ref_start:int>>"


def _hashes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    for batch in pieces(batches):
        h, bounds = hash_words(batch.column("text").to_pylist())
        w = window_hashes(h, window)
        for owner, a, b in zip(zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()), bounds.tolist(), bounds[1:].tolist()):
            yield owner, w[a : max(a, b - window + 1)]


def _pack(array: np.ndarray) -> bytes:
    """Column after column, all but hashes as differences."""
    columns = [array[f] if f == "h" else np.diff(array[f], prepend=array.dtype[f].type(0)) for f in array.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = len(raw) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for f in dtype.names:
        size = dtype[f].itemsize * n
        column = np.frombuffer(raw[at : at + size], dtype[f])
        out[f] = column if f == "h" else np.cumsum(column, dtype=dtype[f])
        at += size
    return out


def _first(entries: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ordered by hash, document id and place; for each, the number of its hash's first entry."""
    entries = entries[np.lexsort((entries["at"], ids[entries["doc"]], entries["h"]))]
    start = np.flatnonzero(np.r_[True, entries["h"][1:] != entries["h"][:-1]])
    return entries, np.repeat(start, np.diff(np.r_[start, len(entries)]))


def _matches(entries: np.ndarray, first: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(id, key, matches) of each document with windows of an earlier one."""
    later = docs["id"][entries["doc"]] > docs["id"][entries["doc"][first]]
    e, ref = entries[later], entries[first[later]]
    order = np.lexsort((e["at"], e["doc"]))
    e, ref = e[order], ref[order]
    cut = np.flatnonzero(np.r_[True, e["doc"][1:] != e["doc"][:-1]]) if len(e) else []
    for a, b in zip(cut, [*cut[1:], len(e)]):
        m = np.empty(b - a, MATCH)
        m["at"], m["ref_at"], m["ref"] = e["at"][a:b], ref["at"][a:b], docs["id"][ref["doc"][a:b]]
        yield int(docs["id"][e["doc"][a]]), int(docs["key"][e["doc"][a]]), _pack(m)


def find_matches(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, key, matches: windows of each document that an earlier one has, in some rows a document."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    expected = total // 6  # words of about so many bytes; only balances the parts
    # the parts keep their number until they would get large, as each sends a document's matches in a row of its own
    parts_log = min(20, max(4, int(np.ceil(np.log2(max(1, expected / (8 * FLUSH)))))))
    shared = spark.sparkContext.broadcast(shared_hashes(texts, lambda batches: (h for _, h in _hashes(batches, window)), expected))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("entries", pa.binary()), ("docs", pa.binary()), ("matches", pa.binary())])
        held: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            docs = np.array(owners, DOC)
            entries, first = _first(np.concatenate(held), docs["id"])
            known = list(_matches(entries, first, docs))
            # matches that are found already pass through the parts as well: one shuffle, and nothing is stored twice
            rows = {
                "part": [abs(k[0]) % (1 << parts_log) for k in known], "entries": [None] * len(known),
                "docs": [_pack(np.array([k[:2]], DOC)) for k in known], "matches": [k[2] for k in known],
            }
            entries = entries[docs["id"][entries["doc"]] == docs["id"][entries["doc"][first]]]
            part = (entries["h"] >> np.uint64(64 - parts_log)).astype(np.int64) if parts_log else np.zeros(len(entries), np.int64)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(cut, [*cut[1:], len(entries)]):
                some = entries[a:b][np.lexsort((entries["at"][a:b], entries["doc"][a:b]))]
                used, some["doc"] = np.unique(some["doc"], return_inverse=True)
                for k, v in zip(rows, (int(part[a]), _pack(some), _pack(docs[used]), None)):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema)

        for owner, h in _hashes(batches, window):
            at = np.flatnonzero(shared.value.has(h))
            if len(at):
                e = np.empty(len(at), ENTRY)
                e["h"], e["doc"], e["at"] = h[at], len(owners), at
                owners.append(owner)
                held.append(e)
                count += len(at)
            if count >= FLUSH:
                yield from out()
                held, owners, count = [], [], 0
        if count:
            yield from out()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        # ids and keys come packed: pandas would turn long columns with gaps into doubles
        known, across = pdf[pdf["entries"].isna()], pdf[pdf["entries"].notna()]
        out = [(int(d["id"][0]), int(d["key"][0]), m) for d, m in ((_unpack(d, DOC), m) for d, m in zip(known["docs"], known["matches"]))]
        docs, entries, base = [], [], 0
        for d, e in zip(across["docs"], across["entries"]):
            docs.append(_unpack(d, DOC))
            entries.append(_unpack(e, ENTRY))
            entries[-1]["doc"] += base
            base += len(docs[-1])
        if entries:
            docs = np.concatenate(docs)
            entries, first = _first(np.concatenate(entries), docs["id"])
            out += _matches(entries, first, docs)
        return pd.DataFrame(out, columns=["doc_id", "key", "matches"])

    found = texts.mapInArrow(index, "part int, entries binary, docs binary, matches binary")
    return found.groupBy("part").applyInPandas(join, "doc_id bigint, key bigint, matches binary")


def factors(matches: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(start, end, reference, start there) of the greedy parse; a factor that another one overlaps starts after it.

    matches: places whose window an earlier document has. Where several know a place, the smallest id counts."""
    m = matches[np.lexsort((matches["ref_at"], matches["ref"], matches["at"]))]
    m = m[np.r_[True, m["at"][1:] != m["at"][:-1]]] if len(m) else m
    out: list[tuple[int, int, int, int]] = []
    if not len(m):
        return out
    grows = (np.diff(m["at"]) == 1) & (np.diff(m["ref"]) == 0) & (np.diff(m["ref_at"]) == 1)
    cut = np.r_[0, np.flatnonzero(~grows) + 1, len(m)]
    for a, b in zip(cut[:-1], cut[1:]):
        start, end, ref_at = int(m["at"][a]), int(m["at"][b - 1]) + window, int(m["ref_at"][a])
        skip = max(0, out[-1][1] - start) if out else 0
        if start + skip < end:
            out.append((start + skip, end, int(m["ref"][a]), ref_at + skip))
    return out


def deduplicate(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, factors, kept (the other words, joined by one blank) of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    found = find_matches(texts.where("doc_id is not null"), window)
    gathered = stored(found.groupBy("doc_id", "key").agg(F.collect_list("matches").alias("matches")), "matches")
    flagged = docs.sparkSession.sparkContext.broadcast(bitmap_of(gathered.select("doc_id")))
    schema = f"doc_id bigint, n_words bigint, n_removed bigint, factors {FACTORS}, kept string"

    def result(ids: list, texts: list, found: list[list[tuple]]) -> pa.RecordBatch:
        n_words, removed, kept = [], [], []
        for text, some in zip(texts, found):
            w = words(text) if text else []
            drop = np.zeros(len(w), bool)
            for a, b, _, _ in some:
                drop[a:b] = True
            n_words.append(len(w))
            removed.append(int(drop.sum()))
            kept.append(b" ".join(x for x, gone in zip(w, drop.tolist()) if not gone) if removed[-1] else b" ".join(w))
        arrays = [
            pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
            pa.array([[dict(zip(("start", "end", "ref", "ref_start"), x)) for x in some] for some in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())]))),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "factors", "kept"])

    def split(want: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = flagged.value.has(batch.column("h").to_numpy().view(np.uint64)) & ~np.asarray(batch.column("doc_id").is_null())
                batch = batch.filter(pa.array(known == want))
                if want:
                    yield batch.select(["doc_id", "key", "text"])
                    continue
                for part in pieces([batch]):
                    yield result(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), [[]] * part.num_rows)

        return keep

    hashed = texts.withColumn("h", F.xxhash64("doc_id"))
    plain = hashed.mapInArrow(split(False), schema)
    joined = hashed.mapInArrow(split(True), "doc_id bigint, key bigint, text binary").join(gathered, ["doc_id", "key"], "left")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = [factors(np.concatenate([_unpack(b, MATCH) for b in blobs]), window) if blobs else [] for blobs in part.column("matches").to_pylist()]
            yield result(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), found)

    return plain.unionByName(joined.mapInArrow(parse, schema))
