"""Summaries of bounded size, gathered from all rows: a counter sketch, and bitmaps of hashes.

Their size has a bound whatever the data, so they can be broadcast: a bitmap has about sixteen bits a hash, but never more
than 2**MOST_BITS. Both only ever let too much through (a bitmap of more hashes filters less): what they filter is
checked exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**22 counters (16 MB as uint32), and 2**16 (8 kB) to 2**28 bits (32 MB).
COUNTER_BITS, LEAST_BITS, MOST_BITS = 22, 16, 28
_SLICE = 1 << 16
#: Hashes that a task keeps before it hands them on.
FLUSH = 2_000_000

Hashes = Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]]


class Bitmap:
    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.log = bits, log  # uint8, 2**(log - 3)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.log)).astype(np.int64)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


class Counters:
    """How often hashes with the same leading bits came up in a task."""

    schema = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("blob", pa.binary())])

    def __init__(self) -> None:
        self.total = np.zeros(1 << COUNTER_BITS, np.uint32)

    def add(self, h: np.ndarray) -> None:
        np.add.at(self.total, (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))

    def rows(self) -> dict[str, list]:
        """slice, salt, blob: 64 sums of a slice can run side by side, as the first of two levels."""
        pack, salt, out = zstandard.ZstdCompressor(level=1), int(self.total[:4096].sum()) % 64, {"slice": [], "salt": [], "blob": []}
        for k in range(0, len(self.total), _SLICE):
            part = self.total[k : k + _SLICE]
            if part.any():
                for name, v in zip(out, (k // _SLICE, salt, pack.compress(part.tobytes()))):
                    out[name].append(v)
        return out


def counters(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters, from rows of slice, salt, blob."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total, unpack = np.zeros(_SLICE, np.uint64), zstandard.ZstdDecompressor()
        for b in pdf["blob"]:
            total += np.frombuffer(unpack.decompress(b), np.uint32)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "salt": [0], "blob": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    schema = "slice int, salt int, blob binary"
    sums = parts.groupBy("slice", "salt").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    out = np.zeros(1 << COUNTER_BITS, np.uint32)
    for r in sums.toLocalIterator():
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["blob"])), np.uint32)
    return out


def shared_hashes(rows: DataFrame, hashes: Hashes, expected: int) -> Bitmap:
    """The hashes that came up at least twice (and some others). expected: about how many hashes there are in all; the
    hashes are dealt by their leading bits to so many groups that each stays small."""
    groups_log = min(24, max(0, int(np.ceil(np.log2(max(1, expected / FLUSH))))))
    log = max(groups_log, bits_for(expected // 16))
    low = np.uint64(32 - groups_log)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, kept, n = zstandard.ZstdCompressor(level=1), [], 0
        schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

        def out() -> Iterator[pa.RecordBatch]:
            h = np.sort(np.concatenate(kept))
            # once is enough for a hash met once, twice for one met more often
            third = np.r_[False, False, (h[2:] == h[1:-1]) & (h[1:-1] == h[:-2])] if len(h) > 2 else np.zeros(len(h), bool)
            h = h[~third]
            part = (h >> np.uint64(64 - groups_log)).astype(np.int64) if groups_log else np.zeros(len(h), np.int64)
            short = (h >> low).astype(np.uint64) if groups_log < 32 else h
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(cut, [*cut[1:], len(h)]):
                yield pa.RecordBatch.from_pydict({"part": [int(part[a])], "blob": [pack.compress(np.diff(short[a:b], prepend=np.uint64(0)).astype("<u8").tobytes())]}, schema)

        for h in hashes(batches):
            kept.append(h)
            n += len(h)
            if n >= FLUSH:
                yield from out()
                kept, n = [], 0
        if n:
            yield from out()

    span = 1 << (log - groups_log)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        h = np.sort(np.concatenate([np.cumsum(np.frombuffer(unpack.decompress(b), "<u8")) for b in pdf["blob"]]))
        twice = h[1:][h[1:] == h[:-1]]
        bits = np.zeros(span, bool)
        bits[((twice >> (np.uint64(64 - log) - low)) & np.uint64(span - 1)).astype(np.int64)] = True
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "blob": [np.packbits(bits, bitorder="little").tobytes()]})

    found = rows.mapInArrow(local, "part int, blob binary").groupBy("part").applyInPandas(find, "part int, blob binary")
    return _assembled(found, span, log)


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * max(1, n) - 1).bit_length()))


def bitmap_of(values: DataFrame) -> Bitmap:
    """A bitmap of the values of the only column (long), by their xxhash64 as Spark computes it; values: a stored table."""
    name, log = values.columns[0], bits_for(values.count())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log, bool)
        for b in batches:
            bits[(b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - log)).astype(np.int64)] = True
        for k in np.flatnonzero(bits.reshape(-1, _SLICE).any(axis=1)):
            yield pa.RecordBatch.from_pydict({"part": [int(k)], "blob": [np.packbits(bits[k * _SLICE : (k + 1) * _SLICE], bitorder="little").tobytes()]}, pa.schema([("part", pa.int32()), ("blob", pa.binary())]))

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "blob": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["blob"]]).tobytes()]})

    found = values.select(F.xxhash64(name).alias("h")).mapInArrow(local, "part int, blob binary").groupBy("part").applyInPandas(union, "part int, blob binary")
    return _assembled(found, _SLICE, log)


def _assembled(found: DataFrame, span: int, log: int) -> Bitmap:
    bits = np.zeros(1 << (log - 3), np.uint8)
    for r in found.toLocalIterator():
        part = np.frombuffer(bytes(r["blob"]), np.uint8)
        at = r["part"] * span
        if span >= 8:
            bits[at >> 3 : (at >> 3) + len(part)] = part
        else:
            bits[at >> 3] |= part[0] << (at & 7)
    return Bitmap(bits, log)
