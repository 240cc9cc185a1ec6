"""Helpers that the text operators share: words as bytes, hashes, Arrow batches, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows are handed to numpy in pieces of about this many bytes of text, so that memory does not depend on the batch.
PIECE_BYTES = 2 << 20


def lower_ascii(text: bytes) -> bytes:
    """A-Z lower-cased, everything else as it is (bytes.lower() only knows ASCII)."""
    return text.lower()


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 text: bytes.split() splits at just these six characters."""
    return text.split()


_BLANK = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(256)], np.uint64)


def hash_words(texts: list[bytes | None], lower: bool = False, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (and, last, where all end).

    A word's hash is a polynomial of its bytes, mixed; the bytes of many words are weighted and summed at once, those of
    about `limit` bytes at a time (a longer word stands alone)."""
    texts = [t or b"" for t in texts]
    raw = b"\n".join([*texts, b""])
    at = np.frombuffer(raw.lower() if lower else raw, np.uint8)
    solid = ~_BLANK[at]
    edge = np.flatnonzero(np.diff(solid, prepend=False))  # raw ends in a blank, so edges come in pairs
    first, end = edge[0::2], edge[1::2]
    bounds = np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    cut = np.unique(np.searchsorted(first, np.arange(0, len(raw) + limit, limit))).tolist()
    found = [_hashed(at, solid, first[a:b], end[a:b]) for a, b in zip(cut, cut[1:])]
    return np.concatenate(found) if found else np.empty(0, np.uint64), bounds


def _hashed(at: np.ndarray, solid: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from first to end of the bytes `at`, in order."""
    global _POWERS
    sizes = end - first
    longest = int(sizes.max())
    while len(_POWERS) < longest:
        _POWERS = np.concatenate([_POWERS, _POWERS * _POWERS[-1] * np.uint64(0x9E3779B97F4A7C15)])
    inside = np.flatnonzero(solid[first[0] : end[-1]]) + first[0]
    weight = _POWERS[inside - np.repeat(first, sizes)]
    weight *= at[inside].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(weight, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _factors(n: int) -> list[int]:
    out, f = [], 2
    while n > 1:
        while n % f == 0:
            out.append(f)
            n //= f
        f += 1
    return out[::-1] or [1]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive word hashes (empty if there are fewer).

    Windows are built up factor by factor, so 50 words take 5 + 5 + 2 steps; in each step every place has an odd
    multiplier of its own, so that order matters."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    stride = 1
    for f in _factors(size):
        n = len(h) - (f - 1) * stride
        out = h[:n] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(1, f):
            out += h[j * stride : j * stride + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ^ (0xC2B2AE3D27D4EB4F * j << 1)) & 0xFFFFFFFFFFFFFFFF)
        h = mix(out)
        stride *= f
    return h


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of `column` (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64)
        offset = batch.column(column).offset
        sizes = np.diff(sizes[offset : offset + batch.num_rows + 1])
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is set (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: its lineage ends there, so a lost executor costs one read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more, and lets Spark drop the shuffle files that no plan
    refers to: it does so when the driver's JVM collects its garbage, which a driver with little to do puts off."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
