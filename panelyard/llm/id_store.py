"""Token ids in a binary store: one shared zstandard dictionary, one small frame per document, an offset index.

A file holds a header (magic, hash of the dictionary, bytes per id), the documents' frames, and a footer: document ids,
null flags, token counts and frame offsets, found from the last 16 bytes. So one short document is read with three
small reads. Files follow each other in ascending order of document id; the manifest says where each file's first id
stands in the whole stream. A shard is a range of ids; its rows are written as they come, sorted by Spark, and a file is
closed every `file_docs` documents, so that no shard has to fit into memory. Files get a temporary name first: a task
that is run again replaces its file by the same bytes.

Cases: a null or empty text is its end id alone; rows with a null id come first; repeated ids follow each other, equal
rows in any order; texts of any length are one frame; an empty table writes no file and returns no row; extra columns
are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.text import checkpoint_dir, pieces, stored

MAGIC = b"IDSTORE1"
HEADER = struct.Struct("<8sQB")
TAIL = struct.Struct("<Q8s")
#: Characters with which a text is encoded word by word: all but ASCII and Latin letters that lower-case to one letter.
_OTHER = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
#: How byte-level tokenizers of this kind cut lower-cased text (fixed value, given by the tokenizer file).
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level models write bytes: printable bytes stand for themselves, others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Numbers(dict):
    """Piece -> number in the order of first sight; `new` lists the pieces since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Ids of whole texts, each different piece of text encoded once. Remembers a bounded number of pieces.

    The tokenizer never joins characters over white space, so any text may be encoded word by word. Most texts (ASCII and
    Latin letters, no special token) are cut further, just as the tokenizer cuts them before it merges: `probe` shows
    whether this tokenizer does so; if not, words it is.
    """

    probe = "It's Élan, don't we'll—no: ÀB12 'small' x_y ... \tThe END's"

    def __init__(self, path: str, end: int, limit: int = 450_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.limit = Tokenizer.from_file(path), end, limit
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        self.cuts = True
        texts = [self.probe.replace("—", " "), self.probe]
        self.cuts = all(self.encode([t.encode()])[0][:-1].tolist() == self.whole(t) for t in texts)
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.first, self.size = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, raw: bytes | None) -> list[bytes]:
        """Pieces to encode one by one; a piece that starts with a blank is a word that the tokenizer has to cut."""
        if not raw:
            return []
        text = raw.decode()
        if self.cuts and not _OTHER.search(text) and not any(s in text for s in self.special):
            return _PIECE.findall(text.lower().encode())
        return [b" " + w for w in raw.split()]

    def learn(self, new: list[bytes]) -> None:
        merge, letters = self.tokenizer.model.tokenize, _byte_letters()
        found = [self.whole(p[1:].decode()) if p[0] == 32 else [t.id for t in merge(p.decode() if p.isalnum() else p.decode("latin-1").translate(letters))] for p in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum()))])
        self.size = np.concatenate([self.size, sizes])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.number) > self.limit:
            self.clear()
        cut = [self.pieces(t) for t in texts]
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int32, sum(map(len, cut)))
        if self.number.new:
            self.learn(self.number.new)
            self.number.new = []
        sizes = self.size[at]
        ids = self.flat[np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        out, total = [], np.r_[0, np.cumsum(sizes)]
        ends = total[np.cumsum([0, *map(len, cut)])].tolist()
        for a, b in zip(ends, ends[1:]):
            x = np.empty(b - a + 1, self.dtype)
            x[:-1], x[-1] = ids[a:b], self.end
            out.append(x)
        return out


@lru_cache(maxsize=1)
def encoder(path: str, end: int) -> Encoder:
    """One for all tasks of a worker: texts of different tasks have most of their words in common."""
    return Encoder(path, end)


def train_dictionary(docs: DataFrame, path: str, end: int, sample: int = 1000, max_chars: int = 8192, size: int = 65_536) -> bytes:
    """A zstandard dictionary from the id arrays of at most `sample` texts (those of the smallest id hashes), of which at
    most `max_chars` characters each count; the bounds hold for the dictionary alone. Empty if there is nothing to learn."""
    rows = docs.where("text != ''").select(F.substring("text", 1, max_chars).cast("binary").alias("text"), F.xxhash64("id").alias("h"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    texts = sorted(bytes(r.text) for r in rows.where(F.col("h") <= last).select("text").limit(sample).collect())
    arrays = [x.tobytes() for x in encoder(path, end).encode(texts)]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the arrays themselves
        return b"".join(arrays)[-size:]


def _codec(dictionary: bytes, level: int = 3):
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=level, **shared), zstandard.ZstdDecompressor(**shared)


class Store:
    """Opens a file of the store by its URI; `ids(i)` is the i-th document."""

    def __init__(self, uri: str, dictionary: bytes):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        magic, stamp, width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or stamp != xxhash.xxh3_64_intdigest(dictionary):
            raise ValueError(f"{uri}: not a store, or written with another dictionary")
        end = self.file.size()
        at, _ = TAIL.unpack(self.file.read_at(TAIL.size, end - TAIL.size))
        footer = zstandard.ZstdDecompressor().decompress(self.file.read_at(end - TAIL.size - at, at))
        n = int.from_bytes(footer[:8], "little")
        self.doc_ids = np.frombuffer(footer, np.int64, n, 8)
        self.missing = np.frombuffer(footer, np.bool_, n, 8 + 8 * n)
        self.sizes = np.frombuffer(footer, np.uint32, n, 8 + 9 * n)
        self.offsets = np.frombuffer(footer, np.uint64, n + 1, 8 + 13 * n)
        self.dtype, self.unpack = (np.uint16 if width == 2 else np.uint32), _codec(dictionary)[1]

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.unpack.decompress(self.file.read_at(b - a, a), max_output_size=int(self.sizes[i]) * self.dtype().itemsize), self.dtype)


class _Writer:
    def __init__(self, folder: str, name: str, width: int, stamp: int):
        from pyarrow import fs

        self.uri = f"{folder}/{name}"
        self.system, self.path = fs.FileSystem.from_uri(self.uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.file, self.at = self.system.open_output_stream(self.temporary), 0
        self.ids, self.sizes, self.offsets = [], [], []
        self.put(HEADER.pack(MAGIC, stamp, width))

    def put(self, raw: bytes) -> None:
        self.file.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, size: int, frame: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.offsets.append(self.at)
        self.put(frame)

    def close(self) -> None:
        footer_at, n = self.at, len(self.ids)
        parts = [n.to_bytes(8, "little"), np.array([x or 0 for x in self.ids], np.int64).tobytes(), np.array([x is None for x in self.ids]).tobytes(), np.array(self.sizes, np.uint32).tobytes(), np.array([*self.offsets, footer_at], np.uint64).tobytes()]
        self.put(zstandard.ZstdCompressor().compress(b"".join(parts)))
        self.put(TAIL.pack(footer_at, MAGIC))
        self.file.close()
        self.system.move(self.temporary, self.path)


def write(docs: DataFrame, tokenizer_path: str, end: int, folder: str | None = None, shard_docs: int = 8192, file_docs: int = 65_536, max_shards: int = 4096) -> tuple[DataFrame, bytes]:
    """Writes all texts (doc_id, text); the manifest (uri, docs, tokens, start) and the dictionary."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    dictionary = train_dictionary(rows, tokenizer_path, end)
    shared = spark.sparkContext.broadcast(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (pack, _) = encoder(tokenizer_path, end), _codec(shared.value)
        for batch in pieces(batches):
            ids = tokens.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([tokens.dtype().itemsize] * len(ids), pa.int32()), pa.array([pack.compress(x.tobytes()) for x in ids], pa.binary())],
                ["id", "n", "width", "frame"],
            )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp, out, writer, shard, files = xxhash.xxh3_64_intdigest(shared.value), [], None, None, 0
        _, path = _folder(folder)

        def close() -> None:
            writer.close()
            out.append((shard, files, writer.uri, len(writer.ids), sum(writer.sizes)))

        for batch in batches:
            for s, i, n, width, frame in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "n", "width", "frame"))):
                if writer and (s != shard or len(writer.ids) >= file_docs):
                    close()
                    files, writer = (files + 1 if s == shard else 0), None
                shard = s
                writer = writer or _Writer(folder, f"{s:06d}-{files:06d}.ids", width, stamp)
                writer.add(i, n, frame)
        if writer:
            close()
        names = ("shard", "part", "uri", "docs", "tokens")
        yield pa.RecordBatch.from_pydict({k: [x[j] for x in out] for j, k in enumerate(names)}, pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    total = rows.count()
    shards = max(1, min(max_shards, -(-total // shard_docs)))
    # shards are ranges between percentiles of the ids; the percentiles only balance the shards, any would be right
    cuts = rows.agg(F.percentile_approx("id", [k / shards for k in range(1, shards)], 100 * shards)).first()[0] if shards > 1 else []
    cuts = sorted(set(cuts or []))
    shard = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.coalesce("id", F.lit(-(2**63))))) if cuts else F.lit(0)
    encoded = rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(encode, "id bigint, n bigint, width int, frame binary")
    dealt = encoded.withColumn("shard", shard.cast("int")).repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "id", "n", "frame")
    saved = stored(dealt.mapInArrow(save, "shard int, part int, uri string, docs bigint, tokens bigint"), "manifest")
    # one row a file: few enough for one window
    start = F.sum("tokens").over(Window.orderBy("shard", "part")) - F.col("tokens")
    return saved.select("uri", "docs", "tokens", start.alias("start")), dictionary


def _folder(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def read(manifest: DataFrame, dictionary: bytes, files: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    shared = manifest.sparkSession.sparkContext.broadcast(dictionary)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                store = Store(row["uri"], shared.value)
                starts = row["start"] + np.r_[0, np.cumsum(store.sizes[:-1].astype(np.int64))] if len(store.sizes) else []
                crc = [zlib.crc32(store.ids(i).astype("<u4").tobytes()) for i in range(len(store.sizes))]
                ids = pa.array(store.doc_ids, mask=np.asarray(store.missing))
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(store.sizes.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    n = files or max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
