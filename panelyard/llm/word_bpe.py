"""Byte-level BPE by a table of distinct words: texts are cut into words, each distinct word is encoded once, and its ids
are joined back to every place where it stands; ids become text again through a join with the pieces of the vocabulary.

Texts travel in blocks (the rows that one task reads, about `block_bytes` of text each), so the words that are shuffled
are the distinct words of a block, numbered by first sight, not all words of all texts. The table of distinct words is
partitioned and sorted by word; each entry is encoded once and its ids go back to every block's number for it. What comes
back to a block is a bounded dictionary, whatever the corpus; the block's rows then take their ids by position.

A cut is only made where the tokenizer surely cuts too: before white space, and between an ASCII or Latin letter or digit
and punctuation. Texts with other characters are cut before white space alone; texts that hold an added token, or one of
five control characters (U+001C to U+001F, U+180E) on which regular expression engines differ about white space, are one word.

Cases: a null or empty text has no ids (n_tokens 0) and decodes to the empty string; rows are carried as they are, so
null and repeated ids, and repeated rows, stay row by row; a text of any length, or a word of any length, is encoded
whole (a row longer than a block is a block); an empty table gives an empty result; other columns than `keep` are ignored.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.text import pieces as small_batches

#: Vocabularies of more entries than this are not broadcast for decoding.
MAX_VOCABULARY = 1 << 21

#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 512

_PLAIN = re.compile(rb"[ \t-\r]*[0-9A-Za-z\x80-\xff]+|[ \t-\r]*[^ \t-\r0-9A-Za-z\x80-\xff]+[0-9A-Za-z\x80-\xff]*|[ \t-\r]+")
#: Anything but ASCII and Latin letters.
_OTHER = re.compile(r"[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BROAD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_UNSURE = re.compile(r"[\x1c-\x1f\u180e]")


class Cutter:
    """How texts may be cut into words for the tokenizer of a file; small, and all that most tasks need of it."""

    def __init__(self, path: str):
        told = json.loads(Path(path).read_text())
        before = told["pre_tokenizer"] or {}
        if told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError(f"{path}: not a byte-level tokenizer that cuts words by its own pattern")
        self.whole = re.compile("|".join(map(re.escape, (t["content"] for t in told["added_tokens"]))) or r"(?!)")

    def __call__(self, text: str) -> list[bytes]:
        """Words that, encoded one by one, give the ids of the text."""
        if not text:
            return []
        if self.whole.search(text) or _UNSURE.search(text):
            return [text.encode()]
        return [w.encode() for w in _BROAD.findall(text)] if _OTHER.search(text) else _PLAIN.findall(text.encode())


class Vocabulary:
    """The tokenizer of a file."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a worker."""
    return Vocabulary(path)


def blocks(docs: DataFrame, keep: tuple[str, ...], block_bytes: int) -> DataFrame:
    """The rows, by block and place in it, with their text packed; a block is what a task reads, up to block_bytes."""
    fields = _fields(docs, keep)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, held, squeeze = TaskContext.get().partitionId() << 32, 0, 0, zstandard.ZstdCompressor(level=3).compress
        for batch in small_batches(batches, "packed"):
            texts = batch.column("packed").to_pylist()
            size = sum(len(t) for t in texts if t)
            if held and held + size > block_bytes:
                block, held, place = block + 1, 0, 0
            held += size
            n = len(texts)
            packed = [None if t is None else squeeze(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), *(batch.column(c) for c in keep), pa.array(packed, pa.binary())], ["block", "place", *keep, "packed"])
            place += n

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(*keep, F.col("text").cast("binary").alias("packed")).mapInArrow(pack, f"block bigint, place bigint, {fields}, packed binary").repartition(n, "block")


def _fields(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def _texts(packed: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return ("" if p is None else unpack(p).decode("utf-8", "replace") for p in packed.to_pylist())


class _Codes(dict):
    """Word -> number in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def digest(self) -> bytes:
        return xxhash.xxh3_128_digest(b"\0".join(self))


def block_words(packed: DataFrame, cut: Cutter) -> DataFrame:
    """block, code, word: each distinct word of each block, numbered by first sight; code -1 has the digest of them all."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = _Codes(), None

        def rows() -> Iterator[pa.RecordBatch]:
            listed = [own.digest(), *own]
            for k in range(0, len(listed), 50_000):
                part = listed[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int64()), pa.array(range(k - 1, k - 1 + len(part)), pa.int64()), pa.array(part, pa.binary())], ["block", "code", "word"])

        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), _texts(batch.column("packed"))):
                if block != at:
                    if at is not None:
                        yield from rows()
                    at, own = block, _Codes()
                deque(map(own.__getitem__, cut(text)), maxlen=0)
        if at is not None:
            yield from rows()

    # all columns go in, so that both readers of `packed` share one exchange
    return packed.sortWithinPartitions("block", "place").mapInArrow(words, "block bigint, code bigint, word binary")


def word_ids(words: DataFrame, path: str, flush: int = 500_000) -> DataFrame:
    """The table of distinct words: partitioned and sorted by word, each distinct word is encoded once, and its ids go to
    every (block, code) that has it. block, table: packed (code, ids) of a block's words; digest: the block's digest."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids = vocabulary(path).encode, None, np.empty(0, "<u4")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def row(blocks: list, tables: list, digests: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(tables, pa.binary()), pa.array(digests, pa.binary())], ["block", "table", "digest"])

        def packed() -> Iterator[pa.RecordBatch]:
            block, code, size, flat = map(np.concatenate, zip(*held))
            first, order = np.cumsum(size) - size, np.lexsort((code, block))
            block, code, size, first = (x[order] for x in (block, code, size, first))
            cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)].tolist()
            for a, b in zip(cuts, cuts[1:]):
                s = size[a:b]
                yield row([int(block[a])], [_pack(code[a:b], s, flat[np.repeat(first[a:b] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))])], [None])

        for batch in batches:
            codes = batch.column("code").to_numpy()
            if (told := np.flatnonzero(codes < 0)).size:
                part = batch.take(pa.array(told))
                yield row(part.column("block").to_pylist(), [None] * len(told), part.column("word").to_pylist())
                batch = batch.take(pa.array(np.flatnonzero(codes >= 0)))
            listed = batch.column("word").to_pylist()
            number = _Codes()
            at = np.fromiter(map(number.__getitem__, listed), np.int64, len(listed))
            fresh = [w for w in number if w != last]  # sorted: only the first word can have been encoded with the batch before
            new = [np.array(x, "<u4") for x in encode([w.decode() for w in fresh])]
            known = [ids, *new] if len(fresh) < len(number) else new
            if not known:
                continue
            last, ids = next(reversed(number)), known[-1]
            sizes, flat = np.fromiter(map(len, known), np.int64, len(known)), np.concatenate(known)
            size, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
            held.append((batch.column("block").to_numpy(), batch.column("code").to_numpy(), size, flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]))
            if sum(len(x[0]) for x in held) > flush:
                yield from packed()
                held.clear()
        if held:
            yield from packed()

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(learn, "block bigint, table binary, digest binary")


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their first bytes first, then their second bytes, and so on: these pack better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _pack(code: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    return len(code).to_bytes(8, "little") + zstandard.compress(_planes(np.diff(code, prepend=0)) + _planes(size) + _planes(ids), 3)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, x = int.from_bytes(raw[:8], "little"), np.frombuffer(zstandard.decompress(raw[8:]), np.uint8)
    flat = lambda p: np.ascontiguousarray(p.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(flat(x[: 4 * n])), flat(x[4 * n : 8 * n]), flat(x[8 * n :])


def _ids(rows: pa.Table, cut: Callable[[str], list[bytes]], own: _Codes, start: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, bytearray] | None:
    """Where each text's ids end, and all ids; None if there are more different words than ids are known of."""
    ends, out = [0], bytearray()
    for text in _texts(rows.column("packed")):
        words = cut(text)
        at = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
        if len(own) > len(sizes):
            return None
        s = sizes[at]
        out += flat[np.repeat(start[at] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))].tobytes()
        ends.append(len(out) // 4)
    return np.array(ends, np.int64), out


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = 32 << 20) -> DataFrame:
    """The columns `keep`, n_tokens, and ids (binary, little-endian unsigned 32-bit integers) of every row of docs (text)."""
    packed = blocks(docs, keep, block_bytes)
    cut = Cutter(path)
    known = word_ids(block_words(packed, cut), path)
    schema = pa.schema([*zip(keep, _arrow_types(docs, keep)), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def back(rows: pa.Table, tables: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("place")
        code, size, flat = map(np.concatenate, zip(*[_unpack(t) for t in tables.column("table").to_pylist() if t] or [[np.empty(0, np.int64)] * 3]))
        sizes, start = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        start[code], sizes[code] = np.cumsum(size) - size, size
        told, own = tables.column("digest").to_pylist(), _Codes()
        found = _ids(rows, cut, own, start, sizes, flat.astype("<u4"))
        if found is None or own.digest() not in told:
            # the block was read again, with other rows, after an executor was lost: it encodes its words itself
            for text in _texts(rows.column("packed")):
                deque(map(own.__getitem__, cut(text)), maxlen=0)
            new = vocabulary(path).encode([w.decode() for w in own])
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            found = _ids(rows, cut, own, np.cumsum(sizes) - sizes, sizes, np.array([i for x in new for i in x], "<u4"))
        ends, ids = found
        binary = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
        whole = pa.Table.from_arrays([*(rows.column(c) for c in keep), pa.array(np.diff(ends), pa.int64()), binary], schema=schema)
        return pa.Table.from_batches(whole.to_batches(max_chunksize=BATCH_ROWS), schema)  # Spark takes it batch by batch

    return packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(back, f"{_fields(docs, keep)}, n_tokens bigint, ids binary")


def _arrow_types(docs: DataFrame, keep: tuple[str, ...]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(docs.schema[c].dataType) for c in keep]


def vocabulary_pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: the bytes that each id stands for (an added token stands for its own text)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    listed = vocabulary(path).tokenizer.get_vocab(with_added_tokens=True)
    rows = [(i, bytearray(byte_of[c] for c in t) if all(c in byte_of for c in t) else bytearray(t.encode())) for t, i in listed.items()]
    return spark.createDataFrame(rows, "id bigint, piece binary")


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """encoded (ids as encode gives them) with the column `text`: every id joined with its piece, pieces put together in
    order, bytes that are no UTF-8 replaced. Ids without a piece give nothing; null ids give a null text.

    The vocabulary is the broadcast side (its size is checked); a batch of rows is joined at once, as ids are places in
    the array of pieces."""
    spark = encoded.sparkSession
    n = pieces.agg(F.max("id")).first()[0]
    if n is not None and n >= MAX_VOCABULARY:
        raise ValueError(f"{n + 1} ids are too many to broadcast")
    table: list[bytes] = [b""] * ((n if n is not None else -1) + 2)  # the last is for ids without a piece
    for row in pieces.collect():
        table[row.id] = bytes(row.piece)
    shared = spark.sparkContext.broadcast(table)
    names = encoded.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_id = pa.array(shared.value, pa.large_binary())
        missing = len(at_id) - 1
        for batch in small_batches(batches, "ids"):
            texts = []
            for raw in batch.column("ids").to_pylist():
                ids = np.minimum(np.frombuffer(raw or b"", "<u4"), missing)
                found = at_id.take(pa.array(ids, pa.int64()))
                texts.append(None if raw is None else (found.buffers()[2].to_pybytes() if len(ids) and found.buffers()[2] else b"").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(join, f"{fields}, text string")
