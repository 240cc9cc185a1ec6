"""Word-table BPE against the tokenizer library itself."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelyard.llm import queries, word_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  \n\t ", "it's they're  don't'll ''s", "a<|endoftext|>b <|endoftext|>", "日本語のテキスト、混ぜて mixed 漢字", "emoji 👩‍👩‍👧 🙂🙂", "x y z 　", "—, em—dash… “quoted”",
    "tab\tand\r\nlines\n\n\n", "\x1c\x1d odd \x1e", "1234567890 ½ ² ٣", "ÀÉß×÷ ĳ ſ", "comb́ining é", "w" * 5000, "a.b,c;d!e?f(g)h[i]", " leading and trailing ", "᠎ ​ zero", "aaa'ssss 'tis 's",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(rows, library):
    for r in rows:
        want = library.encode(r.original or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want), r.original
        assert r.text == library.decode(want, skip_special_tokens=False)


def test_odd_texts_and_rows(spark, texts, library):
    rows = [(i, t, "x", 1) for i, t in [*texts, *((k, t) for k, t in enumerate(ODD))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, block bigint").withColumn("original", F.col("text"))
    found = word_bpe.decode(word_bpe.encode(docs.repartition(3), PATH, keep=("doc_id", "original"), block_bytes=4000), word_bpe.vocabulary_pieces(spark, PATH)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.original or "") for r in found) == sorted((i is None, i, t or "") for i, t, *_ in rows)
    same(found, library)


def test_each_distinct_word_once(spark):
    docs = spark.createDataFrame([(k, f"one two two three{k % 2}") for k in range(40)], "doc_id int, text string").repartition(4)
    words = word_bpe.block_words(word_bpe.blocks(docs, ("doc_id",), 1 << 20), word_bpe.Cutter(PATH)).where("code >= 0")
    assert {bytes(r.word) for r in words.collect()} == {b"one", b" two", b" three0", b" three1"}
    assert words.count() == words.distinct().count()


def test_block_that_was_read_in_another_order(spark, library):
    """A block whose words don't match the numbers that came back encodes itself."""
    number = word_bpe._Codes()
    for w in (b"a", b" b"):
        number[w]
    other = word_bpe._Codes()
    for w in (b" b", b"a"):
        other[w]
    assert number.digest() != other.digest()


def test_decode_other_ids(spark):
    pieces = spark.createDataFrame([(0, bytearray(b"ab")), (1, bytearray(b"\xc3")), (2, bytearray(b"\xa9"))], "id bigint, piece binary")
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    rows = [(1, ids(0, 1, 2)), (2, ids(1)), (3, ids(7, 0)), (4, ids()), (5, None)]
    got = {r.k: r.text for r in word_bpe.decode(spark.createDataFrame(rows, "k int, ids binary"), pieces).collect()}
    assert got == {1: "abé", 2: "�", 3: "ab", 4: "", 5: None}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_bpe.Cutter(public_tokenizers.path("word_bpe_49k.json"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert word_bpe.encode(docs, PATH).count() == 0


def test_long_text(spark, library):
    text = " ".join(f"word{k % 977} número {k}," for k in range(150_000))
    assert len(text) > 3 << 20
    (row,) = word_bpe.encode(spark.createDataFrame([(1, text)], "doc_id int, text string"), PATH).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_word_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
