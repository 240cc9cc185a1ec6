"""A corpus pipeline: stages that each take and return documents, the last one packed batches.

Every stage works on all that its predecessor kept, and its decisions take effect: texts of no learned language go, one
document of each group of near copies stays, documents with benchmark passages go, secrets are masked, and what is left
is packed. The stages return the columns of documents (doc_id, text, lang, source, n_chars), whatever other columns
their input has; n_chars follows the text where that changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import decontaminate, jaccard_join, lang_cnn, length_packing, secret_crf
from panelyard.llm.sketches import bitmap_of
from panelyard.llm.text import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REDACTED = "[SECRET]"


#: A text is of no learned language if its best one is less than so many times as likely as a blind guess. Of 10,000
#: texts of the given tables, none is.
LEAST_OVER_CHANCE = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones among them), and those for which no learned language is much
    better than a guess. Where nothing can be learned (no labels), all texts with a letter stay."""
    model = lang_cnn.train(docs.where(~lang_cnn.held_out()))
    if model is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*COLUMNS)
    found = lang_cnn.predict(docs.select(*COLUMNS), model, keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != lang_cnn.UNDETERMINED) & ((F.col("score") * len(model.labels) >= LEAST_OVER_CHANCE) | F.lit(len(model.labels) == 1))).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row with a key of its own: its id where all ids are there and differ; else a number, with which the rows are
    stored so that it stays the same."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("row"))
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")


def _without(rows: DataFrame, leave: DataFrame) -> DataFrame:
    """The rows whose key is not in `leave`, a stored table of different keys. Only rows that a bitmap of these keys doesn't clear are
    shuffled to meet them."""
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap_of(leave))
    hashed = rows.select(*COLUMNS, "row", F.xxhash64("row").alias("h"))
    kept = [*COLUMNS, "row"]

    def split(hit: bool) -> Callable:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(wanted.value.has(batch.column("h").to_numpy().view(np.uint64)) == hit)).select(kept)

        return some

    schema = rows.select(*kept).schema
    clear, other = (hashed.mapInArrow(split(hit), schema) for hit in (False, True))
    return clear.unionByName(other.join(leave, "row", "left_anti").select(*kept)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays (rows without an id come last).

    Rows are judged one by one: rows of the same id stay if their texts are not linked, as do all texts without words."""
    rows = _keyed(docs)
    linked = stored(jaccard_join.link(rows.select(F.col("row").alias("doc_id"), "text"), size=5, per_cent=75).select(F.col("doc_id").alias("row"), "component_id"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    several = linked.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    group = stored(linked.join(several, "component_id").join(rows.select("row", "doc_id"), "row"), "groups")
    first = group.groupBy("component_id").agg(F.min(order).alias("first")).select("component_id", F.col("first.row").alias("stays"))
    return _without(rows, stored(group.join(first, "component_id").where("row <> stays").select("row"), "leave"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold ten words in a row of a benchmark item (or all of a shorter one), whatever their ids."""
    rows = _keyed(docs)
    found = decontaminate.decontaminate(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), window=10)
    return _without(rows, stored(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("row")), "contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret span, found by rule or by the field, by a mark."""
    found = secret_crf.scan(docs.select(*COLUMNS), secret_crf.train(docs), keep=COLUMNS[1:], mark=REDACTED)
    hit = F.size("spans") > 0
    return found.withColumn("n_chars", F.when(hit, F.length("masked").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("masked")).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot, padding of each document."""
    return length_packing.pack(docs, n_buckets=16, token_budget=65_536)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack_batches),
]

#: No SQL states the trained stages and the bucket program; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
