"""Packing into optimal length buckets.

The histogram of all lengths is reduced on executors; a dynamic program over it chooses at most `n_buckets` upper
bounds so that padding every document to its bucket's bound wastes the fewest tokens. Inside a bucket, documents are
numbered without ever meeting in one task (counts of small chunks give each chunk its offset), and each run of
`token_budget // bound` numbers is one batch.

Cases: a null or empty text is its end token alone; a document longer than the budget is a batch of its own; equal
rows get numbers of their own; null ids are kept and packed like others; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.text import stored


def optimal_bounds(histogram: list[tuple[int, int, int]], n_buckets: int) -> list[int]:
    """Upper bounds, ascending, of the buckets with the least padding.

    histogram: (longest length, documents, sum of lengths) of each bin, ascending and disjoint. The padding of bins
    i..j in one bucket is bound_j * (C_j - C_i) - (S_j - S_i), so for each j the best i minimises a line in bound_j whose
    slope is -C_i: a lower hull of lines, met by growing bounds, gives every row of the program in linear time.
    """
    if not histogram:
        return []
    bounds = [b for b, _, _ in histogram]
    docs, tokens = [0], [0]
    for _, n, s in histogram:
        docs.append(docs[-1] + n)
        tokens.append(tokens[-1] + s)
    size = len(bounds)
    cost = [bounds[j] * docs[j + 1] - tokens[j + 1] for j in range(size)]
    choices: list[list[int]] = []
    for _ in range(1, min(n_buckets, size)):
        lines: list[tuple[int, int, int]] = []  # slope, intercept, bins before
        at, new, chosen = 0, list(cost), [0] * size
        for j in range(size):
            if j:
                m, c = -docs[j], cost[j - 1] + tokens[j]
                while len(lines) - at >= 2 and (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - m) >= (c - lines[-2][1]) * (lines[-2][0] - lines[-1][0]):
                    lines.pop()
                lines.append((m, c, j))
            while len(lines) - at >= 2 and lines[at + 1][0] * bounds[j] + lines[at + 1][1] <= lines[at][0] * bounds[j] + lines[at][1]:
                at += 1
            if lines:
                m, c, i = lines[at]
                padding = bounds[j] * docs[j + 1] - tokens[j + 1] + m * bounds[j] + c
                if padding < new[j]:
                    new[j], chosen[j] = padding, i
        choices.append(chosen)
        if new[-1] == cost[-1]:
            break
        cost = new
    out, j = [], size
    for chosen in reversed(choices):
        out.append(bounds[j - 1])
        j = chosen[j - 1]
        if not j:
            break
    if j:
        out.append(bounds[j - 1])
    return out[::-1]


def word_tokens(text: str = "text") -> Column:
    """Words and the end token; a null text has the end token alone."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("int")


def length_histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(length, documents, sum) of each length. There are at most sqrt(2 n) different lengths of n tokens in all, so the
    histogram stays small whatever the corpus."""
    found = lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")).toArrow().sort_by("n_tokens")
    return [(n, docs, n * docs) for n, docs in zip(found["n_tokens"].to_pylist(), found["docs"].to_pylist())]


def pack(docs: DataFrame, n_buckets: int = 16, token_budget: int = 65_536, length: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (from 0 in each bucket), slot (from 0 in each batch), padding."""
    length = word_tokens() if length is None else length
    lengths = stored(docs.select(F.col(id_col).alias("doc_id"), length.alias("n_tokens")), "lengths")
    histogram = length_histogram(lengths)
    bounds = optimal_bounds(histogram, n_buckets)
    total = sum(n for _, n, _ in histogram)
    chunks = max(1024, total // 16_384)
    ends = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    rows = lengths.withColumns(
        {
            "bucket": F.size(F.filter(ends, lambda b: b < F.col("n_tokens"))),
            "chunk": F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(chunks)),
        }
    ).withColumn("bucket_len", F.get(ends, F.col("bucket")))
    per_chunk = rows.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    before = per_chunk.select("bucket", "chunk", (F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")) - 1)
    place = F.col("place") + F.col("before")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("long")
    return numbered.join(before, ["bucket", "chunk"]).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(place / capacity).alias("batch"),
        F.pmod(place, capacity).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
