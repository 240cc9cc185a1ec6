"""Repair of damaged conversations: the cheapest edits that give a legal order of roles, found by iterative deepening A*.

Legal are the role initials `(s?(ua)+)?`: nothing, or user and assistant by turns, with at most one system turn before. A
row is kept, given the other role, or deleted; rows without a role and text may be inserted. The initials of the role
that comes next follow from what stands before (after s or nothing: u; after u: a; after a: u), so the letters of the
edits alone determine the result.

Faults are found with windows over digests, one row a turn; texts don't travel for that. A conversation becomes a string
of one letter a row, and `search` searches it depth first, trying edits in ASCII order (Delete, Insert, Keep, Rerole)
under a bound that rises by the least excess. What failed under a budget is remembered for each (row, state) and never
tried again with that budget or less, in later rounds neither. Long conversations learn from their end: every 32 rows the
four states are searched first, so that an earlier search meets exact bounds after at most 32 rows; work is linear in the
length. In the last search only failed states are cut off, so the first path to be accepted is the ASCII-least.

The edits then meet the rows, sorted by conversation and place, in one streaming pass that holds one conversation's
letters, never its texts.

Cases: rows go by turn (nulls first), then role, then text digest; a null text or role is one space, before damage too;
rows without a conv_id form a conversation of their own; an empty role fits no initial; repeated rows are duplicates of
the first; a conversation of which nothing is left has no edits and an empty repair; an empty table gives no row; extra
columns are ignored. A conversation of any length is one sorted group of narrow rows; its letters (a byte a row) form a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What edits cost, and what an undeleted truncated row adds.
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: States: nothing yet, after s, after u, after a. What follows each initial, and what an inserted or re-roled row becomes.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
GIVEN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ACCEPTED = (START, AFTER_A)
#: Characters that make no text.
_BLANK = " \t\n\x0b\f\r"
_FAR = 1 << 60


class _Search:
    """Depth-first searches over one conversation's letters: s, u, a or o (another role), in upper case if truncated; x has
    to go. known[row][state] is the failed-state table: the least cost that a search from there has not ruled out."""

    def __init__(self, rows: str):
        self.rows, n = rows, len(rows)
        self.known = [[0] * 4 for _ in range(n)] + [[0, 2 * INSERT, INSERT, 0]]

    def estimate(self, first: int, end: int) -> None:
        """For rows first .. end - 1: what rows that go and truncated rows cost before `end`, and the least from there."""
        least = min(self.known[end])
        for i in range(end - 1, first - 1, -1):
            least += DELETE if self.rows[i] == "x" else TRUNCATED * self.rows[i].isupper()
            self.known[i] = [least] * 4

    def moves(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Letter, cost, next row and next state of each edit, in ASCII order."""
        row = self.rows[i] if i < len(self.rows) else None
        if row:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, GIVEN[state]
        if row and row != "x":
            extra = TRUNCATED * row.isupper()
            if (state, row.lower()) in NEXT:
                yield "K", KEEP + extra, i + 1, NEXT[state, row.lower()]
            yield "R", REROLE + extra, i + 1, GIVEN[state]

    def within(self, i: int, state: int, bound: int) -> str | None:
        """The ASCII-least edits from (i, state) that cost at most `bound`, if there are any."""
        known, n = self.known, len(self.rows)
        stack = [[i, state, bound, self.moves(i, state), _FAR, None]]  # ..., least cost needed, the move under trial
        while stack:
            frame = stack[-1]
            i, state, left = frame[:3]
            if i == n and state in ACCEPTED:
                return "".join(f[5][0] for f in stack[:-1])
            if frame[5]:  # the move under trial has failed
                _, cost, j, to = frame[5]
                frame[4], frame[5] = min(frame[4], cost + known[j][to]), None
            for move in frame[3]:
                _, cost, j, to = move
                if cost + known[j][to] <= left:
                    frame[5] = move
                    stack.append([j, to, left - cost, self.moves(j, to), _FAR, None])
                    break
                frame[4] = min(frame[4], cost + known[j][to])
            else:
                known[i][state] = max(known[i][state], frame[4])
                stack.pop()
        return None

    def deepen(self, i: int, state: int) -> tuple[str, int]:
        while (found := self.within(i, state, self.known[i][state])) is None:
            pass  # the failure has raised known[i][state], the next bound
        return found, self.known[i][state]


def search(rows: str, step: int = 32) -> tuple[str, int]:
    """The cheapest edits of a conversation's letters, ties to the ASCII-least, and their cost."""
    made = _Search(rows)
    ends = [*range(len(rows), 0, -step), 0]
    for end, first in zip(ends, ends[1:]):
        made.estimate(first, end)
        for state in range(4 if first else 0):
            made.deepen(first, state)
    return made.deepen(0, START)


@lru_cache(maxsize=1 << 16)
def _short(rows: str) -> tuple[str, int]:
    """Many conversations have the same letters."""
    return search(rows)


@pandas_udf(StructType([StructField("audit", StringType()), StructField("cost", LongType())]))
def _plans(letters: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(_short if len(x) <= 64 else search)(x) for x in letters], columns=["audit", "cost"])


def damage(conversations: DataFrame, code: Column) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by `code`: 0 drops a row, 1 empties its text, 2 removes its full stops and
    question and exclamation marks, 3 repeats it, 4 makes the user its role."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"), F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.array_repeat(F.lit(0), F.when(code == 0, 0).when(code == 3, 2).otherwise(1)).alias("times"),
    )
    return rows.withColumn("times", F.explode("times")).drop("times")


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def faults(rows: DataFrame) -> DataFrame:
    """For each conv_id: letters (one a row, in order) and the counts gaps, blank, duplicate, truncated, illegal."""
    last = F.right(F.rtrim("text", F.lit(_BLANK)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), F.substring("role", 1, 1).alias("initial"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    line, same = Window.partitionBy("conv_id").orderBy(*order), Window.partitionBy("conv_id", "digest").orderBy(*order)
    placed = narrow.withColumns({
        "place": F.row_number().over(line), "again": F.row_number().over(same) > 1,
        "illegal": F.coalesce(~F.concat(F.lag("initial").over(line), "initial").isin("su", "ua", "au"), F.lit(False)), "fresh": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(line)),
    })
    letter = F.when(F.col("blank") | F.col("again"), "x").otherwise(F.when(F.col("open"), F.upper("kind")).otherwise(F.col("kind")))
    lettered = placed.withColumn("kind", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")).withColumn("letter", letter)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    blank, again = F.col("blank"), F.col("again")
    return lettered.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("letters"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0)).alias("gaps"), count(blank).alias("blank"), count(~blank & again).alias("duplicate"),
        count(~blank & ~again & F.col("open")).alias("truncated"), count(F.col("illegal")).alias("illegal"),
    )


def plans(rows: DataFrame) -> DataFrame:
    """faults(rows) with the cheapest edits of every conversation: audit (their letters) and cost."""
    return faults(rows).withColumn("plan", _plans("letters")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("plan.cost").alias("cost"), F.col("plan.audit").alias("audit"))


def repair(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, edit: the repaired rows, those of a conversation together and in order.

    `rows` and `planned` (conv_id, audit) meet sorted by conversation, the audit first: it says what becomes of each row."""
    null = lambda t: F.lit(None).cast(t)
    turn = rows.schema["turn"].dataType.simpleString()
    lines = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", _digest().alias("digest"), null("string").alias("audit"))
    heads = planned.select("conv_id", F.lit(0).alias("kind"), null(turn).alias("turn"), null("string").alias("role"), null("string").alias("text"), null("string").alias("digest"), "audit")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "digest")]
    role_of = {AFTER_U: "user", AFTER_A: "assistant"}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, START, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                at, state, place = at + 1, GIVEN[state], place + 1
                yield conv, place, role_of[state], "", "I"

        for batch in batches:
            out = []
            for c, kind, role, text, a in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text", "audit"))):
                if kind == 0:
                    conv, audit, at, state, place = c, a, 0, START, 0
                    out += inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    state, place = (NEXT[state, role[:1]] if edit == "K" else GIVEN[state]), place + 1
                    out.append((conv, place, role if edit == "K" else role_of[state], text, edit))
                out += inserted()
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text", "edit"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(apply, f"conv_id {kind}, place bigint, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of `role:text` lines of each conversation, read in the order in which repair() leaves them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h = None, None
        for batch in batches:
            out = []
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
                if place == 1:
                    if h:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    h.update(f"\n{role}:{text}".encode())
            yield _pairs(out, batch.schema.field("conv_id").type)
            kind = batch.schema.field("conv_id").type
        if h:
            yield _pairs([(conv, h.hexdigest())], kind)

    return repaired.mapInArrow(fold, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], kind), pa.array([x for _, x in rows], pa.string())], ["conv_id", "repaired_sha256"])


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: counts, cost, audit and digest of the repair of `rows`."""
    planned = plans(rows)
    done = digests(repair(rows, planned.select("conv_id", "audit")))
    found = conversations.select(F.col("conv_id").alias("id")).distinct().join(planned, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    both = found.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select(
        F.col("id").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
