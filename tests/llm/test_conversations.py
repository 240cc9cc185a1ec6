"""Conversation repair and the prefix trie against plain tables and against SQL on odd conversations."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_query_sql import normal

from panelyard.llm import conversation_repair, conversation_trie, queries
from panelyard.llm.conversation_repair import GIVEN, NEXT, search


def cheapest(rows):
    """Least (cost, edits) by state, one row after the other."""
    best = {0: (0, "")}

    def with_inserts(b):
        out = dict(b)
        for _ in range(3):
            for q, (c, a) in list(out.items()):
                out[GIVEN[q]] = min(out.get(GIVEN[q], (1 << 30, "")), (c + 2, a + "I"))
        return out

    for r in rows:
        new = {}
        for q, (c, a) in with_inserts(best).items():
            moves = [(q, 3, "D")]
            if r != "x":
                moves += [(GIVEN[q], 2 + r.isupper(), "R")] + [(NEXT[k], int(r.isupper()), "K") for k in [(q, r.lower())] if k in NEXT]
            for to, cost, letter in moves:
                new[to] = min(new.get(to, (1 << 30, "")), (c + cost, a + letter))
        best = new
    b = with_inserts(best)
    return min(b[q] for q in (0, 3) if q in b)[::-1]


def test_search_against_a_table():
    rng = random.Random(1)
    for _ in range(1500):
        rows = "".join(rng.choice("suaoSUAxuaua") for _ in range(rng.randint(0, 80)))
        assert search(rows) == cheapest(rows), rows
    for step in (1, 3, 1000):
        rows = "".join(rng.choice("suaoSUAx") for _ in range(70))
        assert search(rows, step) == cheapest(rows)
    assert search("") == ("", 0) and search("ua" * 3000)[1] == 0 and search("u" * 1500)[1] == 1500


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (2, 0, "system", "S!"), (2, 1, "system", "again"), (2, 5, "assistant", None), (2, None, "user", "no turn."), (3, 0, None, "x."), (3, 0, "tool", "y."),
    (4, 0, "user", " \t"), (5, 0, "user", "same."), (5, 1, "user", "same."), (5, 2, "user", "same."), (6, 3, "assistant", "ends. \n"), (None, 0, "user", "a."), (None, 1, "user", "b."), (7, None, None, None),
    (100, 0, "user", "é."), (105, 0, "x", "y"), (105, 1, "user", "z"), (105, 1, "user", "w"), (-3, 0, "user", "m."), (-103, 0, "assistant", "q"),
] + [(200 + k, t, "ua"[t % 2] + "ser", f"text {t if k % 3 else t * k}.") for k in range(60) for t in range(k % 9)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("conversations")
    spark.createDataFrame([(*r, "clash", 1) for r in ODD], "conv_id bigint, turn bigint, role string, text string, path string, kind int").repartition(5).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_conversation_trie"])
def test_odd_conversations_by_sql(spark, odd, name):
    folder, con = odd
    assert normal(queries.QUERIES[name](spark, folder).toPandas()) == normal(con.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_conversation_trie"])
def test_no_rows(spark, tmp_path, name):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "U"), (1, 2, "user", "U"), (1, 3, "user", "V.")], "conv_id int, turn int, role string, text string")
    plan = conversation_repair.plans(rows)
    got = [(r.role, r.text, r.edit) for r in conversation_repair.repair(rows, plan).orderBy("place").collect()]
    audit = plan.first().audit
    assert (audit, plan.first().cost) == search("aUxu") and [e for *_, e in got] == [c for c in audit if c != "D"]
    assert [r for r, *_ in got] == ["user", "assistant"] * (len(got) // 2)


def test_find_close_and_ranks():
    rng = random.Random(3)
    for n in (1, 2, 63, 64, 65, 700, 5000):
        steps, depth, left = [], 0, n
        while left or depth:
            up = left and (not depth or rng.random() < 0.5)
            steps.append(1 if up else -1)
            depth, left = depth + (1 if up else -1), left - bool(up)
        stack, close = [], {}
        for i, s in enumerate(steps):
            if s == 1:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opened = np.array(sorted(close))
        tree = conversation_trie.Parentheses(np.array(steps, np.int8), block=8)
        assert tree.find_close(opened).tolist() == [close[i] for i in opened.tolist()]
        assert tree.leaf_rank()[-1] == "".join("(" if s == 1 else ")" for s in steps).count("()")


def brute(rows, head, base):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(t)] for c, t in own.items()}
    paths = {c: own.get(base(c), [])[: head(c)] + t[head(c) :] for c, t in own.items()}
    members, ends = {}, {}
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
        ends.setdefault(tuple(p), []).append(c)
    out = []
    for node, m in members.items():
        under = [k for k in members if k[: len(node)] == node]
        kids = [k for k in members if len(k) == len(node) + 1 and k[:-1] == node]
        leaves = [k for k in under if not any(len(j) == len(k) + 1 and j[:-1] == k for j in under)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k)
        digest = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaves), saved, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_turns", [1, 7, 1000])
def test_trie_over_many_shards(spark, shard_turns):
    """A hot group of copies, deep conversations and shared beginnings, cut into shards of every size."""
    rng = random.Random(5)
    rows = [(c, t, "user", f"common {t}") for c in range(40) for t in range(3)]
    rows += [(c, t, "u", f"deep {t if t < 20 else (t, c)}") for c in range(50, 53) for t in range(30)]
    rows += [(c, t, rng.choice("ua"), f"{rng.randint(0, 2)}") for c in range(60, 110) for t in range(rng.randint(1, 5))]
    c = F.col("conv_id")
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = conversation_trie.trie(df, (F.crc32(c.cast("string")) % 6).cast("int"), c - c % 100, 5, shard_turns)
    want = brute(rows, lambda v: zlib.crc32(str(v).encode()) % 6, lambda v: v - v % 100)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
