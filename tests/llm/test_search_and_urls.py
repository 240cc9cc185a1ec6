"""Top-k search and URL rules against brute force."""

import math
import random

from panelyard.llm import impact_topk, url_trie


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], "x") for i in range(120)]
    rows += [(200 + i, rows[5][1], "x") for i in range(30)]  # ties
    rows += [(300, None, "x"), (301, [None] * 8, "x"), (302, [float("nan")] * 8, "x"), (303, [float("inf")] * 8, "x"), (None, rows[1][1], "x"), (304, [1e30] * 8, "x")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    fine = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in vectors.limit(150).collect()}
    for shard, block in ((4096, 512), (20, 3)):
        got = {}
        for r in impact_topk.search(vectors, vectors.where("vec_id % 10 = 0"), 5, shard_rows=shard, query_rows=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in [i for i in fine if i % 10 == 0]:
            best = sorted(((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q))[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert set(got) == {i for i in fine if i % 10 == 0}
    assert impact_topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(60)]
    sizes = (5e3, 1e7, 1e9, 1e14, 3e16)  # up to scores that fit no long
    rows += [(100 + i, [rng.gauss(0, 1) * sizes[i % 5] if j == i % 4 else rng.gauss(0, 0.2) for j in range(4)]) for i in range(20)]
    rows += [(200, [-(2.0**55), 0.0, 0.0, 0.0]), (201, [2.0**55, 0.0, 0.0, 0.0]), (202, [float("inf")] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows if i < 201}
    for shard, block in ((4096, 512), (10, 3)):
        got = {}
        for r in impact_topk.search(vectors, vectors, 5, shard_rows=shard, query_rows=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == set(fine)
        for q in fine:
            best = sorted(((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q))[:5]
            assert sorted(got[q]) == [(k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]


def test_top_k_sends_no_blocks_to_the_driver(spark):
    """A block goes to every shard: such copies must not be taken for the blocks' own size and broadcast. Vectors of any length."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range((0, 3, 6)[i % 3])]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for shard, block in ((4096, 512), (3, 5)):
        found = impact_topk.search(vectors, vectors, 5, shard_rows=shard, query_rows=block)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        for q in fine:
            best = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block"), ("a.net", "", "block"), ("a.net", "/x", "allow"), ("b.org", "/p/q", "block"), ("b.org", "/p/q", "allow")]


def brute(host, path):
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.com/en/1?x#y", "http://example.com/en", "http://example.com/en/", "https://xexample.com/en/", "ftp://z.net/fr/a", "ftp://net/fr/", "http://com", "http://com?/", "http://a.net", "http://a.net/xyz/1", "http://q.a.net?x", "http://b.org/p/qq/z", "http://b.org/p/q", "http://..com/", "http://u@com:80/", "x://y.com/a://b"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id int, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for limit in (100, 2):  # by trie, and by join
        found = url_trie.judge(pages, rules, default="none", max_rules=limit).collect()
        assert len(found) == 2 * len(urls)
        for r in found:
            want = brute(r.host, r.path)
            assert (r.rule, r.verdict) == ((want[3], want[2]) if want else (None, "none")), (limit, r)
    assert {r.host for r in found if urls[r.page_id] and "Example" in urls[r.page_id]} == {"www.example.com"}
    assert url_trie.judge(pages.limit(0), rules).count() == 0 and {r.verdict for r in url_trie.judge(pages, rules.limit(0)).collect()} == {"allow"}
