"""The registered queries of this subpackage, and SQL for those that SQL can express.

Each query reads its whole tables and derives its digest columns from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import conversation_repair, conversation_trie, ctw, decontaminate, id_store, impact_topk, jaccard_join, lang_cnn, length_packing, rlz_dedup, secret_crf, url_trie, word_bpe
from panelyard.llm.text import table


def op1_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_packing.pack(table(spark, sf_dir, "documents"), n_buckets=16, token_budget=65_536)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_trie.judge(table(spark, sf_dir, "pages"), rules, default="allow", keep=("page_id",))


def op4_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return impact_topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
gram AS (
  SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc, sizes WHERE len(w) >= size)),
hit AS (SELECT gram.r, gram.i, gram.size, win.item_id FROM gram JOIN win ON gram.size = win.size AND gram.g = win.g),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS j FROM hit) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named.s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_cnn.train(docs.where(~lang_cnn.held_out()))
    found = lang_cnn.predict(docs, model)
    return found.select("doc_id", lang_cnn.held_out().alias("held_out"), "lang_pred", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_crf.scan(docs, secret_crf.train(docs))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in secret_crf.KINDS),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT r, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (r)
"""

OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, dictionary = id_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return id_store.read(manifest, dictionary)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), size=5, per_cent=75)


OP5_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'row ' || row_number() OVER ()) AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT k, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM (SELECT k, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM doc WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.k AS a, y.k AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.k <> y.k GROUP BY 1, 2)
  JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
reach AS (SELECT k AS a, k AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.b, doc.doc_id) AS component_id
FROM doc LEFT JOIN n USING (k) LEFT JOIN (SELECT a, min(d.doc_id) AS b FROM reach JOIN (SELECT DISTINCT k, doc_id FROM doc) d ON d.k = reach.b GROUP BY a) c ON c.a = doc.k
"""

def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz_dedup.deduplicate(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM doc WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS j FROM win JOIN first USING (g) WHERE win.doc_id > first.d),
word AS (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS j FROM doc),
kept AS (
  SELECT word.r, count(*) FILTER (gone.j IS NOT NULL) AS n, string_agg(x, ' ' ORDER BY word.j) FILTER (gone.j IS NULL) AS t
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.j = gone.j GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""

def op2_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ctw.score(docs, docs.where(~ctw.held_out()))
    return found.select("doc_id", ctw.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    read = word_bpe.decode(word_bpe.encode(table(spark, sf_dir, "documents"), path), word_bpe.vocabulary_pieces(spark, path))
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return conversation_trie.trie(table(spark, sf_dir, "conversations"), head=(F.crc32(c.cast("string")) % 6).cast("int"), base=c - c % 100, most=5)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    byte = "lambda c, b: list_reduce(list_concat([xor(c, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))), {byte}), 4294967295)"


OP13_SQL = f"""
WITH conv AS MATERIALIZED (
  SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS own
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
cut AS (SELECT *, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS INTEGER) AS h FROM conv),
path AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.own[:c.h], []), CASE WHEN c.h < len(c.own) THEN c.own[c.h + 1:] ELSE [] END) AS p
  FROM cut c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100),
member AS MATERIALIZED (
  SELECT conv_id, d, list_transform(p[:d], lambda t: t.k) AS node, CASE WHEN d > 0 THEN list_transform(p[:d - 1], lambda t: t.k) END AS up, CASE WHEN d > 0 THEN p[d].n ELSE 0 END AS n, len(p) = d AS here
  FROM (SELECT conv_id, p, unnest(generate_series(0, len(p))) AS d FROM path)),
node AS MATERIALIZED (
  SELECT node, any_value(up) AS up, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
    sha256(coalesce(string_agg(CASE WHEN here THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM member GROUP BY node),
kids AS MATERIALIZED (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
under AS (
  SELECT a.node, sum(b.saved) AS saved, count(*) FILTER (k.up IS NULL) AS leaves
  FROM (SELECT node, saved, unnest(generate_series(0, depth)) AS d FROM node) b JOIN node a ON a.node = b.node[:b.d] LEFT JOIN kids k ON k.up = b.node GROUP BY a.node)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM node a JOIN under u ON u.node = a.node LEFT JOIN node p ON p.node = a.up LEFT JOIN kids k ON k.up = a.node
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return conversation_repair.report(conversations, conversation_repair.damage(conversations, F.crc32(place) % 20))


OP11_SQL = f"""
WITH RECURSIVE src AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM src)),
put AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i, role[1] AS c,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z FROM rows),
flag AS MATERIALIZED (
  SELECT *, z = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, z NOT IN ('.', '!', '?') AS open, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM put),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND open) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM flag GROUP BY conv_id),
put_in(q, q2, letters, cost) AS (VALUES (0, 0, '', 0), (0, 2, 'I', 2), (0, 3, 'II', 4), (1, 1, '', 0), (1, 2, 'I', 2), (1, 3, 'II', 4), (2, 2, '', 0), (2, 3, 'I', 2), (2, 2, 'II', 4), (3, 3, '', 0), (3, 2, 'I', 2), (3, 3, 'II', 4)),
go(q, c, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
given(q, q2) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, q, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit FROM (
    SELECT b.conv_id, b.i + 1 AS i, e.q2 AS q, b.cost + p.cost + e.cost + CASE WHEN e.l <> 'D' AND f.open THEN 1 ELSE 0 END AS cost, b.audit || p.letters || e.l AS audit
    FROM best b JOIN put_in p ON p.q = b.q JOIN flag f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
    JOIN (SELECT q, NULL AS c, q AS q2, 'D' AS l, 3 AS cost FROM given UNION ALL SELECT q, c, q2, 'K', 0 FROM go UNION ALL SELECT q, NULL, q2, 'R', 2 FROM given) e
      ON e.q = p.q2 AND (e.l = 'D' OR NOT (f.blank OR f.again)) AND (e.c IS NULL OR e.c = f.c)) GROUP BY conv_id, i, q),
ended AS (
  SELECT b.conv_id, min(b.cost + p.cost) AS cost, arg_min(b.audit || p.letters, (b.cost + p.cost, b.audit || p.letters)) AS audit
  FROM best b JOIN counts k ON k.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = k.n JOIN put_in p ON p.q = b.q WHERE p.q2 IN (0, 3) GROUP BY b.conv_id),
step AS (
  SELECT conv_id, k, e, count(*) FILTER (e <> 'I') OVER w AS i, audit, count(*) FILTER (e <> 'D') OVER w AS place
  FROM (SELECT conv_id, audit, unnest(string_split(audit, '')) AS e, unnest(generate_series(1, length(audit))) AS k FROM ended WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kept AS (
  SELECT s.conv_id, s.place, s.e, f.role, f.text, max(CASE WHEN s.place = 1 AND s.e = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS lead
  FROM step s LEFT JOIN flag f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND s.e <> 'I' WHERE s.e <> 'D'),
out AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS h FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, coalesce(out.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN out ON out.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES = {"op11_conversation_repair": op11_conversation_repair, "op13_conversation_trie": op13_conversation_trie, "op12_word_bpe": op12_word_bpe, "op2_ctw_score": op2_ctw_score, "op6_substring_dedup": op6_substring_dedup, "op5_jaccard_join": op5_jaccard_join, "op9_id_store": op9_id_store, "op1_length_packing": op1_length_packing, "op3_url_filter": op3_url_filter, "op4_impact_topk": op4_impact_topk, "op8_language_id": op8_language_id, "op10_secret_scan": op10_secret_scan, "op7_decontaminate": op7_decontaminate}
ORACLE_SQL = {"op11_conversation_repair": OP11_SQL, "op13_conversation_trie": OP13_SQL, "op6_substring_dedup": OP6_SQL, "op5_jaccard_join": OP5_SQL, "op3_url_filter": OP3_SQL, "op4_impact_topk": OP4_SQL, "op7_decontaminate": OP7_SQL}
