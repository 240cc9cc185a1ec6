"""Stages of the pipeline on rows with null and repeated ids."""

import corpus_pipeline

WORDS = [f"w{k}" for k in range(400)]
COPY, OTHER, CLEAN, LEAK = (" ".join(WORDS[k : k + 60]) for k in (0, 100, 200, 300))


def kept(stage, spark, rows, sf_dir):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    found = stage(spark, docs, sf_dir)
    assert tuple(found.columns) == corpus_pipeline.COLUMNS
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in found.collect())


def test_near_copies_by_row(spark, tmp_path):
    rows = [(5, COPY), (3, COPY + " more"), (None, COPY), (3, OTHER), (7, CLEAN), (7, LEAK), (7, CLEAN), (None, "only " + LEAK[:200]), (None, "only " + LEAK[:200])]
    want = sorted([(3, COPY + " more"), (3, OTHER), (7, CLEAN), (7, LEAK), (-1, "only " + LEAK[:200])])
    assert kept(corpus_pipeline.drop_near_copies, spark, rows, str(tmp_path)) == want


def test_decontamination_by_row(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(WORDS[320:340]))], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, CLEAN), (None, LEAK), (None, CLEAN), (2, LEAK), (2, OTHER), (2, OTHER)]
    want = sorted([(1, CLEAN), (-1, CLEAN), (2, OTHER), (2, OTHER)])
    assert kept(corpus_pipeline.decontaminate_benchmark, spark, rows, str(tmp_path)) == want


def table(spark, path, rows):
    spark.createDataFrame([(1, " ".join(WORDS[320:340]))], "item_id int, text string").write.mode("overwrite").parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.mode("overwrite").parquet(str(path / "documents.parquet"))


GERMAN, ENGLISH = "das ist nicht schön und es regnet heute wieder ", "this is the thing and it rains again today "


def test_language_stage_keeps_clean_texts(spark):
    rows = [(i, (GERMAN if i % 2 else ENGLISH) * 8 + str(i), "de" if i % 2 else "en", "s", 9) for i in range(60)] + [(90, None, "en", "s", 0), (91, "", None, "s", 0), (92, "12 -- 34", None, "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == list(range(60))
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).replace("", None, "lang")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, unlabelled, "").collect()) == list(range(60))


def test_whole_run_against_a_plain_loop(spark, tmp_path):
    """All stages on documents of each kind: what is left, and that it is packed once, within the budget."""
    texts = {k: (GERMAN if k % 2 else ENGLISH) + " ".join(f"u{k}x{j}" for j in range(40)) for k in range(60)}
    texts |= {100: texts[3], 101: texts[4] + " more", 102: None, 103: "", 104: "-- 12", 105: LEAK, 106: "x" * 300_000 + " " + ENGLISH, 107: ENGLISH + "password = abcdef123456"}
    lang = lambda k: "de" if k < 60 and k % 2 else "en"
    table(spark, tmp_path, [(k, t, lang(k), "s", len(t or "")) for k, t in texts.items()])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # copies of smaller ids, texts without letters and the contaminated one go
    assert sorted(r.doc_id for r in got) == [*range(60), 106, 107]
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rows in batches.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and (len(rows) == 1 or len(rows) * rows[0].bucket_len <= 65_536)


def test_stages_of_an_empty_table(spark, tmp_path):
    table(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
