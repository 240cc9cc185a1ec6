"""The field of the secret scan: what it adds to the rules, on secrets that no rule finds and on clean texts."""

import numpy as np
import pytest

from panelyard.llm import secret_crf

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("text != ''").orderBy("doc_id").collect()]
    return secret_crf.train(docs.where("doc_id % 2 = 0")), [t for i, t in rows if i % 2 and not secret_crf.rule_spans(t)]


def scanned(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: [(s["start"], s["end"]) for s in r.spans if s["kind"] == "crf"] for r in secret_crf.scan(df, model).collect()}


def test_finds_secrets_without_rule_and_leaves_clean_texts(spark, field):
    model, clean = field
    rng, planted, at = np.random.default_rng(2024), [], []
    for text in clean[:250]:
        words, secret = text.split(" "), secret_crf.random_secret(rng)
        k = int(rng.integers(0, len(words) + 1))
        before = " ".join(words[:k])
        start = len(before) + bool(before)
        planted.append(" ".join([*words[:k], secret, *words[k:]]))
        at.append((start, start + len(secret)))
    texts = [p for p in planted]
    plain = [k for k, t in enumerate(texts) if not secret_crf.rule_spans(t)]
    found = scanned(spark, model, texts)
    hit = [any(s < at[k][1] and at[k][0] < e for s, e in found[k]) for k in plain]
    assert np.mean(hit) >= 0.9, np.mean(hit)
    other = scanned(spark, model, clean)
    assert np.mean([not s for s in other.values()]) >= 0.99, np.mean([not s for s in other.values()])


def test_viterbi_is_the_best_of_all_tag_sequences():
    from itertools import product

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            model = secret_crf.Crf({}, np.zeros((4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
            e = rng.normal(size=(n, 3)) * 2
            score = lambda t: model.first[t[0]] + sum(e[i, x] for i, x in enumerate(t)) + sum(model.step[a, b] for a, b in zip(t, t[1:]))  # noqa: B023, E731
            best = max(product(range(3), repeat=n), key=score)
            assert score(tuple(secret_crf.decode(model, e))) == pytest.approx(score(best))


def test_masking_replaces_every_span(spark, field):
    model, _ = field
    df = spark.createDataFrame([(1, "my password = hunter22 and more"), (2, None), (3, "plain words only"), (None, "AKIA" + "A1" * 10)], "doc_id bigint, text string")
    got = {r.doc_id: r.masked for r in secret_crf.scan(df, model, mark="[X]").collect()}
    assert got[1].startswith("my [X]") and "hunter22" not in got[1] and got[2] is None and got[3] == "plain words only" and got[None] == "[X]"
