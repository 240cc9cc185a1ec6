"""The language network: folded tables against a direct convolution, and accuracy on texts that training never saw."""

import numpy as np

from panelyard.llm import lang_cnn


def direct(model, row):
    """Class probabilities of one window, filter by filter and place by place."""
    x = model.embedding[row]
    hidden = []
    for width, w, b in zip(lang_cnn.WIDTHS, model.filters, model.bias):
        places = [x[i : i + width].reshape(-1) @ w for i in range(len(row) - width + 1)]
        hidden.append(np.maximum(np.max(places, axis=0) + b, 0))
    z = np.concatenate(hidden) @ model.dense + model.offset
    e = np.exp(z - z.max())
    return e / e.sum()


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(6)
    texts = [("das ist nicht schön und %d " % i if i % 2 else "this is the thing and %d " % i).encode() * 5 for i in range(40)]
    model = lang_cnn.fit(texts, ["de" if i % 2 else "en" for i in range(40)], length=32, steps=30, batch=16)
    rows = np.vstack([lang_cnn.windows_of(t, 32) for t in [*texts[:4], b"x", bytes(rng.integers(1, 256, 100).astype(np.uint8))]])
    got = lang_cnn.probabilities(model, model.tables(), rows)
    assert np.allclose(got, [direct(model, r) for r in rows], atol=1e-4) and np.allclose(got.sum(axis=1), 1, atol=1e-5)


def test_every_byte_stands_in_a_window():
    for n in (1, 31, 32, 33, 64, 200):
        text = bytes(np.random.default_rng(n).integers(1, 256, n).astype(np.uint8))
        rows = lang_cnn.windows_of(text, 32)
        assert rows.shape[1] == 32 and text.startswith(rows[0].tobytes().rstrip(b"\0")) and text.endswith(rows[-1].tobytes().rstrip(b"\0")[-min(n, 32) :])


def test_accuracy_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_cnn.train(docs.where(~lang_cnn.held_out()))
    rows = lang_cnn.predict(docs.where(lang_cnn.held_out()).where("lang is not null and length(text) > 20"), model, keep=("lang",)).where("lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
