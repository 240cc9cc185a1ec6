"""Language identification with a byte convolutional network, trained in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over the window and classified by softmax.
Training uses a bounded sample of labelled texts (`sample`, a parameter); prediction covers every byte of every text:
a text is cut into windows of `length` bytes, the last one ending at the text's end, and the windows' class
probabilities are averaged. For prediction, embedding and filters are folded into tables indexed by byte pairs, so a
filter costs a few table rows per byte.

Cases: a null text, and a text without a letter, is `und` with score 0; texts shorter than a window are padded with
zero bytes, as in training; repeated rows are predicted alike; without any labelled row every text is `und`;
an empty table gives an empty result; extra columns are ignored; null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.text import pieces

WIDTHS = (2, 3, 4)
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteCnn:
    labels: list[str]
    length: int
    embedding: np.ndarray  # (256, E); row 0 is the padding
    filters: list[np.ndarray]  # (width * E, F) by width
    bias: list[np.ndarray]
    dense: np.ndarray  # (len(WIDTHS) * F, classes)
    offset: np.ndarray

    def tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width, (place, pair?, rows): what the byte (or byte pair) at that place adds to each filter."""
        size, out = self.embedding.shape[1], []
        for width, w in zip(WIDTHS, self.filters):
            single = [self.embedding @ w[j * size : (j + 1) * size] for j in range(width)]
            parts = [(j, True, (single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, width - 1, 2)]
            parts += [(width - 1, False, single[-1])] * (width % 2)
            out.append([(j, pair, np.ascontiguousarray(t, np.float32)) for j, pair, t in parts])
        return out


def windows_of(text: bytes, length: int) -> np.ndarray:
    """(windows, length) bytes; every byte of the text stands in a window."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= length:
        return np.pad(raw, (0, length - len(raw)))[None, :]
    full = len(raw) // length
    rows = raw[: full * length].reshape(full, length)
    return rows if full * length == len(raw) else np.vstack([rows, raw[-length:]])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: ByteCnn, tables: list, rows: np.ndarray) -> np.ndarray:
    """Class probabilities of each window: place after place, for all windows at once."""
    size = model.bias[0].shape[0]
    t = np.ascontiguousarray(rows.T)
    pair = (t[:-1].astype(np.uint16) << 8) | t[1:]
    pooled = np.full((len(WIDTHS), len(rows), size), -np.inf, np.float32)
    buffer, more = np.empty((len(rows), size), np.float32), np.empty((len(rows), size), np.float32)
    for k, (width, parts) in enumerate(zip(WIDTHS, tables)):
        for i in range(model.length - width + 1):
            for n, (j, is_pair, values) in enumerate(parts):
                np.take(values, pair[i + j] if is_pair else t[i + j], axis=0, out=more if n else buffer, mode="clip")
                if n:
                    buffer += more
            np.maximum(pooled[k], buffer, out=pooled[k])
    hidden = np.maximum(np.concatenate([p + b for p, b in zip(pooled, model.bias)], axis=1), 0)
    return softmax(hidden @ model.dense + model.offset)


def fit(texts: list[bytes], labels: list[str], length: int = 256, embed: int = 8, filters: int = 8, steps: int = 250, batch: int = 256, rate: float = 0.02, seed: int = 7) -> ByteCnn:
    """Trains on random crops of the texts, some of them short, by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y_all = np.array([names.index(x) for x in labels])
    by_class = [np.flatnonzero(y_all == c) for c in range(len(names))]

    def crop(text: bytes) -> np.ndarray:
        n = length if rng.random() < 0.6 else int(rng.integers(8, length))
        at = int(rng.integers(0, max(1, len(text) - n + 1)))
        return windows_of(text[at : at + n], length)[0]

    p = {"e": rng.normal(0, 0.3, (256, embed))}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * embed), (w * embed, filters))
        p[f"b{w}"] = np.zeros(filters)
    p["d"], p["o"] = rng.normal(0, 0.2, (len(WIDTHS) * filters, len(names))), np.zeros(len(names))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    p["e"][0] = 0
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)  # classes alike, however rare a language is
        x = np.stack([crop(texts[rng.choice(by_class[c])]) for c in y])
        e = p["e"][x]
        g = {k: np.zeros_like(a) for k, a in p.items()}
        hidden, where, columns = [], [], []
        for w in WIDTHS:
            n = length - w + 1
            cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            z = cols @ p[f"w{w}"]
            at = z.argmax(axis=1)
            hidden.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + p[f"b{w}"])
            where.append(at)
            columns.append(cols)
        h = np.concatenate(hidden, axis=1)
        q = softmax(np.maximum(h, 0) @ p["d"] + p["o"])
        q[np.arange(batch), y] -= 1
        q /= batch
        g["d"], g["o"] = np.maximum(h, 0).T @ q, q.sum(axis=0)
        dh = (q @ p["d"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * filters : (k + 1) * filters]
            g[f"b{w}"] = d.sum(axis=0)
            picked = np.take_along_axis(columns[k], where[k][:, :, None], axis=1)  # (batch, filters, w * embed)
            g[f"w{w}"] = np.einsum("bf,bfc->cf", d, picked)
            back = (d[:, :, None] * p[f"w{w}"].T[None]).reshape(batch, filters, w, embed)
            for j in range(w):
                np.add.at(g["e"], np.take_along_axis(x, where[k] + j, axis=1), back[:, :, j])
        g["e"][0] = 0
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return ByteCnn(names, length, p["e"], [p[f"w{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["d"], p["o"])


def train(labelled: DataFrame, sample: int = 4000, max_bytes: int = 4096, id_col: str = "doc_id") -> ByteCnn | None:
    """Fits on at most `sample` labelled texts (columns id, text, lang), those of the smallest id hashes, and at most
    `max_bytes` characters of each; None without any. The bound holds for training alone."""
    known = labelled.where("lang is not null").withColumn("h", F.xxhash64(id_col))
    last = known.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return None
    picked = known.where((F.col("h") <= last) & (F.length("text") > 0)).select(F.substring("text", 1, max_bytes).cast("binary").alias("text"), "lang").limit(sample)
    rows = sorted((r.lang, bytes(r.text)) for r in picked.collect())
    return fit([t for _, t in rows], [x for x, _ in rows]) if rows else None


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the `keep` columns of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c) for c in keep]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *(c.alias(f"kept_{i}") for i, c in enumerate(kept)))
    schema = rows.drop("text").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            live = [i for i, x in enumerate(texts) if net and x and _LETTER.search(x.decode("utf-8", "replace"))]
            if live:
                cut = [windows_of(texts[i], net.length) for i in live]
                rows = np.vstack(cut)
                p = np.vstack([probabilities(net, tables, rows[k : k + 2048]) for k in range(0, len(rows), 2048)])
                first = np.r_[0, np.cumsum([len(c) for c in cut])[:-1]]
                mean = np.add.reduceat(p, first, axis=0) / np.array([len(c) for c in cut])[:, None]
                for i, c, s in zip(live, mean.argmax(axis=1), mean.max(axis=1)):
                    names[i], scores[i] = net.labels[c], min(1.0, float(s))
            others = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    out = rows.mapInArrow(label, schema)
    return out.select("doc_id", "lang_pred", "score", *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of ids that training must not see; null ids count as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
