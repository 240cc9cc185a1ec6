"""Secret scans: rules for well-known forms, and a linear-chain conditional random field for the rest.

Words (runs without white space) are tagged B, I or O. Each word falls into a class made of its shape; a class has
features for the word itself, for the word before and for the word after, and the file as a whole adds a bias for how
much of it isn't prose. Weights come from maximum likelihood (forward-backward in numpy) on texts in which the rules'
matches stand as labels, and into which random secrets of other forms, that no rule finds, have been planted: so the
field learns how secrets look rather than what the rules look for. Decoding is Viterbi. Words that no best path can leave O on are found first, by a bound on
what the transitions can give; Viterbi then runs over the words between them, which changes no result.

Cases: a null text counts as empty; an empty text has no span; repeated rows are scanned alike; a text of one huge
word is one token; an empty table trains on nothing and yields an empty result; null ids are kept; extra columns are
ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.text import pieces

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
_HEX_RUN = re.compile(rb"[0-9a-f]{24}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())
_EDGES = b".,;:!?()[]{}\"'`<>|*&%$#-"

#: Bits of a word's flags: which rules have to look at a text that holds the word.
ASSIGN_BIT, ACCESS_BIT, HEX_BIT = 1, 2, 4
B, I, O = 0, 1, 2
BUCKETS = 4  # of the share of words that are not prose


def rule_spans(text: str, flags: int = 7) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, in order of start and kind."""
    out = []
    if flags & ASSIGN_BIT:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if flags & ACCESS_BIT:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if flags & HEX_BIT:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def shape(word: bytes) -> tuple[int, tuple[str, ...]]:
    """(flags, features) of a word; the features name its class."""
    core = word.strip(_EDGES)
    if not core.translate(None, _LETTERS) and len(word) < 64 and not _KEYWORD.search(word):
        return ACCESS_BIT * (b"AKIA" in word) + HEX_BIT * bool(_HEX_RUN.search(word)), ("prose",)
    flags = ASSIGN_BIT * bool(_KEYWORD.search(word)) + ACCESS_BIT * (b"AKIA" in word) + HEX_BIT * bool(_HEX_RUN.search(word))
    digits, upper = sum(48 <= b < 58 for b in core), sum(65 <= b < 91 for b in core)
    lower, n = sum(97 <= b < 123 for b in core), max(1, len(core))
    value = core.rpartition(b"=")[2].rpartition(b":")[2].strip(_EDGES)
    changes = sum((48 <= a < 58) != (48 <= b < 58) for a, b in zip(value, value[1:]))
    kinds = "".join(c for c, there in (("a", lower), ("A", upper), ("0", digits), ("=", b"=" in core), (":", b":" in core), ("@", b"@" in core), ("/", b"/" in core), (".", b"." in core), ("_", b"_" in core or b"-" in core)) if there)
    features = (
        f"kinds:{kinds}", f"size:{min(6, len(value) // 6)}", f"digits:{4 * digits // n}", f"upper:{4 * upper // n}",
        f"mixed:{min(5, changes // 2)}", f"hex:{bool(re.fullmatch(rb'[0-9a-f]+', value)) and len(value) > 7}",
        f"key:{bool(_KEYWORD.search(word))}", f"joins:{word[-1:] in (b'=', b':')}", f"bare:{not core}", f"quoted:{word[:1] in b'\"\'' and len(word) > 2}",
    )
    return flags, features


class Classes(dict):
    """Word -> class number; classes are numbered as they come up. Remembers a bounded number of words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.numbers, self.features, self.flags = limit, {}, [], []

    def __missing__(self, word: bytes) -> int:
        key = shape(word)
        n = self.numbers.setdefault(key, len(self.numbers))
        if n == len(self.features):
            self.flags.append(key[0])
            self.features.append(key[1])
        if len(self) < self.limit:
            self[word] = n
        return n


@dataclass
class Crf:
    weights: dict[str, np.ndarray]  # "own|", "before|" or "after|" + feature -> (3,)
    file: np.ndarray  # (BUCKETS, 3)
    step: np.ndarray  # (3, 3), from -> to
    first: np.ndarray  # (3,)

    def rows(self, features: list[tuple[str, ...]]) -> np.ndarray:
        """(3 places, classes, 3 tags): what a class adds to the tags of its word, the word after and the word before."""
        zero = np.zeros(3)
        return np.array([[sum((self.weights.get(place + f, zero) for f in fs), zero) for fs in features] for place in ("own|", "before|", "after|")]).reshape(3, -1, 3)


def file_bucket(classes: np.ndarray, prose: np.ndarray) -> int:
    if not len(classes):
        return 0
    odd = 1 - prose[classes].mean()
    return int((odd > 0.02) + (odd > 0.1) + (odd > 0.5))


def emissions(rows: np.ndarray, file: np.ndarray, classes: np.ndarray) -> np.ndarray:
    e = rows[0][classes] + file
    e[1:] += rows[1][classes[:-1]]
    e[:-1] += rows[2][classes[1:]]
    return e


def viterbi(e: np.ndarray, step: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> list[int]:
    """The best tags of a run of words; first and last: the score of the first and the last tag."""
    score = e[0] + (0 if first is None else first)
    back = []
    for x in e[1:]:
        t = score[:, None] + step
        back.append(t.argmax(axis=0))
        score = t.max(axis=0) + x
    tags = [int((score + (0 if last is None else last)).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def decode(model: Crf, e: np.ndarray) -> np.ndarray:
    """Viterbi tags of a document, run between words whose tag must be O."""
    step = model.step
    # setting one tag to O changes two transitions and, at the first word, the start score: at most so much is lost
    lost = 2 * (step.max() - step.min()) + max(0.0, model.first.max() - model.first[O])
    free = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= lost)
    tags = np.full(len(e), O)
    if len(free):
        for run in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):
            a, b = run[0], run[-1] + 1
            tags[a:b] = viterbi(e[a:b], step, step[O] if a else model.first, step[:, O] if b < len(e) else None)
    return tags


def crf_spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of the tagged words, without the quotes and brackets at their edges."""
    on = np.flatnonzero(tags != O)
    if not len(on):
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    for i in on:
        a, b = at[i]
        if out and tags[i] == I and i and tags[i - 1] != O:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    edges, spans = _EDGES.decode(), []
    for a, b in out:
        while a < b and text[a] in edges:
            a += 1
        while a < b and text[b - 1] in edges:
            b -= 1
        if b > a:
            spans.append((a, b))
    return spans


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def random_secret(rng: np.random.Generator) -> str:
    """A made-up secret of one of six forms: prefixed key, bare key, base64, dotted token, passphrase, key in groups."""
    some = lambda chars, low, high: "".join(rng.choice(list(chars), int(rng.integers(low, high + 1))))
    match int(rng.integers(0, 6)):
        case 0:
            return some("abcdefghijklmnopqrstuvwxyz", 2, 5) + str(rng.choice(["_", "-"])) + some(_ALNUM, 20, 40)
        case 1:
            return some(_ALNUM, 18, 44)
        case 2:
            return some(_ALNUM + "+/", 22, 60) + "=" * int(rng.integers(0, 3))
        case 3:
            return ".".join(some(_ALNUM + "_-", 12, 40) for _ in range(3))
        case 4:
            return some(_ALNUM[26:52], 1, 4) + some(_ALNUM + "0123456789", 8, 14) + some("!@#$%^&*+", 1, 2) + some(_ALNUM + "0123456789", 1, 4)
        case _:
            return "-".join(some(_ALNUM[:26] + "0123456789" * 2, 5, 5) for _ in range(int(rng.integers(3, 6))))


def fit(texts: list[str], radius: int = 8, runs: int = 3, steps: int = 100, rate: float = 0.2, decay: float = 0.003, seed: int = 5) -> Crf:
    """Maximum likelihood with a squared penalty on windows of words: around each rule match and planted secret, and `runs`
    others a text. Every other text gets two secrets."""
    rng, classes = np.random.default_rng(seed), Classes()
    size = 2 * radius + 1
    cut: list[tuple[np.ndarray, np.ndarray, int]] = []
    for text in texts:
        at = [m.span() for m in _WORD.finditer(text)]
        if not at:
            continue
        c = np.array([classes[w] for w in text.encode().split()])
        y, starts = np.full(len(c), O), np.array([a for a, _ in at])
        ends = np.array([b for _, b in at])
        for a, _, b in rule_spans(text):
            inside = np.flatnonzero((starts < b) & (ends > a))
            y[inside] = I
            y[inside[0]] = B
        centres = [*np.flatnonzero(y == B)[:runs]]
        if rng.integers(0, 2):
            places = np.sort(rng.integers(0, len(c) + 1, 2))
            places = places[[k == len(c) or y[k] != I for k in places]]  # not inside a match
            c = np.insert(c, places, [classes[random_secret(rng).encode()] for _ in places])
            y = np.insert(y, places, B)
            centres = [*np.flatnonzero(y == B)[: 2 * runs]]
        prose = np.array([f == ("prose",) for f in classes.features])
        bucket = file_bucket(c, prose)
        centres += [*rng.integers(0, len(c), runs)]
        odd = np.flatnonzero(~prose[c] & (y == O))
        centres += [*rng.choice(odd, min(runs, len(odd)), replace=False)] if len(odd) else []
        for k in centres:
            a = max(0, min(int(k) - int(rng.integers(0, size)), len(c) - size))
            cut.append((c[a : a + size], y[a : a + size], bucket))
    model = Crf({}, np.zeros((BUCKETS, 3)), np.zeros((3, 3)), np.zeros(3))
    if not cut:
        model.file[:, O] = 1e6
        return model
    names = sorted({p + f for fs in classes.features for f in fs for p in ("own|", "before|", "after|")})
    number = {n: i for i, n in enumerate(names)}
    hot = np.zeros((3, len(classes.features) + 1, len(names)))  # the last class is the padding
    for place, p in enumerate(("own|", "before|", "after|")):
        for k, fs in enumerate(classes.features):
            for f in fs:
                hot[place, k, number[p + f]] = 1
    pad = len(classes.features)
    n, longest = len(cut), max(len(c) for c, _, _ in cut)
    c = np.full((n, longest), pad)
    y, live = np.full((n, longest), O), np.zeros((n, longest), bool)
    for i, (a, b, _) in enumerate(cut):
        c[i, : len(a)], y[i, : len(a)], live[i, : len(a)] = a, b, True
    bucket = np.array([k for _, _, k in cut])
    before, after = np.pad(c, ((0, 0), (1, 0)), constant_values=pad)[:, :-1], np.pad(c, ((0, 0), (0, 1)), constant_values=pad)[:, 1:]
    gold = np.eye(3)[y] * live[:, :, None]
    pairs = live[:, 1:] & live[:, :-1]
    p = {"w": np.zeros((len(names), 3)), "file": model.file, "step": model.step, "first": model.first}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for t in range(1, steps + 1):
        rows = hot @ p["w"]
        e = (rows[0][c] + rows[1][before] + rows[2][after] + p["file"][bucket][:, None]) * live[:, :, None]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + p["first"]
        for k in range(1, longest):
            alpha[:, k] = np.where(live[:, k, None], total(alpha[:, k - 1, :, None] + p["step"], 1) + e[:, k], alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            beta[:, k] = np.where(live[:, k + 1, None], total(p["step"] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), beta[:, k + 1])
        z = total(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + p["step"] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        d = (gold - post) / n
        g = {"file": np.zeros((BUCKETS, 3)), "first": (gold - post)[:, 0].sum(axis=0) / n}
        by_class = np.array([[np.bincount(where.ravel(), d[:, :, tag].ravel(), pad + 1) for tag in range(3)] for where in (c, before, after)]).transpose(0, 2, 1)
        g["w"] = np.einsum("pkf,pkt->ft", hot, by_class)
        np.add.at(g["file"], bucket, d.sum(axis=1))
        g["step"] = (np.einsum("nka,nkb->ab", gold[:, :-1] * pairs[:, :, None], gold[:, 1:]) - both.sum(axis=(0, 1))) / n
        for k in p:
            x = -g[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x**2
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Crf({n: p["w"][i] for n, i in number.items()}, p["file"], p["step"], p["first"])


def train(docs: DataFrame, sample: int = 3000, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Fits on at most `sample` texts, those of the smallest id hashes, half of which hold a match of a rule where there
    are so many; of each at most `max_chars` characters. The bound holds for training alone."""
    rows = docs.where(F.col(text_col) != "").select(F.substring(text_col, 1, max_chars).alias("text"), F.xxhash64(id_col).alias("h"))
    hit = F.col("text").rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]") | F.col("text").rlike("AKIA[A-Z0-9]{16}")
    texts: list[str] = []
    for part in (rows.where(hit), rows):
        last = part.select("h").orderBy("h").limit(sample // 2).agg(F.max("h")).first()[0]
        if last is not None:
            texts += sorted(r.text for r in part.where(F.col("h") <= last).select("text").limit(sample // 2).collect())
    return fit(texts)


def scan(docs: DataFrame, model: Crf, caution: float = 1.5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), mark: str | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end; in order of start and kind) and the `keep` columns of each row; with a mark, also
    `masked`, the text in which the mark stands for each span.

    The spans of the rules stay as they are; a span of the field is added where it meets none of them. caution: added
    to the log score of O at each word, as a missed span costs less here than a clean word taken for a secret."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    schema = rows.drop("text").withColumn("spans", F.expr("cast(null as array<struct<kind:string,start:int,end:int>>)")).schema
    schema = schema.add("masked", "string") if mark is not None else schema
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, classes, bias = shared.value, Classes(), np.eye(3)[O] * caution
        tables: tuple = ()
        for batch in pieces(batches):
            out, masked = [], []
            for raw in batch.column("text").to_pylist():
                some = raw.split() if raw else []
                c = np.fromiter(map(classes.__getitem__, some), np.int32, len(some))
                if not len(tables) or len(tables[1]) < len(classes.features):
                    tables = (net.rows(classes.features), np.array(classes.flags), np.array([f == ("prose",) for f in classes.features]))
                found: list[tuple[int, int, int]] = []
                if len(c):
                    seen = np.flatnonzero(np.bincount(c, minlength=len(classes.features)))
                    flags = int(np.bitwise_or.reduce(tables[1][seen]))
                    tags = decode(net, emissions(tables[0], net.file[file_bucket(c, tables[2])] + bias, c))
                    text = raw.decode() if flags or (tags != O).any() else ""
                    found = rule_spans(text, flags)
                    base = list(found)
                    found += [(a, 3, b) for a, b in crf_spans(text, tags) if text and not any(a < e and s < b for s, _, e in base)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)])
                if mark is not None:
                    masked.append(redact(text, [(a, b) for a, _, b in found], mark).encode() if found else raw)
            names = [c for c in batch.schema.names if c != "text"]
            more = [pa.array(masked, pa.binary()).cast(pa.string())] if mark is not None else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, arrow), *more], [*names, "spans", *(["masked"] if more else [])])

    found = rows.mapInArrow(tag, schema)
    return found.select("doc_id", "spans", *(["masked"] if mark is not None else []), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or union of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
