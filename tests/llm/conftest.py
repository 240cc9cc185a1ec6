import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Documents with nulls, copies, near copies, shared passages, one-word and very long texts, and repeated rows."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = prose(70), prose(3000)
    near = prose(120).split()
    out = [None, "", "   ", "one", "Two words", passage, prose(20) + "\n" + passage + " " + prose(20), passage + "\t" + passage, long, long, long.upper(), prose(49), prose(50), "é ü 中文 " + prose(9)]
    for k in range(12):
        copy = list(near)
        copy[k * 9] = "changed"
        out.append(" ".join(copy))
    out += [prose(rng.randint(1, 90)) for _ in range(40)]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return [*zip(ids, out), (ids[8], long), (None, passage), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if n % 3 else None, "s", n, "x") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, word string").repartition(3).cache()
