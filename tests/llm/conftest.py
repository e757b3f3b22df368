import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """Texts of every awkward kind, with repeated rows, near copies and a very long one."""
    rnd = random.Random(11)
    words = "the of and il était né straße 中文 über can't we'll 12 3.5 idiot you stupid".split()
    out = [None, "", " ", "\n\t ", "a", "a b", "one two three four", "a<|endoftext|>b", "'s 't it's  'LL\n\n x", "é" * 50, "😀😀 ok", "x" * 20_000]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 80))) for _ in range(40)]
    out += base + base[:10]
    for b in base:
        w = b.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    copied = [f"w{i}" for i in range(120)]
    for i in range(30):
        out.append(" ".join(copied[:i] + [f"new{i}"] + copied[i + 1 :]))
    out.append(" ".join(rnd.choice(words) for _ in range(60_000)))
    return out


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Documents with null and repeated ids, and columns whose names operators use themselves."""
    rows = [(None if i in (5, 6) else 3 if i in (20, 21) else i, t, None if i % 9 == 0 else f"src{i % 4}", "en", len(t or ""), 1.0, 2, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double, shard int, row long").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.filter("false")
