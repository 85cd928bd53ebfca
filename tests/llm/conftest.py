import os
import random

import pytest

ODD = [None, "", " \t\n", "a", "A a", "x" * 3000, "the cat sat on the mat " * 400, "Ωmega ½ ▁ 你好 😀\x00�", "one\r\ntwo\nthree"]


@pytest.fixture(scope="session")
def docs(spark):
    """Odd and repeated texts, null ids and sources, and columns whose names clash with the operators' own."""
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "eps,", "zeta.", "eta"]
    rows = [(i, t) for i, t in enumerate(ODD * 2)]
    for i in range(100, 150):
        rows.append((i, "\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(1, 30))) for _ in range(8))))
    long = rows[-1][1]
    rows += [(200, long), (201, long + " omega"), (202, " " + long), (200, long), (None, long), (None, None)]
    full = [(i, t, None if i is None or i % 7 == 0 else f"s{i % 4}", "x", 1, "y", b"z", "r") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, keep_id string, size int, "
                                       "print string, body binary, _row string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("test tables not present")
    return path
