import random

import pytest

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, _h string, keep boolean, score double, `a.b` int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named as operators name theirs."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(20_000))
    plain = [" ".join(word() for _ in range(120)) for _ in range(12)]
    near = plain[0].split()
    near[5], near[60] = "changed", "words"
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(20, plain[1]), (21, plain[1]), (22, " ".join(near)), (30, ""), (31, ""), (32, None), (33, None), (34, long), (35, "x" * 60_000), (36, " \n\t "), (37, "Ünïcödé 😀 　 text"), (None, plain[2]), (None, None), (3, plain[3]), (3, plain[3]), (38, long)]
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None if k % 4 == 0 else k, "h", None, float(k), k) for k, (i, t) in enumerate(rows)], AWKWARD)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
