import random

import pytest

SCHEMA = "doc_id long, text string, digest string, shard int, score double, n long, key string, component string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 0.5, 3, "k", "c") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ba", "do", "ke", "lu", "mi", "or", "st", "én"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, shared = text(9000), text(120)
    base = text(90).split(" ")
    near = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in (5, 40, 70)]
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "a  b\tc"), (7, "a b c"), (8, long), (9, long), (10, long + "!"),
        (11, "one two"), (11, "one two"), (12, shared + " " + text(30)), (13, text(30) + " " + shared), (14, "a" * 3000), (15, " ".join(base)),
        (16, near[0]), (17, near[1]), (18, near[2]), (19, "ñandú €uro \U0001f600 " + text(40)), (None, "one two"), (-7, text(60)), (20, "x" * 399), (21, "x" * 400),
    ]
    return rows + [(100 + i, text(r.randint(1, 200))) for i in range(60)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return table(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])
