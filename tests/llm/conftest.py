import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("size", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


def prose(rng: random.Random, words: int) -> str:
    pool = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "san", "e") for b in ("ten", "ri", "os", "na", "lu", "é")]
    return " ".join(rng.choice(pool) + rng.choice(["", "", ",", "."]) for _ in range(words))


def corpus(seed: int = 5) -> list[tuple]:
    """Texts with exact and near copies, shared passages, nulls, empty and one-word texts, a long one, a hot source."""
    rng = random.Random(seed)
    passage = prose(rng, 80)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(30)]
    texts: list[str | None] = [None, None, "", "", " ", "\t\n", "word", "two words", "a b c", "...", "12 34"]
    texts += base + base[:6] + [base[0]] * 12
    texts += [b.replace(" ", "  ", 1) for b in base[6:9]]
    for b in base[9:16]:
        w = b.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 10) + " " + passage + " " + prose(rng, 10) for _ in range(8)]
    texts += [prose(rng, 6000), "é" * 500, "漢字 かな " * 60, "x" * 3000]
    rng.shuffle(texts)
    sources = ["hot"] * 5 + ["b", "a", "c", None]
    return [(3 * i + 1, t, rng.choice(["en", "fr", None]), rng.choice(sources), None, "s", "n", "k", "d", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def doubled(spark, rows):
    """Rows that repeat as a whole, and rows without doc_id."""
    more = [(None, *r[1:]) for r in rows[:4]]
    return spark.createDataFrame(rows[:20] + rows[:20] + more, SCHEMA)
