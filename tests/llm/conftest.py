import random

import pytest

SYLLABLES = ["the", "an", "er", "ing", "of", "st", "re", "on", "é", "ß", "ou", "ti"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus() -> list[tuple]:
    """doc_id, text, source: copies, near copies, blanks, nulls, ties, a repeated id and a long text."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 120)), f"s{i % 4 if i % 3 else 0}") for i in range(40)]
    base = prose(rng, 200)
    words = base.split()
    rows += [(50, base, "s0"), (51, base, "s0"), (52, base.upper().replace("ß", "ß"), "s1")]
    rows += [(60 + k, " ".join([*words[: 20 * k], "changed", *words[20 * k + 1 :]]), "s2") for k in range(1, 4)]
    rows += [(70, "", "s0"), (71, None, None), (72, " \t\n", ""), (73, "One", "s3"), (74, "one", "s3"), (75, "two words", "s3"), (76, "two  words ", None)]
    rows += [(80, rows[3][1], "s1"), (80, rows[3][1], "s1"), (81, prose(rng, 9000), "s0"), (None, "no id here at all", "s1")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    extra = [(*r, "x", 1, 2.0) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, size string, n int, score double").cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
