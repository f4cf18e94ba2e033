import random

import pytest
from pyspark.sql import functions as F


def word(n: int) -> str:
    return "".join(chr(97 + int(c)) for c in str(n))


def prose(rng: random.Random, n: int, words: int = 3000) -> str:
    return " ".join("w" + word(rng.randrange(words)) for _ in range(n))


def edited(rng: random.Random, text: str, rate: float) -> str:
    return " ".join("e" + word(rng.randrange(10**6)) if rng.random() < rate else w for w in text.split(" "))


def corpus(seed: int = 7) -> list[tuple]:
    """(doc_id, text, lang, source) rows: families of copies at many similarities, a shared
    passage, repeated lines, edge cases, repeated rows and null columns."""
    rng = random.Random(seed)
    rows, doc = [], 0

    def add(text, lang="en", source="a"):
        nonlocal doc
        rows.append((doc, text, lang, source))
        doc += 1

    passage = prose(rng, 70)
    for k in range(12):
        base = prose(rng, rng.randrange(40, 200))
        for rate in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1):
            add(edited(rng, base, rate), source="hot" if k < 4 else f"s{k % 3}")
    for _ in range(15):
        add(prose(rng, 60) + " " + passage + "\n" + prose(rng, 60))
        add(prose(rng, 60) + "\n" + edited(rng, passage, 0.04) + " " + prose(rng, 30), source=None)
    add("A b c")
    add("a B C")
    add("")
    add(None)
    add(" \t\n ")
    add("éß" * 70, None)
    add("same line here\n" * 40)
    add("ab" * 300)
    add(("x " * 30_000).strip())
    rows.append(rows[3])
    rows.append(rows[3])
    rows.append((None, rows[5][1], "en", None))
    rows.append((None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    for name in ("rep", "key", "label", "kept", "size", "taken", "_gone", "_doc", "_spans", "_key", "bucket", "h"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
